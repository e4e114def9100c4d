"""Configuration: defaults, presets, environment values, merging and checks."""

from __future__ import annotations

import copy
import json
import os
import re

from tessera.errors import ConfigError
from tessera.functions import fixed
from tessera.sources.files import parse_size

# Defaults.
DEFAULTS = {
    "version": "1.0.0",
    "indexing": {
        "granularity": "hybrid", "chunkingStrategy": "ast-split-merge", "maxChunkSize": 250, "overlap": 50, "reindexStrategy": "incremental",
        "include": ["src/**/*", "lib/**/*"],
        "exclude": [
            "node_modules/**", "**/*.test.ts", "**/*.spec.ts", "**/*.test.rb", "**/*.spec.rb", "dist/**", "build/**", "coverage/**",
            "**/*.min.js", "**/*.map"
        ],
        "languageConfig": {"typescript": {"extensions": [".ts", ".tsx"]}, "ruby": {"extensions": [".rb"]}},
    },
    "embedding": {"provider": "ollama", "model": "nomic-embed-text", "dimensions": 768, "batchSize": 32, "concurrency": 3},
    "vectordb": {"provider": "milvus", "collectionName": "code_chunks", "indexType": "IVF_FLAT", "metricType": "COSINE"},
    "search": {
        "strategy": "hybrid", "resultFormat": "hybrid", "maxResults": 10, "minScore": 0.7,
        "hybrid": {"vectorWeight": 0.7, "keywordWeight": 0.3}
    },
    "performance": {"maxFileSize": "1MB", "maxConcurrent": 10},
    "merkle": {"enabled": True, "algorithm": "sha256"},
}

# Presets, laid over the defaults.
PRESETS = {
    "fast": {
        "indexing": {
            "granularity": "file", "chunkingStrategy": "sliding-window", "maxChunkSize": 500, "overlap": 0, "reindexStrategy": "manual",
            "include": ["src/**/*"], "exclude": ["node_modules/**", "dist/**", "build/**"]
        },
        "search": {
            "strategy": "semantic", "resultFormat": "snippet", "maxResults": 5, "minScore": 0.6
        }, "performance": {"maxFileSize": "500KB", "maxConcurrent": 20}},
    "quality": {
        "indexing": {
            "granularity": "function", "maxChunkSize": 200, "overlap": 100, "include": ["src/**/*", "lib/**/*", "app/**/*"],
            "exclude": ["node_modules/**", "**/*.test.*", "**/*.spec.*", "dist/**", "build/**"]
        },
        "search": {
            "strategy": "hybrid", "resultFormat": "context", "maxResults": 20, "minScore": 0.75,
            "hybrid": {"vectorWeight": 0.8, "keywordWeight": 0.2}
        }, "performance": {"maxFileSize": "2MB", "maxConcurrent": 5}},
    "local": {"embedding": {"provider": "ollama", "model": "nomic-embed-text", "dimensions": 768, "batchSize": 32, "concurrency": 3}},
}


def merge(base: dict, over: dict) -> dict:
    """base with over laid on it: objects merge, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def substitute(value, env=None):
    """`${NAME}` in texts becomes the environment's value; a missing one is an error."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            if m[1] not in env:
                raise ConfigError(f"environment variable {m[1]} is not set")
            return env[m[1]]

        return re.sub(r"\$\{(\w+)\}", one, value)
    return value


def load(text: str | None = None, preset: str | None = None, env=None) -> dict:
    """Defaults, then a preset, then JSON text with environment values."""
    out = copy.deepcopy(DEFAULTS)
    if preset:
        if preset.lower() not in PRESETS:
            raise ConfigError(f"unknown preset {preset}")
        out = merge(out, PRESETS[preset.lower()])
    return merge(out, substitute(json.loads(text), env)) if text else out


def problems(config: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a configuration."""
    errors, warnings = [], []
    size = config["indexing"]["maxChunkSize"]
    if not isinstance(size, int) or size <= 0:
        errors.append("indexing.maxChunkSize must be a positive integer")
    if not 0 <= config["search"]["minScore"] <= 1:
        errors.append("search.minScore must be between 0 and 1")
    try:
        parse_size(config["performance"]["maxFileSize"])
    except ValueError as e:
        errors.append(str(e))
    known = fixed.DIMENSIONS.get(config["embedding"]["model"])
    if known and known != config["embedding"]["dimensions"]:
        warnings.append(f"{config['embedding']['model']} has {known} dimensions, not {config['embedding']['dimensions']}")
    hybrid = config["search"].get("hybrid")
    if hybrid and abs(hybrid["vectorWeight"] + hybrid["keywordWeight"] - 1) > 0.01:
        warnings.append("hybrid weights do not sum to 1")
    return errors, warnings


def for_project(info: dict) -> dict:
    """A configuration for a detected project: larger ones have larger batches and narrower globs."""
    small, ruby = info["size"] == "small", info["primary_language"] == "ruby"
    tests = ["node_modules/**", "**/*.test.*", "**/*.spec.*"]
    built = ["dist/**", "build/**", "spec/**", "test/**"]
    # Globs by size.
    if small:
        include, exclude = ["src/**", "lib/**", "app/**"], tests
    elif info["size"] == "medium":
        include, exclude = (["app/models/**", "app/services/**", "lib/**"] if ruby else ["src/**", "lib/**", "packages/*/src/**"]), tests + built
    else:
        include = ["app/models/**", "app/services/**", "app/queries/**", "lib/**"] if ruby else ["packages/*/src/**", "apps/*/src/**", "src/**"]
        exclude = [*tests, "**/__tests__/**", "**/*.stories.*", "**/*.d.ts", *built, "vendor/**", "public/**"]
    return merge(DEFAULTS, {
        "project": {"name": info["name"], "languages": info["languages"]}, "indexing": {"include": include, "exclude": exclude},
        "embedding": {"batchSize": 32, "concurrency": 3} if small else {"batchSize": 64, "concurrency": 5},
        "vectordb": {"collectionName": re.sub(r"[^A-Za-z0-9_]", "_", info["name"])}, "search": {"minScore": 0.5}})
