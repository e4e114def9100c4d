"""Which branch and commit a project was indexed at, and the files that differ since: read from git on the driver."""

from __future__ import annotations

import json
import subprocess
import time

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.collections import Folder


def _git(root: str, *args: str) -> str | None:
    """Output of a git command, or None where it fails or there is no git."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout


def current(root: str) -> dict | None:
    branch, commit = _git(root, "rev-parse", "--abbrev-ref", "HEAD"), _git(root, "rev-parse", "HEAD")
    return None if branch is None or commit is None else {"branch": branch.strip(), "commit": commit.strip()}


def save(folder: Folder, state: dict, name: str = "git-state.json") -> None:
    folder.write(name, json.dumps(state | {"last_indexed": time.time()}))


def load(folder: Folder, name: str = "git-state.json") -> dict | None:
    text = folder.read(name)
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def changed_paths(root: str, old: str, new: str) -> list[str]:
    """Paths that differ between the common ancestor of two commits and the later one; none where git fails."""
    out = _git(root, "diff", "--name-only", "-z", f"{old}...{new}")
    return [p for p in (out or "").split("\0") if p]


def changed_files(spark: SparkSession, root: str, old: str, new: str) -> DataFrame:
    """changed_paths as a table (path)."""
    return spark.createDataFrame([(p,) for p in changed_paths(root, old, new)], "path string")


def changed_since(root: str, saved: dict | None) -> tuple[bool, list[str]]:
    """Whether branch or commit differ from the saved state, and the files that do. Without a state nothing has changed."""
    now = current(root)
    if saved is None or now is None or (now["branch"], now["commit"]) == (saved["branch"], saved["commit"]):
        return False, []
    return True, changed_paths(root, saved["commit"], now["commit"])
