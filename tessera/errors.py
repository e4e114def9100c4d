"""Errors with a code and details, how they read, and which of them may pass if tried again."""

from __future__ import annotations

import json
import traceback


# The codes and messages of the errors below, and the statuses of of_status().


class EngineError(Exception):
    """An error of the engine. Subclasses set the code; details say what it is about."""

    code = "ENGINE_ERROR"
    retryable = False

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class IndexingError(EngineError):
    code = "INDEXING_ERROR"


class FileMissing(IndexingError):
    def __init__(self, path: str):
        super().__init__(f"File not found: {path}", path=path)


class FileTooLarge(IndexingError):
    def __init__(self, path: str, size: int, most: int):
        super().__init__(f"File too large: {path} ({size} bytes, max: {most} bytes)", path=path, size=size, most=most)


class ParseError(EngineError):
    code = "PARSE_ERROR"


class UnsupportedLanguage(ParseError, ValueError):
    def __init__(self, language: str):
        super().__init__(f"unsupported language: {language}", language=language)


class SyntaxTreeError(ParseError):
    def __init__(self, path: str, cause: Exception | None = None):
        super().__init__(f"Failed to parse AST for {path}", path=path, cause=None if cause is None else str(cause))


class SearchError(EngineError):
    code = "SEARCH_ERROR"


class NoResults(SearchError):
    def __init__(self, query: str):
        super().__init__(f"No results found for query: {query}", query=query)


class SnapshotError(EngineError):
    code = "MERKLE_ERROR"


class ConfigError(EngineError, ValueError):
    code = "CONFIG_ERROR"


class InvalidConfig(ConfigError):
    def __init__(self, field: str, reason: str):
        super().__init__(f"Invalid configuration for {field}: {reason}", field=field, reason=reason)


class CollectionError(EngineError):
    code = "VECTOR_DB_ERROR"


class CollectionNotFound(CollectionError, KeyError):
    def __init__(self, name: str):
        super().__init__(f"Collection {name} not found", collection=name)

    __str__ = Exception.__str__


class CollectionExists(CollectionError, ValueError):
    def __init__(self, name: str):
        super().__init__(f"Collection {name} already exists", collection=name)


class DimensionMismatch(CollectionError, ValueError):
    def __init__(self, name: str, expected: int, got: int):
        super().__init__(f"Dimension mismatch: {name} has {expected}, got {got}", collection=name, expected=expected, got=got)


class Preempted(IndexingError):
    """Another writer has taken the lock over; nothing was committed."""


class EmbeddingError(EngineError):
    code = "EMBEDDING_ERROR"
    retryable = True


class ModelNotAvailable(EmbeddingError):
    retryable = False

    def __init__(self, provider: str, model: str):
        super().__init__(f"Model {model} is not available", provider=provider, model=model)


class ProviderUnreachable(EmbeddingError):
    retryable = False

    def __init__(self, provider: str, reason: str = ""):
        super().__init__(f"Failed to connect to {provider}" + (f": {reason}" if reason else ""), provider=provider)


class TokenLimitExceeded(EmbeddingError):
    retryable = False

    def __init__(self, tokens: int, most: int, provider: str = ""):
        super().__init__(f"Token count {tokens} exceeds maximum {most}", provider=provider, tokens=tokens, most=most)


def formatted(error: object) -> str:
    """An engine's error with its code and details; another one with its trace; anything else as text."""
    if isinstance(error, EngineError):
        return f"[{error.code}] {error}" + (f"\nDetails: {json.dumps(error.details, indent=2)}" if error.details else "")
    if isinstance(error, BaseException):
        return f"{type(error).__name__}: {error}\n" + "".join(traceback.format_exception(error))
    return str(error)


def may_pass(error: BaseException) -> bool:
    """Whether the same call may succeed later: refused or timed-out connections, and what says so itself."""
    if isinstance(error, EngineError):
        return error.retryable
    return isinstance(error, ConnectionRefusedError | TimeoutError) or any(word in str(error) for word in ("timeout", "temporarily"))


def of_status(status: int | None, provider: str, model: str, cause: Exception) -> Exception:
    """The error that a model server's HTTP status stands for; the cause itself where it stands for none."""
    if status == 401:
        return ProviderUnreachable(provider, "Invalid API key")
    if status == 404:
        return ModelNotAvailable(provider, model)
    if status == 429:
        return EmbeddingError("Rate limit exceeded, retrying...", provider=provider)
    if status in (500, 503):
        return EmbeddingError(f"{provider} server error, retrying...", provider=provider)
    return cause
