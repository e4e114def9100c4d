"""Embedding models: their tables, checks, the size that is asked of them, and calls whose errors are mapped."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from tessera import errors
from tessera.functions import fixed


@dataclass(frozen=True)
class Model:
    """A model of a provider; `dims` overrides its own size where that is given."""

    provider: str
    name: str
    dims: int | None = None

    @property
    def dimensions(self) -> int:
        return self.dims or fixed.DIMENSIONS.get(self.name, 768)

    @property
    def max_tokens(self) -> int:
        return fixed.TOKEN_LIMITS.get(self.name, 8192)

    def requested_dimensions(self) -> int | None:
        """The size to name in a request: only one that is not the model's own."""
        return self.dimensions if self.dimensions != fixed.DIMENSIONS.get(self.name, 768) else None

    def cost(self, tokens: int) -> dict:
        """Price of embedding so many tokens, in dollars (0 for local models)."""
        price = fixed.PRICES.get(self.name, 0.0)
        return {"model": self.name, "tokens": tokens, "price_per_million": price, "cost": tokens * price / 1_000_000}

    def checked(self, tokens: int) -> int:
        if tokens > self.max_tokens:
            raise errors.TokenLimitExceeded(tokens, self.max_tokens, self.provider)
        return tokens


def fitted(vector: Sequence[float], dims: int | None) -> list[float]:
    """The first `dims` numbers of a vector: what an override asks of a model that cannot shorten its vectors itself."""
    return list(vector) if dims is None else list(vector)[:dims]


def guarded(model: Model, call: Callable[[Sequence[str]], list[list[float]]]) -> Callable[[Sequence[str]], list[list[float]]]:
    """call with its errors mapped by their `status` and its vectors at the model's size."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        try:
            found = call(texts)
        except Exception as e:
            raise errors.of_status(getattr(e, "status", None), model.provider, model.name, e) from e
        return [fitted(v, model.dims) for v in found]

    return run


def healthy(probe: Callable[[], object]) -> bool:
    """Whether a server answers a call."""
    try:
        probe()
    except Exception:
        return False
    return True


def embedding_models(names: Sequence[str]) -> list[str]:
    """Of the models that a server lists, those that embed."""
    return [n for n in names if "embed" in n or n in fixed.DIMENSIONS]
