"""Embedders: the contract, a deterministic one that needs no model, engines, and embedding as a column function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.budget import RollingLimiter
from ..session import EmbeddingSettings
from ..sources.store import Identity


class Embedder(Protocol):
    """What makes vectors of texts and of RGB images; batches keep their order."""

    identity: Identity

    def embed_texts(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_images(self, images: Sequence[bytes]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors drawn by a hash of the content: for tests and dry runs."""

    def __init__(self, dimension: int = 64, model_id: str = "hash", version: int = 1) -> None:
        self.identity = Identity(model_id, dimension, version)

    def _vectors(self, items: Sequence[bytes]) -> np.ndarray:
        seeds = [int.from_bytes(hashlib.sha256(x).digest()[:8], "big") for x in items]
        v = np.stack([np.random.default_rng(s).normal(size=self.identity.dimension) for s in seeds]) if seeds else np.zeros((0, self.identity.dimension))
        return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def embed_texts(self, texts: Sequence[str]) -> np.ndarray:
        return self._vectors([t.encode() for t in texts])

    def embed_images(self, images: Sequence[bytes]) -> np.ndarray:
        return self._vectors([bytes(i) for i in images])


def is_out_of_memory(error: BaseException) -> bool:
    """Whether a model failed for want of memory, by what it says."""
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


class BatchedEmbedder:
    """Runs a model in batches; where memory runs out the batch is halved, for good, and tried again. Order is kept."""

    def __init__(self, identity: Identity, model: Callable[[list], np.ndarray], batch_size: int = 4) -> None:
        self.identity, self.model, self.batch_size = identity, model, batch_size

    def embed(self, items: Sequence) -> np.ndarray:
        out, at = [], 0
        while at < len(items):
            part = list(items[at : at + self.batch_size])
            try:
                v = np.asarray(self.model(part), dtype=np.float32)
            except Exception as e:
                if self.batch_size == 1 or not is_out_of_memory(e):
                    raise
                self.batch_size = max(1, self.batch_size // 2)
                continue
            if v.shape != (len(part), self.identity.dimension):
                raise ValueError(f"the model gave {v.shape} for {len(part)} items")
            out.append(v)
            at += len(part)
        return np.concatenate(out) if out else np.zeros((0, self.identity.dimension), np.float32)

    embed_texts = embed_images = embed


class ServiceError(ConnectionError):
    """A refusal that may pass, with the status and what its Retry-After header says."""

    def __init__(self, status: int, retry_after: str | None = None) -> None:
        super().__init__(f"the service answered {status}")
        self.status, self.retry_after = status, retry_after


#: Answers that may be asked again, fixed values.
RETRIED = frozenset((429, *range(500, 600)))


def pause(error: ConnectionError, attempt: int) -> float:
    """Seconds before the next try: a numeric Retry-After, never below 0, else 2 to the attempt, 30 at most."""
    try:
        return max(0.0, float(getattr(error, "retry_after", None)))
    except (TypeError, ValueError):
        return min(30.0, 2.0**attempt)


class LimitedEmbedder:
    """Calls a remote service under rolling limits: the longest start of what is left that fits, reconciled with what it used; retries are admitted anew."""

    def __init__(self, identity: Identity, call: Callable[[list], tuple[np.ndarray, int]], cost: Callable[[object], int], limiter: RollingLimiter, clock: Callable[[], float], sleep: Callable[[float], None], batch_size: int = 16, attempts: int = 5) -> None:
        self.identity, self.call, self.cost, self.limiter, self.clock, self.sleep, self.batch_size, self.attempts = identity, call, cost, limiter, clock, sleep, batch_size, attempts

    def embed(self, items: Sequence) -> np.ndarray:
        out, left = [], list(items)
        while left:
            part = left[: self.batch_size]
            for attempt in range(1, self.attempts + 1):
                while (own := self.limiter.attempt(self.clock(), [self.cost(x) for x in part])) is None:
                    self.sleep(self.limiter.wait(self.clock()))
                part = part[: own.items]
                try:
                    v, used = self.call(part)
                except ConnectionError as e:
                    if attempt == self.attempts or getattr(e, "status", 429) not in RETRIED:
                        raise
                    self.sleep(pause(e, attempt))
                    continue
                self.limiter.reconcile(own, used)
                break
            out.append(np.asarray(v, dtype=np.float32))
            left = left[len(part) :]
        return np.concatenate(out) if out else np.zeros((0, self.identity.dimension), np.float32)

    embed_texts = embed_images = embed


def resolve_backend(wanted: str, available: dict[str, bool]) -> str:
    """auto takes the first of cuda, mlx and cpu that there is; one that is asked for by name must be there."""
    if wanted == "auto":
        return next(b for b in ("cuda", "mlx", "cpu") if available.get(b, b == "cpu"))
    if wanted not in ("cuda", "mlx", "cpu"):
        raise ValueError(f"unknown backend {wanted!r}")
    if not available.get(wanted, wanted == "cpu"):
        raise RuntimeError(f"backend {wanted} is not available")
    return wanted


def create_embedder(settings: EmbeddingSettings, engines: dict[str, Callable[[EmbeddingSettings], Embedder]] | None = None) -> Embedder:
    """The embedder that the settings name; engines are registered by who has their models. `hash` needs none."""
    known = {"hash": lambda _: HashEmbedder()} | (engines or {})
    if settings.engine in known:
        return known[settings.engine](settings)
    raise RuntimeError(f"no engine {settings.engine!r} is registered")


def divided(settings: EmbeddingSettings, tasks: int | None = None) -> EmbeddingSettings:
    """What one of so many tasks (by default as many as may call a service at once) may use of the limits, so that all together keep them."""
    n = tasks or settings.concurrency
    if settings.requests_per_minute < n or settings.tokens_per_minute < n:
        raise ValueError(f"limits are too small for {n} tasks")
    return replace(settings, requests_per_minute=settings.requests_per_minute // n, tokens_per_minute=settings.tokens_per_minute // n)


def embed_column(make: Callable[[], Embedder], kind: str = "texts") -> Callable[[Column], Column]:
    """A column function that embeds; the model is made once a task and fed in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = make()
        run = own.embed_texts if kind == "texts" else own.embed_images
        for part in parts:
            yield pd.Series(list(run(part.tolist())), index=part.index)

    return embed


def embed_regions(cells: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """Cropped regions with their vectors in the row, so that nothing has to be matched by position."""
    return cells.withColumn("vector", embed_column(make, "images")(F.col("rgb24"))).drop("rgb24")
