"""Session and settings."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession


def build_session(app: str = "reelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the semantics that the operators count on: UTC, ANSI, adaptive execution with skew joins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _positive(name: str, value: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer")


@dataclass(frozen=True)
class SearchSettings:
    """What a search returns and how its passages are cut."""

    result_limit: int = 10
    candidate_limit: int = 200
    candidate_max_limit: int = 2000
    context_seconds: float = 15.0
    max_window_seconds: float = 60.0
    moving_average_frames: int = 3

    def __post_init__(self) -> None:
        for name in ("result_limit", "candidate_limit", "candidate_max_limit", "moving_average_frames"):
            _positive(name, getattr(self, name))
        if self.candidate_max_limit < self.candidate_limit:
            raise ValueError("candidate_max_limit must not be below candidate_limit")
        if not 0 < self.context_seconds < float("inf"):
            raise ValueError("context_seconds must be positive and finite")
        if not self.max_window_seconds >= 2 * self.context_seconds:
            raise ValueError("max_window_seconds must be at least twice context_seconds")
        if self.moving_average_frames % 2 == 0:
            raise ValueError("moving_average_frames must be odd")


@dataclass(frozen=True)
class EmbeddingSettings:
    """Which engine embeds, and its limits."""

    engine: str = "local"
    batch_size: int = 4
    requests_per_minute: int = 100
    tokens_per_minute: int = 100_000
    concurrency: int = 2
    backend: str = "auto"

    def __post_init__(self) -> None:
        if self.engine not in ("local", "api", "hash"):
            raise ValueError(f"unknown embedding engine {self.engine!r}")
        for name in ("batch_size", "requests_per_minute", "tokens_per_minute", "concurrency"):
            _positive(name, getattr(self, name))


@dataclass(frozen=True)
class Settings:
    search: SearchSettings = field(default_factory=SearchSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    visual_batch_size: int = 20
    data_dir: str = "data"
    ffmpeg: str = "ffmpeg"
    ffprobe: str = "ffprobe"

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None, prefix: str = "REEL_") -> Settings:
        """Settings from PREFIX_GROUP__NAME variables; what isn't set keeps its default."""
        env = os.environ if environ is None else environ
        groups: dict[str, dict] = {"search": {}, "embedding": {}}
        own: dict = {}
        kinds = {"search": SearchSettings, "embedding": EmbeddingSettings}
        for key, raw in env.items():
            if not key.upper().startswith(prefix):
                continue
            group, _, name = key[len(prefix) :].lower().rpartition("__")
            known = {f.name: f for f in fields(kinds[group] if group in kinds else cls)}
            if name not in known or (group and group not in kinds):
                continue
            like = getattr(kinds[group]() if group else cls(), name)
            (groups[group] if group else own)[name] = type(like)(raw)
        return cls(search=SearchSettings(**groups["search"]), embedding=EmbeddingSettings(**groups["embedding"]), **own)


@contextmanager
def closing_all(*resources: object) -> Iterator[None]:
    """Closes what has a close(), last first, whatever happens. A failure of the body is what is raised, failures of closing are noted on it; else the first of these is raised."""
    first: BaseException | None = None
    try:
        yield
    except BaseException as e:
        first = e
        raise
    finally:
        late: BaseException | None = None
        for r in reversed(resources):
            try:
                if callable(getattr(r, "close", None)):
                    r.close()
            except Exception as e:
                late = late or e
                if first is not None:
                    first.add_note(f"closing failed too: {e}")
        if first is None and late is not None:
            raise late
