"""Neighbourhoods of hits in time: merged, cut, and joined with what lies in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import duration_microseconds
from .ranking import anchor_order

STREAM = ("asset_id", "source_path")


def _expanded(seeds: DataFrame, context_us: int) -> DataFrame:
    return seeds.withColumn("_s", F.greatest(F.lit(0), F.col("timestamp_us") - context_us)).withColumn("_e", F.col("timestamp_us") + context_us)


def islands(rows: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """rows with _island: closed intervals that touch or overlap share one, for each key."""
    own = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("_open", opens).withColumn("_island", F.sum("_open").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")


#: Stream time that one task merges at first; a stream of any length is dealt to many.
BUCKET_US = 3_600_000_000


def _unions(seeds: DataFrame, context_us: int, keys: Sequence[str]) -> DataFrame:
    """keys, _s, _e and best (order and row of the best seed) of each union of expanded seeds.

    Unions are made for each hour of a stream first, then of what these left: merging intervals may be done in any order,
    and only the unions of a long stream meet in one task, not its hits.
    """
    columns = [c for c in seeds.columns if c not in keys]
    own = _expanded(seeds, context_us).withColumn("_b", F.floor(F.col("timestamp_us") / BUCKET_US))
    own = own.withColumn("best", F.struct(F.struct(*_sortable(anchor_order())).alias("order"), F.struct(*columns).alias("row")))
    for near in ([*keys, "_b"], [*keys]):
        own = islands(own, "_s", "_e", near).groupBy(*near, "_island")
        own = own.agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.min_by("best", F.col("best.order")).alias("best")).drop("_island")
    return own


def neighborhoods(seeds: DataFrame, context_seconds: float, keys: Sequence[str] = STREAM) -> DataFrame:
    """Logical neighbourhoods of any length: keys, start_us, end_us and the best seed as anchor."""
    own = _unions(seeds, duration_microseconds(context_seconds), keys)
    return own.select(*keys, F.col("_s").alias("start_us"), F.col("_e").alias("end_us"), F.col("best.row").alias("anchor"))


def _sortable(order: Sequence[Column]) -> list[Column]:
    """The same order as ascending values: the score comes first and is turned round."""
    return [(-F.col("score")).alias("o0"), *[c.alias(f"o{i}") for i, c in enumerate(order[1:], 1)]]


def windows(seeds: DataFrame, context_seconds: float, max_seconds: float, keys: Sequence[str] = STREAM) -> DataFrame:
    """Bounded windows: the same unions cut into pieces of at most so many seconds, each a microsecond after the last."""
    longest = duration_microseconds(max_seconds)
    whole = _unions(seeds, duration_microseconds(context_seconds), keys).select(*keys, F.col("_s").alias("s"), F.col("_e").alias("e"))
    pieces = whole.select(*keys, "e", F.explode(F.sequence("s", "e", F.lit(longest + 1))).alias("start_us"))
    return pieces.select(*keys, "start_us", F.least(F.col("start_us") + longest, F.col("e")).alias("end_us"))


def refinement(start: Column, end: Column, anchor: Column, max_us: int) -> tuple[Column, Column]:
    """The part of a neighbourhood that is read again: all of it, or so much of it around its anchor."""
    first = F.greatest(start, anchor - max_us // 2)
    first = F.least(first, end - max_us)
    fits = end - start <= max_us
    return F.when(fits, start).otherwise(first), F.when(fits, end).otherwise(first + max_us)


def refined(areas: DataFrame, max_seconds: float) -> DataFrame:
    """Neighbourhoods with window_start_us and window_end_us."""
    s, e = refinement(F.col("start_us"), F.col("end_us"), F.col("anchor.timestamp_us"), duration_microseconds(max_seconds))
    return areas.withColumn("window_start_us", s).withColumn("window_end_us", e)


#: Neighbourhoods that are broadcast at most; beyond, the join hashes by time bucket.
BROADCAST_WINDOWS = 100_000


def within(areas: DataFrame, rows: DataFrame, max_us: int, keys: Sequence[str] = STREAM, few: bool | None = None) -> DataFrame:
    """rows whose timestamp_us lies in a window of their stream: columns of both, the window's under `area`.

    Few windows (by count, unless told) are broadcast. Many are joined by stream and time bucket as wide as the longest
    window, so that a long stream is dealt to many tasks and each row meets the windows of its own bucket only.
    """
    area = areas.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*areas.columns).alias("area"))
    inside = F.col("timestamp_us").between(F.col("area.window_start_us"), F.col("area.window_end_us"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    if few if few is not None else areas.count() <= BROADCAST_WINDOWS:
        joined = rows.join(F.broadcast(area), [*same, inside])
    else:
        wide = max(1, max_us)
        bucket = lambda c: F.floor(c / wide).cast("long")
        area = area.withColumn("_b", F.explode(F.sequence(bucket(F.col("area.window_start_us")), bucket(F.col("area.window_end_us")))))
        joined = rows.withColumn("_bucket", bucket(F.col("timestamp_us"))).join(area, [*same, F.col("_bucket") == F.col("_b"), inside]).drop("_b", "_bucket")
    return joined.drop(*[f"_{k}" for k in keys])
