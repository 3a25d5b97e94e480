"""Orders of matches and results, best rows of groups, top-K."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity, literal


def _region(*names: str) -> list[Column]:
    return [F.col(f"region.{n}") for n in names]


_BOX = ("x", "y", "width", "height")


def match_order() -> list[Column]:
    """Of regions at one time: score, path, kind, box; the scale doesn't count."""
    return [F.col("score").desc(), F.col("source_path"), F.col("region_kind"), *_region(*_BOX)]


def observation_order() -> list[Column]:
    """Of observations of a stream: the earlier of equal scores first."""
    return [F.col("score").desc(), F.col("timestamp_us"), *match_order()[1:]]


def anchor_order() -> list[Column]:
    """Of anchors of a neighbourhood: as observations, and by scale."""
    return [*observation_order(), F.col("region.scale")]


def photo_order() -> list[Column]:
    return [*match_order(), F.col("region.scale")]


def result_order() -> list[Column]:
    """The final order; photos have no times, which sort before all others."""
    none = F.lit(-1.0)
    return [
        F.col("raw_score").desc(), F.col("source_path"), F.coalesce("start_seconds", none), F.coalesce("representative_seconds", none), F.col("region_kind"),
        *_region(*_BOX), F.col("region.scale"),
    ]


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group: a window that Spark cuts to one row a group before and after its shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_by_timestamp(matches: DataFrame) -> DataFrame:
    """The best region of each (asset_id, timestamp_us)."""
    return first_of(matches, ["asset_id", "timestamp_us"], match_order())


def best_by_photo(matches: DataFrame) -> DataFrame:
    """The best region of each photo."""
    return first_of(matches.filter("media_type = 'image'"), ["asset_id"], photo_order())


def scored(visuals: DataFrame, query: Sequence[float]) -> DataFrame:
    """visuals with their exact cosine to the query as score; a malformed vector fails the run."""
    return visuals.withColumn("score", cosine_similarity(F.col("vector"), literal(query)))


def top_k(rows: DataFrame, k: int, tie: str = "point_id") -> DataFrame:
    """The k best by score, of equals those of the least id: each task keeps k rows."""
    return rows.orderBy(F.col("score").desc(), F.col(tie)).limit(k)


def ranked(rows: DataFrame, tie: str = "point_id") -> DataFrame:
    """Rows with candidate_rank from 1; for what top_k has bounded."""
    return rows.withColumn("candidate_rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col(tie))))


def batches(rows: DataFrame, size: int, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """rows with the number of their batch of so many, in order, for each key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("batch", F.floor((number - 1) / size).cast("long"))
