"""Joins that the indexing and acquisition planes are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(assets: DataFrame, done: DataFrame) -> DataFrame:
    """Assets that no completion names."""
    return assets.join(done.select("asset_id"), "asset_id", "left_anti")


def skipped(assets: DataFrame, done: DataFrame) -> DataFrame:
    return assets.join(done.select("asset_id").distinct(), "asset_id", "left_semi")


def without_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored rows less those of older revisions: same path, another asset."""
    new = current.select(F.col("source_path").alias("_path"), F.col("asset_id").alias("_asset"))
    return stored.join(new, (F.col("source_path") == F.col("_path")) & (F.col("asset_id") != F.col("_asset")), "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows of both; of equal keys the new one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def zipped(left: Column, right: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    """Items of two arrays by position; unequal lengths fail."""
    both = F.arrays_zip(left.alias(names[0]), right.alias(names[1]))
    return F.when(F.size(left) == F.size(right), both).otherwise(F.raise_error(F.lit("positional join of unequal lengths")))


def by_index(items: Column, count: Column) -> Column:
    """Response items (structs with index) in the order of their requests; a repeated, missing or foreign index fails."""
    order = F.array_sort(F.transform(items, lambda x: x["index"]))
    good = F.coalesce((F.size(items) == count) & (order == F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))), F.lit(False))
    return F.when(good, F.array_sort(items, lambda a, b: a["index"] - b["index"])).otherwise(F.raise_error(F.lit("response indexes must be 0 to n - 1, each once")))


def first_per(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position; order is kept by position."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(position)).alias("_r")).select(key, "_r.*")


def seen_merge(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """New rows with first_seen kept from the old ones and last_seen renewed."""
    kept = old.select(key, F.col("first_seen").alias("_first"))
    return new.join(kept, key, "left").withColumn("first_seen", F.coalesce("_first", now)).withColumn("last_seen", now).drop("_first")
