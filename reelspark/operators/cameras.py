"""Cameras: families of candidate playlists, their resolution and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import family_key, priority


def families(candidates: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """candidates(keys, url) grouped into families: urls by priority, the preferred one, and position from 1 by its name."""
    own = candidates.select(*keys, "url").distinct().withColumn("family", family_key(F.col("url")))
    grouped = own.groupBy(*keys, "family").agg(F.transform(F.array_sort(F.collect_list(priority(F.col("url")))), lambda p: p["url"]).alias("urls"))
    grouped = grouped.withColumn("preferred", F.element_at("urls", 1))
    return grouped.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("preferred")))


def resolved(groups: DataFrame, probes: DataFrame, observed: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """The stream of each family: keys, position, stream_url, bandwidth, width, height.

    probes(url, ok, stream_url, bandwidth, width, height) says what asking for a url gave. Asked are the preferred url,
    then those that a browser saw; the first that answers counts. If none does, the best url that a browser saw is kept as it is;
    a family that only static text names is dropped. Streams that several families lead to count once, for the first.
    """
    url = groups.select(*keys, "family", "position", F.posexplode("urls").alias("at", "url"))
    seen = observed.select(*keys, "url").distinct().withColumn("seen", F.lit(True))
    url = url.join(seen, [*keys, "url"], "left").join(probes, "url", "left")
    asked = (F.col("at") == 0) | F.col("seen")
    rank = F.when(asked & F.coalesce("ok", F.lit(False)), F.lit(0)).when(F.col("seen"), F.lit(1))
    stream = F.struct(
        F.when(rank == 0, F.coalesce("stream_url", "url")).otherwise(F.col("url")).alias("stream_url"),
        F.when(rank == 0, F.coalesce("bandwidth", F.lit(0))).otherwise(F.lit(0)).alias("bandwidth"),
        F.when(rank == 0, F.col("width")).alias("width"),
        F.when(rank == 0, F.col("height")).alias("height"),
    )
    usable = url.withColumn("rank", rank).filter("rank is not null")
    best = usable.groupBy(*keys, "family", "position").agg(F.min_by(stream, F.struct("rank", "at")).alias("s")).select(*keys, "position", "s.*")
    first = F.row_number().over(Window.partitionBy(*keys, "stream_url").orderBy("position"))
    return best.withColumn("_n", first).filter("_n = 1").drop("_n")


def numbered(streams: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Streams with camera_id by the order of their urls, from camera-001."""
    return streams.withColumn("camera_id", F.format_string("camera-%03d", F.row_number().over(Window.partitionBy(*keys).orderBy("stream_url"))))


def camera_of(cameras: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("source_id", "camera_id")) -> DataFrame:
    """Each wanted camera with its stream, or none."""
    return wanted.join(cameras, list(keys), "left")


def discovery_json(cameras: DataFrame, sources: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A row for each source, in its order: the JSON of its cameras; an error shows only where no camera was found."""
    listed = cameras.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("camera_id", "stream_url", "bandwidth", F.when(F.col("width").isNotNull(), F.array("width", "height")).alias("resolution")))).alias("cameras")
    )
    out = sources.join(listed, F.col("id") == F.col("source_id"), "left").drop("source_id")
    out = out.withColumn("cameras", F.coalesce("cameras", F.array().cast(listed.schema["cameras"].dataType)))
    if errors is not None:
        out = out.join(errors.select(F.col("source_id").alias("_id"), "error"), F.col("id") == F.col("_id"), "left").drop("_id")
        out = out.withColumn("error", F.when(F.size("cameras") == 0, F.col("error")))
    shown = [c for c in out.columns if c != "position"]
    return out.select("position", F.to_json(F.struct(*shown)).alias("json")).orderBy("position")


def outcome(returncode: Column) -> Column:
    """What a recorder does after a slice: go on, or wait and look for the stream again."""
    return F.when(returncode == 0, F.lit("continue")).otherwise(F.lit("rediscover"))
