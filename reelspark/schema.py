"""Schemas of the data model, and its invariants as predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")] + [T.StructField("scale", T.DoubleType())])
VISUAL = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("sample_kind", T.StringType()),
        T.StructField("timestamp_seconds", T.DoubleType()),
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("region_kind", T.StringType()),
        T.StructField("region", REGION),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("model_id", T.StringType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("preprocessing_version", T.IntegerType()),
    ]
)
MEDIA = T.StructType([T.StructField("path", T.StringType()), T.StructField("media_type", T.StringType())])
COMPLETION = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("index_instance_id", T.StringType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
PROBE = "struct<streams array<struct<codec_name string, width int, height int, avg_frame_rate string, r_frame_rate string>>, format struct<duration string>>"
FRAMES = "struct<frames array<struct<key_frame int, best_effort_timestamp_time string>>>"


def is_asset_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_relative_path(c: Column) -> Column:
    """A normalised relative POSIX path."""
    parts = F.split(c, "/")
    return F.coalesce((c != "") & ~F.contains(c, F.lit("\\")) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def is_time(c: Column) -> Column:
    return is_finite(c) & (c >= 0)


def is_region(c: Column) -> Column:
    scale = c["scale"]
    return F.coalesce((c["x"] >= 0) & (c["y"] >= 0) & (c["width"] > 0) & (c["height"] > 0) & is_finite(scale) & (scale > 0) & (scale <= 1), F.lit(False))


def is_vector(v: Column, dimension: Column | int) -> Column:
    """As long as stated, all components finite; a zero vector may be stored."""
    size = F.lit(dimension) if isinstance(dimension, int) else dimension
    return F.coalesce((size > 0) & (F.size(v) == size) & F.forall(v, lambda x: is_finite(x)), F.lit(False))


def violations(visuals: DataFrame, identity: tuple[str, int, int] | None = None) -> Column:
    """Names of the invariants that a visual breaks, as an array; empty for a good row."""
    from .functions.times import to_microseconds

    c = {n: F.col(n) for n in visuals.columns}
    image, video = c["media_type"] == "image", c["media_type"] == "video"
    agrees = (image & (c["sample_kind"] == "image") & c["timestamp_seconds"].isNull()) | (video & (c["sample_kind"] == "keyframe") & c["timestamp_seconds"].isNotNull())
    region = c["region"]
    checks = {
        "asset_id": is_asset_id(c["asset_id"]),
        "source_path": is_relative_path(c["source_path"]),
        "timestamp": c["timestamp_seconds"].isNull() | is_time(c["timestamp_seconds"]),
        "media": agrees,
        "region": is_region(region),
        "full_region": (c["region_kind"] != "full") | ((region["x"] == 0) & (region["y"] == 0) & (region["scale"] == 1.0)),
        "region_kind": c["region_kind"].isin("full", "tile"),
        "vector": is_vector(c["vector"], c["dimension"]),
        "timestamp_us": c["timestamp_us"].eqNullSafe(F.when(c["timestamp_seconds"].isNull() | is_time(c["timestamp_seconds"]), to_microseconds(c["timestamp_seconds"]))),
    }
    if identity:
        model, dimension, version = identity
        checks["identity"] = (c["model_id"] == model) & (c["dimension"] == dimension) & (c["preprocessing_version"] == version)
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def require_valid(visuals: DataFrame, identity: tuple[str, int, int] | None = None) -> DataFrame:
    """The same rows; a malformed one fails the run when it is read, it is never dropped."""
    bad = violations(visuals, identity)
    said = F.concat(F.lit("invalid visual "), F.coalesce(F.col("source_path"), F.lit("?")), F.lit(": "), F.concat_ws(", ", bad))
    return visuals.filter(F.when(F.size(bad) == 0, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def result_violations(results: DataFrame) -> Column:
    """Names of the invariants that a search result breaks."""
    times = [F.col(f"{n}_seconds") for n in ("start", "representative", "end")]
    photo = (F.col("media_type") == "image") & times[0].isNull() & times[1].isNull() & times[2].isNull()
    video = (F.col("media_type") == "video") & (times[0] <= times[1]) & (times[1] <= times[2])
    checks = {"source_path": is_relative_path(F.col("source_path")), "score": is_finite(F.col("raw_score")), "times": photo | video}
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda x: x.isNotNull())
