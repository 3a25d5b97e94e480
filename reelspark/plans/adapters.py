"""The shared test tables seen as this engine's entities, in DataFrames and, word for word the same, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..schema import REGION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its times, which name no zone, are UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = [f.name for f in rows.schema if f.dataType == TimestampNTZType()]
    return rows.withColumns({c: F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")) for c in local}) if local else rows


def visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as visuals: a hundred vectors an asset, two regions a second, every fifth asset a photo."""
    rows = table(spark, sf_dir, "embeddings")
    no, k = F.floor(F.col("vec_id") / 100), F.col("vec_id") % 100
    image = no % 5 == 4
    tile = k % 2
    box = [F.lit(0) + 100 * tile, F.lit(0) + 50 * tile, F.lit(1920) - 960 * tile, F.lit(1080) - 540 * tile]
    return rows.select(
        F.sha2(no.cast("string").cast("binary"), 256).alias("asset_id"),
        F.concat(F.lit("media/asset-"), no.cast("string"), F.when(image, F.lit(".jpg")).otherwise(F.lit(".mkv"))).alias("source_path"),
        F.when(image, F.lit("image")).otherwise(F.lit("video")).alias("media_type"),
        F.when(image, F.lit("image")).otherwise(F.lit("keyframe")).alias("sample_kind"),
        F.when(~image, F.floor(k / 2).cast("double")).alias("timestamp_seconds"),
        F.when(~image, F.floor(k / 2) * 1_000_000).alias("timestamp_us"),
        F.when(tile == 1, F.lit("tile")).otherwise(F.lit("full")).alias("region_kind"),
        F.struct(*[c.cast("int").alias(n) for n, c in zip(("x", "y", "width", "height"), box, strict=True)], (F.lit(1.0) - 0.5 * tile).alias("scale")).cast(REGION).alias("region"),
        F.col("embedding").alias("vector"),
        F.lit("demo").alias("model_id"),
        F.size("embedding").alias("dimension"),
        F.lit(1).alias("preprocessing_version"),
        F.col("vec_id").alias("point_id"),
    )


VISUALS = """
v AS (SELECT sha256((vec_id // 100)::VARCHAR) AS asset_id,
  'media/asset-' || (vec_id // 100) || CASE WHEN (vec_id // 100) % 5 = 4 THEN '.jpg' ELSE '.mkv' END AS source_path,
  CASE WHEN (vec_id // 100) % 5 = 4 THEN 'image' ELSE 'video' END AS media_type,
  CASE WHEN (vec_id // 100) % 5 <> 4 THEN ((vec_id % 100) // 2) * 1000000 END AS timestamp_us,
  CASE WHEN vec_id % 2 = 1 THEN 'tile' ELSE 'full' END AS region_kind,
  100 * (vec_id % 2) AS x, 50 * (vec_id % 2) AS y, 1920 - 960 * (vec_id % 2) AS width, 1080 - 540 * (vec_id % 2) AS height,
  1.0::DOUBLE - 0.5 * (vec_id % 2) AS scale, vec_id AS point_id, embedding::DOUBLE[] AS vector
  FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id = 0),
m AS (SELECT v.*, list_cosine_similarity(v.vector, q.vector) AS score FROM v, q)
"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector, as what is looked for."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of streams: the user is the stream, the value the score."""
    region = F.struct(*[F.lit(0).alias(n) for n in ("x", "y", "width", "height")], F.lit(1.0).alias("scale")).cast(REGION)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("asset_id"), F.col("event_type").alias("source_path"), F.unix_micros("ts").alias("timestamp_us"), F.col("value").alias("score"), F.lit("full").alias("region_kind"), region.alias("region"), "event_id"
    )


OBSERVATIONS = "o AS (SELECT user_id AS asset_id, event_type AS source_path, epoch_us(ts) AS timestamp_us, value AS score, event_id FROM events)"
