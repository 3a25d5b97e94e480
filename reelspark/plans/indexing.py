"""Restartable indexing: media below a folder become visuals in a store; a journal names what is done."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.identity import asset_id, relative_to
from ..functions.regions import crop_frames, explode_regions, region_list
from ..functions.times import to_microseconds
from ..operators.joins import pending, skipped
from ..schema import VISUAL
from ..session import Settings
from ..sources import journal, media
from ..sources.store import Identity, VisualStore
from .embedding import Embedder, embed_regions

#: Stages of an asset, in order; a failure names one.
STAGES = ("identity", "delete", "probe", "decode", "sampling", "regions", "embedding", "upsert", "manifest")


@dataclass
class IndexRun:
    """What a run did."""

    indexed: int = 0
    skipped: int = 0
    failures: list[tuple[str, str, str]] = field(default_factory=list)  # path, stage, message

    @property
    def failed(self) -> int:
        return len(self.failures)

    @property
    def exit_code(self) -> int:
        return int(bool(self.failures))

    def text(self) -> str:
        lines = [f"Indexed: {self.indexed}", f"Skipped: {self.skipped}", f"Failed: {self.failed}"]
        for path, stage, message in self.failures:
            lines += ["", f"FAILED {path} [{stage}]", f"  {message}"]
        return "\n".join(lines)


def assets(spark: SparkSession, root: str) -> DataFrame:
    """Media files with their identity: path, media_type, source_path, asset_id."""
    base = os.path.realpath(root)
    rows = media.scan(spark, base).withColumn("source_path", relative_to(F.col("path"), base))
    return rows.withColumn("asset_id", asset_id(F.col("file_size"), F.col("mtime_ns"), F.col("source_path")))


def visuals_of(frames: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """frames(asset_id, source_path, media_type, timestamp_seconds, width, height, rgb24) as visuals, one for each region."""
    identity = make().identity
    cells = crop_frames(explode_regions(media.checked_frames(frames)).select(*frames.columns, "region_kind", "region"))
    rows = embed_regions(cells, make)
    kind = F.when(F.col("media_type") == "image", F.lit("image")).otherwise(F.lit("keyframe"))
    rows = rows.withColumn("sample_kind", kind).withColumn("timestamp_us", to_microseconds(F.col("timestamp_seconds")))
    rows = rows.withColumn("model_id", F.lit(identity.model_id)).withColumn("dimension", F.lit(identity.dimension)).withColumn("preprocessing_version", F.lit(identity.preprocessing_version))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in VISUAL])


#: Completions that are written to the journal at once.
JOURNAL_ROWS = 1000
_ROW = T.StructType([f for f in VISUAL if f.name not in ("sample_kind", "timestamp_us", "model_id", "dimension", "preprocessing_version")])
_OUTCOME = T.StructType([*_ROW, T.StructField("stage", T.StringType()), T.StructField("error", T.StringType())])


def sampled(todo: DataFrame, make: Callable[[], Embedder], settings: Settings, frames: Callable[..., Iterator] = media.frames_of) -> DataFrame:
    """todo(path, media_type, source_path, asset_id, width, height, error) as rows of regions with vectors, or a row with stage and error.

    Each task goes asset by asset and holds one frame of it at a time, whose regions are embedded in batches; whatever fails ends that asset alone.
    """
    ffprobe, ffmpeg, size = settings.ffprobe, settings.ffmpeg, settings.visual_batch_size

    def regions_of(asset: dict, own: Embedder) -> Iterator[list[dict]]:
        stage = "probe"
        try:
            if asset["error"]:
                raise media.StageError(stage, asset["error"])
            for t, width, height, data in frames(asset["path"], asset["media_type"], asset["width"], asset["height"], ffprobe, ffmpeg):
                stage = "regions"
                image = np.frombuffer(data, np.uint8).reshape(height, width, 3)
                cells = region_list(width, height)
                for at in range(0, len(cells), size):
                    part = cells[at : at + size]
                    stage = "regions"
                    crops = [image[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]].tobytes() for _, r in part]
                    stage = "embedding"
                    vectors = own.embed_images(crops)
                    yield [{"timestamp_seconds": t, "region_kind": kind, "region": r, "vector": [float(x) for x in v]} for (kind, r), v in zip(part, vectors, strict=True)]
                stage = "sampling"
        except media.StageError as e:
            yield [{"stage": e.stage, "error": e.message}]
        except Exception as e:
            yield [{"stage": stage if stage != "probe" else "decode", "error": str(e) or type(e).__name__}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own = to_arrow_schema(_OUTCOME), make()
        for batch in batches:
            for asset in batch.to_pylist():
                named = {k: asset[k] for k in ("asset_id", "source_path", "media_type")}
                for rows in regions_of(asset, own):
                    yield pa.RecordBatch.from_pylist([named | r for r in rows], schema=schema)

    return todo.select("path", "media_type", "source_path", "asset_id", "width", "height", "error").mapInArrow(run, _OUTCOME)


def completed_visuals(rows: DataFrame, identity: Identity) -> DataFrame:
    """Rows of sampled() without failures, as visuals."""
    kind = F.when(F.col("media_type") == "image", F.lit("image")).otherwise(F.lit("keyframe"))
    rows = rows.withColumn("sample_kind", kind).withColumn("timestamp_us", to_microseconds(F.col("timestamp_seconds")))
    rows = rows.withColumn("model_id", F.lit(identity.model_id)).withColumn("dimension", F.lit(identity.dimension)).withColumn("preprocessing_version", F.lit(identity.preprocessing_version))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in VISUAL])


def run(
    spark: SparkSession, root: str, store: VisualStore, make: Callable[[], Embedder], decode: Callable[[DataFrame], DataFrame] | None = None, state: str = ".reelspark",
    settings: Settings | None = None, say: Callable[[str], None] = lambda text: None, tasks: int | None = None,
) -> IndexRun:
    """Indexes what isn't done yet: probes, samples, cuts and embeds each pending asset, or takes decode's frames instead.

    decode turns pending assets into frames; assets that it can't read have a row with an error. Outcomes are staged in the store, so that an asset
    is decoded once; visuals of assets without failure are then merged in, and the journal is written last. Ids are deterministic: a run that was cut off
    writes the same ids again. A bad asset becomes a failure that names its stage, and the others go on. say is told how far the run is. tasks fixes how many
    tasks embed, each with an embedder of its own: for services whose limits are divided among them.
    """
    settings = settings or Settings()
    identity = make().identity
    instance = store.ensure(identity, journal.dataset_identity(root, state))
    path = os.path.join(root, state, "completed.jsonl")
    done = journal.completed(spark, path, instance)
    every = assets(spark, root).persist()
    out = IndexRun(skipped=skipped(every, done).count())
    todo = pending(every, done).persist()
    say(f"{todo.count()} to index, {out.skipped} done before")
    store.delete_stale(todo.select("source_path", "asset_id"))
    if decode is None:
        probed = media.parse_probe(media.probe(todo, settings.ffprobe)).select("path", "width", "height", "error")
        ready = todo.join(probed, "path")
        rows = sampled(ready.repartition(tasks) if tasks else ready, make, settings)
    else:
        frames = decode(todo)
        failed = F.col("error") if "error" in frames.columns else F.lit(None).cast("string")
        bad = frames.filter(failed.isNotNull()).select("asset_id", "source_path", "media_type", F.lit("decode").alias("stage"), failed.alias("error"))
        rows = visuals_of(frames.filter(failed.isNull()).drop("error"), make).select(*_ROW.names).unionByName(bad, allowMissingColumns=True).select(*_OUTCOME.names)
    # Failures lie in files of their own, so that no check of a visual is ever pushed down to them.
    held = store.stage(rows.withColumn("failed", F.col("error").isNotNull()), "failed")
    staged = spark.read.schema(T.StructType([*_OUTCOME, T.StructField("failed", T.BooleanType())])).parquet(held)
    bad = staged.filter("failed").groupBy("source_path", "asset_id").agg(F.min(F.struct("stage", "error")).alias("e")).select("source_path", "asset_id", "e.*").persist()
    store.upsert(completed_visuals(staged.filter("not failed").join(bad.select("asset_id"), "asset_id", "left_anti"), identity), identity)
    store.unstage(held)
    out.failures = [(r["source_path"], r["stage"], r["error"]) for r in bad.orderBy("source_path").toLocalIterator()]
    good = todo.join(bad.select("asset_id"), "asset_id", "left_anti").select("asset_id", "source_path").orderBy("source_path").toLocalIterator()
    while part := list(islice(good, JOURNAL_ROWS)):
        journal.mark_completed(path, instance, *[(r["asset_id"], r["source_path"]) for r in part])
        out.indexed += len(part)
        say(f"{out.indexed} indexed")
    for held_rows in (bad, todo, every):
        held_rows.unpersist()
    return out


def summary(outcomes: DataFrame) -> DataFrame:
    """One row of outcomes(status): indexed, skipped, failed, exit_code."""
    of = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(of("indexed").alias("indexed"), of("skipped").alias("skipped"), of("failed").alias("failed"), (of("failed") > 0).cast("int").alias("exit_code"))
