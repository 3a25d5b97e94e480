"""The table of visuals: Parquet by asset, a small description beside it, idempotent writes."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import point_id
from ..functions.vectors import check_query
from ..operators.joins import upserted, without_stale
from ..operators.ranking import first_of, scored, top_k
from ..schema import VISUAL, require_valid
from .journal import checked_uuid, write_json

SCHEMA_VERSION = 2


class IncompatibleStore(ValueError):
    """A table that another model or dataset has written."""


@dataclass(frozen=True)
class Identity:
    """What made the vectors."""

    model_id: str
    dimension: int
    preprocessing_version: int

    def row(self) -> tuple[str, int, int]:
        return self.model_id, self.dimension, self.preprocessing_version


class VisualStore:
    """Visuals below a folder: one Parquet partition for each asset, so a write replaces the assets that it touches and no others."""

    def __init__(self, spark: SparkSession, root: str, vector_name: str = "visual", distance: str = "cosine") -> None:
        self.spark, self.root, self.vector_name, self.distance = spark, root, vector_name, distance
        self.data, self.meta = os.path.join(root, "visuals"), os.path.join(root, "store.json")

    def description(self, identity: Identity, dataset: str, instance: str) -> dict:
        """The eight facts that a table is told by."""
        return {
            "schema_version": SCHEMA_VERSION, "dataset_instance_id": checked_uuid(dataset, "dataset_instance_id"), "index_instance_id": instance, "model_id": identity.model_id,
            "dimension": identity.dimension, "preprocessing_version": identity.preprocessing_version, "vector_name": self.vector_name, "distance": self.distance,
        }

    def ensure(self, identity: Identity, dataset: str) -> str:
        """Makes the table, or checks that it fits; returns the id of this instance of it."""
        if not os.path.exists(self.meta):
            instance = str(uuid.uuid4())
            write_json(self.meta, self.description(identity, dataset, instance))
            return instance
        return self.check(identity, dataset)

    def open(self, identity: Identity) -> str:
        """For reading only."""
        if not os.path.exists(self.meta):
            raise FileNotFoundError("there is no index here; run the index command first")
        return self.check(identity, None)

    def check(self, identity: Identity, dataset: str | None) -> str:
        with open(self.meta, encoding="utf-8") as f:
            own = json.load(f)
        # What the vectors are comes first, then what they are called.
        wanted = {"vector_name": self.vector_name, "dimension": identity.dimension, "distance": self.distance, "schema_version": SCHEMA_VERSION, "model_id": identity.model_id, "preprocessing_version": identity.preprocessing_version}
        if dataset is not None:
            wanted["dataset_instance_id"] = checked_uuid(dataset, "dataset_instance_id")
        for key, value in wanted.items():
            if own.get(key) != value:
                raise IncompatibleStore(f"{key} is {own.get(key)!r}, not {value!r}")
        return checked_uuid(own.get("index_instance_id"), "index_instance_id")

    def visuals(self) -> DataFrame:
        if not os.path.isdir(self.data):
            return self.spark.createDataFrame([], VISUAL).withColumn("point_id", F.lit(None).cast("string"))
        kinds = self.spark.createDataFrame([], VISUAL).withColumn("point_id", F.lit(None).cast("string")).schema
        return self.spark.read.schema(kinds).parquet(self.data)

    def upsert(self, visuals: DataFrame, identity: Identity) -> None:
        """Adds visuals, of equal ids the new one; every row is checked before anything is written."""
        new = require_valid(visuals, identity.row()).withColumn("point_id", point_id())
        new = first_of(new, ["point_id"], [F.xxhash64("vector"), F.col("region.scale")])  # of equal ids always the same one
        assets = new.select("asset_id").distinct()
        # Of the stored rows only those of the assets at hand are read and written again.
        old = self.visuals().join(F.broadcast(assets) if assets.count() <= 100_000 else assets, "asset_id", "left_semi")
        merged = upserted(old, new.select(old.columns))
        # Ranges rather than hashes of assets: a long video is dealt to many tasks, a short one stays in one file.
        held = os.path.join(self.root, f"pending-{uuid.uuid4().hex}")
        merged.write.parquet(held)  # the rows that replace must not be read from what they replace
        self.spark.read.schema(merged.schema).parquet(held).repartitionByRange("asset_id", "timestamp_us", "point_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_id").parquet(self.data)
        self._drop(held)

    def delete_stale(self, current: DataFrame) -> None:
        """Drops the visuals of older revisions of current(source_path, asset_id)."""
        old = self.visuals()
        gone = old.select("asset_id", "source_path").distinct()
        gone = gone.join(without_stale(gone, current), ["asset_id", "source_path"], "left_anti")
        for r in gone.select("asset_id").distinct().toLocalIterator():
            self._drop(os.path.join(self.data, f"asset_id={r['asset_id']}"))

    def search(self, query: list[float], limit: int, identity: Identity) -> DataFrame:
        """The nearest visuals by exact cosine."""
        return top_k(scored(self.visuals(), check_query(query, identity.dimension)), limit)

    def timeline(self, asset_id: str, start_us: int, end_us: int) -> DataFrame:
        """Visuals of one video between two times, both included: one partition is read."""
        if start_us < 0 or end_us < start_us:
            raise ValueError("a timeline window must be 0 <= start <= end")
        return self.visuals().filter((F.col("asset_id") == asset_id) & (F.col("media_type") == "video") & F.col("timestamp_us").between(start_us, end_us)).orderBy("timestamp_us", "point_id")

    def stage(self, rows: DataFrame, *apart: str) -> str:
        """Writes rows beside the visuals, in files by the columns apart; gives the path."""
        held = os.path.join(self.root, f"staged-{uuid.uuid4().hex}")
        rows.write.partitionBy(*apart).parquet(held)
        return held

    def unstage(self, held: str) -> None:
        self._drop(held)

    def _drop(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
