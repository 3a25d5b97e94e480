"""The completion journal: append-only JSON lines, read with tolerance for a torn last line; dataset identity; atomic JSON."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMPLETION, is_asset_id, is_relative_path

VERSION = 1


class JournalError(ValueError):
    """A journal or identity that can't be trusted."""


def write_json(path: str, value: dict) -> None:
    """JSON with sorted keys, put in place as a whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.unlink(part)
        raise


def checked_uuid(value: str, name: str) -> str:
    try:
        return str(uuid.UUID(value))
    except (AttributeError, TypeError, ValueError):
        raise JournalError(f"{name} must be a UUID, not {value!r}") from None


def dataset_identity(root: str, state: str = ".reelspark") -> str:
    """The id of the dataset below a root; made once, kept in a file."""
    if not os.path.isdir(root):
        raise JournalError(f"{root} is not a folder")
    path = os.path.join(root, state, "dataset.json")
    if not os.path.exists(path):
        write_json(path, {"schema_version": VERSION, "dataset_instance_id": str(uuid.uuid4())})
    try:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        if set(own) != {"schema_version", "dataset_instance_id"} or own["schema_version"] != VERSION:
            raise JournalError(f"{path} has another form")
        return checked_uuid(own["dataset_instance_id"], "dataset_instance_id")
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise JournalError(f"{path} can't be read") from e


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All completions in a journal file. Blank lines don't count; a broken last line is ignored; any other fails here, with its line number.

    A long journal is read by many tasks. A line's place is where its part of the file begins and its place there; the file is checked as a whole before
    anything is made of it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line")).alias("place")
    lines = spark.read.text(path, lineSep="\n").select(place, F.col("value").alias("line"))
    r = F.from_json("line", COMPLETION, {"mode": "PERMISSIVE"})
    form = F.coalesce(F.array_sort(F.json_object_keys("line")) == F.array(*[F.lit(x) for x in sorted(COMPLETION.names)]), F.lit(False))
    uuid_like = r["index_instance_id"].rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    good = F.coalesce(form & (r["schema_version"] == VERSION) & (r["status"] == "completed") & uuid_like & is_asset_id(r["asset_id"]) & is_relative_path(r["source_path"]), F.lit(False))
    rows = lines.filter(F.trim(F.col("line")) != "").select("place", r.alias("r"), good.alias("good"))
    ends = rows.agg(F.max("place").alias("last"), F.min(F.when(~F.col("good"), F.col("place"))).alias("bad")).first()
    if ends["bad"] is not None and ends["bad"] != ends["last"]:
        before = F.struct(*[F.lit(x).cast("long").alias(n) for n, x in ends["bad"].asDict().items()])
        raise JournalError(f"corrupt journal {path} at line {lines.filter(F.col('place') <= before).count()}")
    return rows.filter("good").select("r.*")


def completed(spark: SparkSession, path: str, instance: str) -> DataFrame:
    """asset_id of what one index instance has completed; empty if there is no journal."""
    instance = checked_uuid(instance, "index_instance_id")
    if not os.path.exists(path):
        return spark.createDataFrame([], "asset_id string")
    return read_journal(spark, path).filter(F.lower("index_instance_id") == instance).select("asset_id").distinct()


def mark_completed(path: str, instance: str, *assets: tuple[str, str]) -> None:
    """Appends the completions of assets (asset_id, source_path) in one write and waits until they are on disk; cut off, it leaves one torn line at the end."""
    instance = checked_uuid(instance, "index_instance_id")
    lines = []
    for asset_id, source_path in assets:
        if not re.fullmatch("[0-9a-f]{64}", asset_id) or not source_path or source_path.startswith("/"):
            raise JournalError(f"invalid completion of {source_path!r}")
        lines.append(json.dumps({"schema_version": VERSION, "index_instance_id": instance, "asset_id": asset_id, "source_path": source_path, "status": "completed"}, ensure_ascii=False) + "\n")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(lines))
        f.flush()
        os.fsync(f.fileno())
