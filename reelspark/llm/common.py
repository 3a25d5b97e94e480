"""Shared pieces of the training-data operators: Arrow mapping, vectorised word hashing, checkpoints."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Multipliers of a 64-bit finaliser (splitmix64), fixed values.
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned integers."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _GOLD)
_POW = np.ones(1, dtype=np.uint64)
_NEG = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; tables grow by doubling."""
    global _POW, _NEG
    if len(_POW) < n:
        size = 1 << max(14, (n - 1).bit_length())
        step, back = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INV, dtype=np.uint64)
        step[0] = back[0] = 1
        _POW, _NEG = np.cumprod(step), np.cumprod(back)
    return _POW, _NEG


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike wherever the span stands."""
    power, negative = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * negative[starts])


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate(([0], edge))
    if len(flag) and flag[-1]:
        edge = np.concatenate((edge, [len(flag)]))
    return edge[0::2], edge[1::2]


_SEGMENT = 1 << 17


def _segments(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about 128 KB that end where a word ends, so that tables stay small."""
    at = 0
    while len(data) - at > _SEGMENT:
        cut = next((m.end() for m in re.compile(rb"\s").finditer(data, at + _SEGMENT)), len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, lower case, split at ASCII white space; null has none."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    found = []
    for part in _segments(text.lower().encode("utf-8", "surrogatepass")):
        data = np.frombuffer(part, dtype=np.uint8)
        found.append(span_hashes(data, *runs(~WHITE[data])))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; a text of fewer words has one shingle of all of them, one without words none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out + words[i : len(words) - k + 1 + i]) * _M1
        out ^= out >> _U(29)
    return mix(out)


#: Rows of an Arrow batch; so a batch of long texts fits a worker, and the JVM's buffers stay small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(df: DataFrame, columns: dict[str, Column], fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """Only the named columns of df, mapped batch by batch: fn gets an iterator of {name: list} and yields dicts of lists.

    Everything else in df is pruned from the scan and can't clash with a name that is used here.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = StructType.fromDDL(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out_schema)
        for out in fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, out_schema)


def bounded(batch: dict, key: str = "text", size: int = 8 << 20) -> Iterator[dict]:
    """The rows of a batch in parts whose texts have about size characters; a longer text stands alone."""
    texts, at, total = batch[key], 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > size:
            yield {k: v[at:i] for k, v in batch.items()}
            at, total = i, 0
        total += len(t or "")
    if at < len(texts) or not texts:
        yield {k: v[at:] for k, v in batch.items()}


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from what made it: a table in the shared checkpoint folder, so that lost executors lose no work.

    A table rather than checkpoint(), because a checkpoint keeps the constraints of its plan, which grow without bound in loops.
    """
    return written(df, "cut")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder; of narrow rows, where their number is known, in files of fitting size."""
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(8, -(-rows // FILE_ROWS)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of this machine in local mode; a cluster must name one that all share."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


#: Most rows of a few numbers each that are broadcast; checked by counting. Beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of such tables that a file should hold, about.
FILE_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Nodes that a task joins before it gives what it has; it bounds memory, not results.
FOREST_NODES = 1_000_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) that join what the given ones join: of each task's edges a spanning forest, so a dense group leaves no more edges than nodes a task."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := top.setdefault(x, x)) != x:
                top[x] = x = top[up]
            return x

        def joined() -> dict:
            own = [(x, find(x)) for x in list(top)]
            return {"a": [x for x, y in own if x != y], "b": [y for x, y in own if x != y]}

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a, b = find(a), find(b)
                top[max(a, b)] = min(a, b)
            if len(top) > FOREST_NODES:
                yield joined()
                top.clear()
        yield joined()

    return map_texts(edges, {"a": F.col("a"), "b": F.col("b")}, run, "a long, b long")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): a row (id, component) for each id that has an edge, component the smallest id.

    Each round every node goes over to the neighbour (or itself) that comes first, and edges are drawn between what
    remains. First is the least id in the first round, which settles stars around a least id at once, later the least of
    a hash drawn anew, so that the count of nodes falls by a constant factor whatever the shape. Minima are partly made
    before the shuffle; where the nodes are few (counted) they are broadcast, else joined by shuffle, and a node with very
    many edges meets one row there, which adaptive execution splits. Nothing but counts comes to the driver.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    home, left = None, edges.count()
    for turn in range(rounds):
        if not left:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn else F.lit(0)).alias("h"), c.alias("n"))
        step = both.groupBy(F.col("a").alias("id")).agg(F.min(order(F.col("b"))).alias("m")).select("id", F.least(F.col("m"), order(F.col("id"))).getField("n").alias("to"))
        step = written(step, "step", 2 * left)
        near = small(step)
        home = step if home is None else checkpointed(
            home.join(near.withColumnRenamed("id", "k").withColumnRenamed("to", "t"), F.col("to") == F.col("k"), "left").select("id", F.coalesce("t", "to").alias("to"))
        )
        x, y = near.select(F.col("id").alias("a"), F.col("to").alias("ta")), near.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        edges = written(
            edges.join(x, "a").join(y, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges", left
        )
        left = edges.count()
        if not left and not turn:
            return home.select("id", F.col("to").alias("component"))
    else:
        raise RuntimeError("components did not settle")
    if home is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component"))
    least = checkpointed(home.groupBy("to").agg(F.min("id").alias("component")))
    return checkpointed(home.join(small(least), "to").select("id", "component"))


#: Scratch tables made by this process.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    _SCRATCH.append(os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}"))
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Removes the scratch tables made by this process. Results read them lazily: call it when those are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
