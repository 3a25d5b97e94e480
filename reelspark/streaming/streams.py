"""Structured Streaming: hour slices, sessions of hits, best matches, a rolling limiter, first and last seen, restartable indexing."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import hour_start, slice_path
from ..operators.budget import WINDOW_US


def hour_slices(attempts: DataFrame) -> DataFrame:
    """attempts(source_slug, camera_id, moment) with the hour that each belongs to, its end, and its own path: a new attempt never overwrites."""
    start = hour_start(F.col("moment"))
    return attempts.withColumn("hour", start).withColumn("ends", start + F.expr("INTERVAL 1 HOUR")).withColumn("path", slice_path(F.col("source_slug"), F.col("camera_id"), F.col("moment")))


def slices_per_hour(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Attempts of each camera and hour."""
    own = attempts.withWatermark("moment", late) if attempts.isStreaming else attempts
    counted = own.groupBy("source_slug", "camera_id", F.window("moment", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("attempts"))
    return counted.select("source_slug", "camera_id", F.col("w.start").alias("hour"), "attempts")


def hit_sessions(hits: DataFrame, context_seconds: float, keys: tuple[str, ...] = ("asset_id", "source_path"), late: str = "10 minutes") -> DataFrame:
    """Hits (ts) grouped while no gap is longer than twice the context: start, end, hits, best score of each group."""
    gap = f"{round(2 * context_seconds * 1e6)} microseconds"
    own = hits.withWatermark("ts", late) if hits.isStreaming else hits
    out = own.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("hits"), F.max("score").alias("best_score"))
    return out.drop("w")


def best_matches(matches: DataFrame, keys: tuple[str, ...] = ("asset_id", "timestamp_us"), late: str = "10 minutes") -> DataFrame:
    """The running best match of each key; the state is one row a key.

    A stream's rows come by timestamp_us, and a key that lies further back than late is given up: append mode then gives its best and forgets it.
    """
    rest = [c for c in matches.columns if c not in keys]
    order = F.struct(-F.col("score"), "source_path", "region_kind", "region.x", "region.y", "region.width", "region.height")
    best = F.min_by(F.struct(*rest), order).alias("best")
    if matches.isStreaming and "timestamp_us" in keys:
        own = matches.withColumn("_at", F.timestamp_micros("timestamp_us")).withWatermark("_at", late)
        return own.groupBy(*keys, "_at").agg(best).select(*keys, "best.*")
    return matches.groupBy(*keys).agg(best).select(*keys, "best.*")


def seen(cameras: DataFrame, key: str = "camera_id", at: str = "ts") -> DataFrame:
    """First and last time that each camera was seen."""
    return cameras.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", within: str = "1 minute") -> DataFrame:
    """One of the events that agree in the keys within a time: what several ask for at once is done once."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def admissions(requests: DataFrame, key: str, request_limit: int, token_limit: int) -> DataFrame:
    """requests(key, request_id, t_us, cost) with whether each is admitted in the minute that ends with it; refused ones reserve nothing.

    The state of a key is its last minute: no more reservations than the limit of requests.
    """

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, costs = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(parts)).sort_values(["t_us", "request_id"], kind="stable")
        admitted = []
        for t, c in zip(rows["t_us"], rows["cost"], strict=True):
            while times and times[0] <= t - WINDOW_US:
                times.pop(0)
                costs.pop(0)
            good = len(times) < request_limit and sum(costs) + c <= token_limit
            if good:
                times.append(int(t))
                costs.append(int(c))
            admitted.append(good)
        state.update((times, costs))
        yield pd.DataFrame({key: own[0], "request_id": rows["request_id"], "t_us": rows["t_us"], "cost": rows["cost"], "admitted": admitted})

    kinds = dict(requests.dtypes)
    out = f"{key} {kinds[key]}, request_id {kinds['request_id']}, t_us long, cost long, admitted boolean"
    return requests.groupBy(key).applyInPandasWithState(run, out, "times array<long>, costs array<long>", "append", GroupStateTimeout.NoTimeout)


def waiting_admissions(rows: DataFrame, key: str, request_limit: int, token_limit: int) -> DataFrame:
    """When each request of rows(key, request_id, t_us, cost, actual) is admitted: it waits until those before it and the limits let it.

    A row with actual tells what an earlier request really used, which counts from then on in place of its cost; it gives no row. Requests of a batch
    are taken by time, and none is admitted before one of an earlier batch. The state of a key is the clock and its last minute.
    """

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, *lists = state.get if state.exists else (0, [], [], [])
        held = deque(list(r) for r in zip(*lists, strict=True))  # request, time, tokens
        total = sum(h[2] for h in held)
        out = []
        batch = pd.concat(list(parts)).sort_values(["t_us", "request_id"], kind="stable")
        for request, t, cost, actual in zip(batch["request_id"], batch["t_us"], batch["cost"], batch["actual"], strict=True):
            clock = max(clock, int(t))
            if not pd.isna(actual):
                for h in held:
                    if h[0] == request:
                        total += int(actual) - h[2]
                        h[2] = int(actual)
                continue
            if cost > token_limit:
                raise ValueError(f"a request of {cost} tokens can never be admitted")
            while True:
                while held and held[0][1] <= clock - WINDOW_US:
                    total -= held.popleft()[2]
                if len(held) < request_limit and total + int(cost) <= token_limit:
                    break
                clock = held[0][1] + WINDOW_US
            held.append([int(request), clock, int(cost)])
            total += int(cost)
            out.append((own[0], request, clock))
        state.update((clock, *([h[i] for h in held] for i in range(3))))
        yield pd.DataFrame(out, columns=[key, "request_id", "admitted_us"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, request_id long, admitted_us long", "clock long, requests array<long>, times array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout)


def arriving(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Rows of Parquet files as they come, so many files a batch at most: what follows can't be flooded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def index_stream(assets: DataFrame, checkpoint: str, handle: Callable[[DataFrame], None], done: Callable[[SparkSession], DataFrame]) -> StreamingQuery:
    """Each batch of new assets less what the journal names goes to handle, which writes visuals, then the journal; a batch that is run again finds its work done."""

    def batch(rows: DataFrame, _: int) -> None:
        todo = rows.join(done(rows.sparkSession), "asset_id", "left_anti").persist()
        if not todo.isEmpty():
            handle(todo)
        todo.unpersist()

    return assets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
