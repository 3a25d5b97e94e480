"""Ranking, intervals, passages, budgets and merges against fixed values."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import budget, cameras, intervals, joins, passages, ranking
from reelspark.plans import search as searching
from reelspark.session import SearchSettings

SCHEMA = "asset_id string, source_path string, media_type string, timestamp_us long, timestamp_seconds double, region_kind string, region struct<x int, y int, width int, height int, scale double>, score double"


def hit(asset, second, score, kind="full", x=0, path=None, media="video"):
    none = second is None
    return (asset, path or f"{asset}.mkv", media, None if none else int(second * 1e6), None if none else float(second), kind, (x, 0, 960, 540, 0.5), float(score))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seconds(rows):
    return sorted((r["start_us"] / 1e6, r["end_us"] / 1e6) for r in rows)


def test_best_region_of_a_moment(spark):
    rows = [hit("a", 12, s, "tile", 100 * i) for i, s in enumerate((0.27, 0.31, 0.61, 0.29))]
    got = ranking.best_by_timestamp(frame(spark, rows)).collect()
    assert [(r["score"], r["region"]["x"], r["timestamp_us"]) for r in got] == [(0.61, 200, 12_000_000)]


def test_ties_of_matches(spark):
    rows = [hit("a", 1, 0.5, "tile", 5), hit("a", 1, 0.5, "full", 9), hit("a", 1, 0.5, "full", 3)]
    assert ranking.best_by_timestamp(frame(spark, rows)).first()["region"]["x"] == 3


@pytest.mark.parametrize(
    ("times", "context", "want"),
    [((100, 108, 310), 15, [(85, 123), (295, 325)]), ((10, 20), 5, [(5, 25)]), ((3,), 5, [(0, 8)]), ((0, 10.000001), 5, [(0, 5), (5.000001, 15.000001)])],
)
def test_neighborhoods(spark, times, context, want):
    rows = frame(spark, [hit("a", t, 0.5) for t in times])
    assert seconds(intervals.neighborhoods(rows, context).collect()) == want


def test_streams_never_merge(spark):
    rows = frame(spark, [hit("a", 10, 0.5), hit("b", 11, 0.6)])
    assert intervals.neighborhoods(rows, 15).count() == 2


def test_anchor(spark):
    rows = frame(spark, [hit("a", 10, 0.5), hit("a", 12, 0.9), hit("a", 14, 0.9)])
    assert intervals.neighborhoods(rows, 15).first()["anchor"]["timestamp_us"] == 12_000_000


def test_bounded_windows(spark):
    own = sorted((r["start_us"], r["end_us"]) for r in intervals.windows(frame(spark, [hit("a", t, 0.5) for t in range(30, 301, 10)]), 15, 60).collect())
    assert own[0][0] == 15_000_000 and own[-1][1] == 315_000_000
    assert all(e - s <= 60_000_000 for s, e in own) and all(b[0] == a[1] + 1 for a, b in itertools.pairwise(own))


def test_refinement(spark):
    def cut(start, end, anchor):
        s, e = intervals.refinement(F.lit(start), F.lit(end), F.lit(anchor), 60_000_000)
        return tuple(spark.range(1).select(s.alias("s"), e.alias("e")).first())

    assert cut(15_000_000, 115_000_000, 80_000_000) == (50_000_000, 110_000_000)
    assert cut(0, 60_000_000, 1) == (0, 60_000_000)
    assert cut(0, 100_000_000, 99_000_000) == (40_000_000, 100_000_000)
    assert cut(0, 100_000_000, 1_000_000) == (0, 60_000_000)


def test_interval_join_both_ways(spark):
    areas = spark.createDataFrame([("a", "a.mkv", 0, 20_000_000), ("a", "a.mkv", 50_000_000, 60_000_000)], "asset_id string, source_path string, window_start_us long, window_end_us long")
    rows = frame(spark, [hit("a", t, 0.1) for t in (0, 20, 20.000001, 55)] + [hit("a", 5, 0.1, path="other.mkv"), hit("b", 5, 0.1)])
    for few in (True, False):
        got = intervals.within(areas, rows, 20_000_000, few=few).collect()
        assert sorted(r["timestamp_us"] for r in got) == [0, 20_000_000, 55_000_000]


def arr(spark, column, values):
    return spark.createDataFrame([([float(v) for v in values],)], "v array<double>").select(column(F.col("v")).alias("x")).first()["x"]


def test_moving_average(spark):
    assert arr(spark, lambda v: passages.array_moving_average(v, 3), [1, 2, 3, 4, 5]) == [1.5, 2, 3, 4, 4.5]
    rows = spark.createDataFrame([(1, t, float(t)) for t in range(1, 6)], "k int, timestamp_us long, v double")
    assert [r[0] for r in rows.orderBy("timestamp_us").select(passages.moving_average(F.col("v"), 3, ["k"])).collect()] == [1.5, 2, 3, 4, 4.5]
    with pytest.raises(ValueError):
        passages.moving_average(F.col("v"), 2, ["k"])


def test_z_scores(spark):
    assert arr(spark, passages.array_z_scores, [1, 2, 3]) == pytest.approx([-1.2247448714, 0, 1.2247448714])
    assert arr(spark, passages.array_z_scores, [0.1 + 0.2, 0.3, 0.3]) is None


def kadane(values):
    best = None
    for i, j in itertools.combinations_with_replacement(range(len(values)), 2):
        s = sum(values[i : j + 1])
        key = (-round(s, 9), j - i, i)
        if s > 1e-9 and (best is None or key < best[0]):
            best = (key, (i, j))
    return best and best[1]


@pytest.mark.parametrize("values", [[-1, -2], [1, 0, -2], [1, -2, 1], [-1, 2, -1, 3, 1, -5, 2], [0, 0], [], [2, -2, 2, 1]])
def test_maximum_subarray(spark, values):
    got = arr(spark, passages.maximum_subarray, values)
    assert (got and (got["first"], got["last"])) == kadane(values)


def test_maximum_subarray_random(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, rng.integers(1, 12))]) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, v array<double>").select("i", passages.maximum_subarray(F.col("v")).alias("r")).collect()
    for r in got:
        assert (r["r"] and (r["r"]["first"], r["r"]["last"])) == kadane(rows[r["i"]][1])


def passage(spark, scores, step=4):
    rows = frame(spark, [hit("a", step * i, s) for i, s in enumerate(scores)]).drop("media_type")
    r = passages.select_passages(rows, ["asset_id"]).first()
    return r["start_us"] / 1e6, r["end_us"] / 1e6, r["representative"]["timestamp_us"] / 1e6, r["representative"]["score"]


def test_passage(spark):
    assert passage(spark, [0.1, 0.1, 1, 0.1, 0.1, 0.1, 0.1, 0.65, 0.8, 0.7, 0.1, 0.1]) == (28, 36, 32, 0.8)
    assert passage(spark, [0.3, 0.9]) == (4, 4, 4, 0.9)
    assert passage(spark, [0.5, 0.5, 0.5, 0.5]) == (0, 0, 0, 0.5)


def visuals(spark, rows):
    kinds = "asset_id string, source_path string, media_type string, timestamp_us long, timestamp_seconds double, region_kind string, region struct<x int, y int, width int, height int, scale double>, vector array<float>, point_id string"
    return spark.createDataFrame([(*r[:7], v, f"{i:04d}") for i, (r, v) in enumerate(rows)], kinds)


def direction(score):
    return [score, (1 - score * score) ** 0.5, 0.0]


def test_search_mixes_photos_and_videos(spark):
    rows = [(hit("v", 12, 0, "tile", 100 * (i + 1)), direction(s)) for i, s in enumerate((0.2, 0.5, 0.8, 0.3))]
    rows += [(hit("p", None, 0, "full", 0, "p.jpg", "image"), direction(0.75)), (hit("p", None, 0, "tile", 0, "p.jpg", "image"), direction(0.4))]
    got = searching.search(visuals(spark, rows), [1.0, 0.0, 0.0]).collect()
    assert [(r["source_path"], r["start_seconds"], round(r["raw_score"], 5), r["region"]["x"]) for r in got] == [("v.mkv", 12.0, 0.8, 300), ("p.jpg", None, 0.75, 0)]
    text = [r["text"] for r in searching.rendered(searching.search(visuals(spark, rows), [1.0, 0.0, 0.0])).orderBy("position").collect()]
    assert text[0].startswith("1. v.mkv\n   passage: 00:00:12.000 -> 00:00:12.000\n") and text[1].endswith("raw score: 0.750000")


def test_search_orders_equals_by_path(spark):
    rows = [(hit(a, 5, 0), direction(0.6)) for a in ("b", "a")]
    assert [r["source_path"] for r in searching.search(visuals(spark, rows), [1.0, 0.0, 0.0]).collect()] == ["a.mkv", "b.mkv"]


def test_semantic_search_takes_every_visual_as_candidate(spark, tmp_path):
    # Seventy videos whose 2100 best rows stand alone among bad ones: their passages lie elsewhere and score near 0. Ten others are level at 0.3.
    import duckdb

    from reelspark.plans import catalog

    def score(asset, second):
        if asset >= 70:
            return 0.3 + 0.001 * (asset - 70) + 0.0001 * (second % 7)
        return (0.5 if second % 3 == 0 else -0.9) if second < 45 else 0.001 * (second % 5)

    at = [a for a in range(200) if a % 5 != 4][:80]
    rows = [(100 * a + 2 * t + tile, direction(1.0 if a + t + tile == 0 else score(i, t) - 0.00001 * tile)[:2], 0) for i, a in enumerate(at) for t in range(50) for tile in (0, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.semantic_search(spark, str(tmp_path)).collect()]
    assert got == db.sql(catalog.ORACLES["semantic_search"]).fetchall()
    assert {r[0] for r in got} == {f"media/asset-{a}.mkv" for a in at[70:]}


def test_bad_vector_fails_the_search(spark):
    rows = [(hit("a", 5, 0), [0.0, 0.0, 0.0])]
    with pytest.raises(Exception, match="vectors must be"):
        searching.search(visuals(spark, rows), [1.0, 0.0, 0.0]).collect()


def test_overfetch(spark):
    assert searching.limits(SearchSettings(candidate_limit=3, candidate_max_limit=12), 1) == [3, 6, 12]
    assert searching.limits(SearchSettings(candidate_limit=2, candidate_max_limit=4), 9) == [4]
    rows = [(hit("a", 10 * i, 0), direction(0.9 - i / 100)) for i in range(8)] + [(hit("b", 5, 0), direction(0.5))]
    _, k = searching.overfetched(visuals(spark, rows), [1.0, 0.0, 0.0], 2, SearchSettings(candidate_limit=4, candidate_max_limit=100))
    assert k == 16


def test_settings():
    for bad in ({"result_limit": 0}, {"candidate_limit": 9, "candidate_max_limit": 3}, {"moving_average_frames": 4}, {"context_seconds": 40.0}, {"context_seconds": -1.0}):
        with pytest.raises(ValueError):
            SearchSettings(**bad)


def test_limiter():
    own = budget.RollingLimiter(100, 3000)
    first = own.attempt(0.0, [1000, 1500, 1000])
    assert first.items == 2 and own.attempt(1.0, [1000]) is None and own.wait(0.0) == 60.0
    own.reconcile(first, 100)
    assert own.attempt(1.0, [1000]).items == 1
    assert own.attempt(60.0, [2000]).items == 1  # what is exactly a minute old has left
    with pytest.raises(ValueError):
        own.attempt(0, [3001])
    with pytest.raises(ValueError):
        budget.RollingLimiter(True, 5)


def test_limiter_against_a_plain_one():
    """Each start held by itself and summed anew, against the ledger; long enough for the ledger to be cut."""
    rng = np.random.default_rng(7)
    own, held, now, given = budget.RollingLimiter(3, 50, 10), [], 0, []
    for _ in range(6000):
        now += int(rng.integers(0, 4))
        costs = [int(c) for c in rng.integers(1, 30, rng.integers(1, 4))]
        held = [h for h in held if h[0] > now - 10]
        room, n = 50 - sum(h[1] for h in held), 0
        while n < len(costs) and sum(costs[: n + 1]) <= room:
            n += 1
        got = own.attempt(now, costs)
        assert (got.items if got else 0) == (n if len(held) < 3 else 0)
        if got:
            held.append([now, got.tokens])
            given.append((got, held[-1]))
        if given and rng.random() < 0.3:
            (r, h), actual = given.pop(), int(rng.integers(0, 20))
            own.reconcile(r, actual)
            h[1] = actual
        held = [h for h in held if h[0] > now - 10]
        assert own.wait(now) == (held[0][0] + 10 - now if held else 10)


def test_rolling_usage_over_spans(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], int(t), int(c)) for i, (t, c) in enumerate(zip(rng.integers(3_550_000_000, 3_660_000_000, 300), rng.integers(1, 9, 300), strict=True))]
    got = budget.rolling_usage(spark.createDataFrame(rows, "k string, t_us long, cost long"), ["k"]).collect()
    assert len(got) == 300
    for r in got:
        near = [c for k, t, c in rows if k == r["k"] and r["t_us"] - 60_000_000 < t <= r["t_us"]]
        assert (r["used_requests"], r["used_tokens"]) == (len(near), sum(near))


def test_rolling_usage(spark):
    rows = spark.createDataFrame([("p", t, 10 if t < 60_000_001 else 5) for t in (0, 59_999_999, 60_000_000, 60_000_001)], "k string, t_us long, cost long")
    assert [r["used_tokens"] for r in budget.rolling_usage(rows, ["k"]).orderBy("t_us").collect()] == [10, 20, 20, 25]


def test_admission_times(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], int(rng.integers(0, 200_000_000)), int(rng.integers(1, 900))) for i in range(80)]
    got = budget.admission_times(spark.createDataFrame(rows, "k string, t_us long, cost long"), "k", 5, 1000).collect()
    want = {}
    for k in "ab":
        limiter, clock = budget.RollingLimiter(5, 1000, budget.WINDOW_US), 0
        for _, t, c in sorted(r for r in rows if r[0] == k):
            clock = max(clock, t)
            while limiter.attempt(clock, [c]) is None:
                clock += limiter.wait(clock)
            want.setdefault((k, t, c), []).append(clock)
    assert sorted((r["k"], r["t_us"], r["cost"], r["admitted_us"]) for r in got) == sorted((*k, v) for k, vs in want.items() for v in vs)


def test_prefix(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate((3, 4, 5, 1))], "g string, i int, cost long")
    assert [r["admitted"] for r in budget.largest_prefix(rows, ["g"], "i", 8).orderBy("i").collect()] == [True, True, False, False]


def test_prefix_of_many_parts(spark):
    rng = np.random.default_rng(9)
    rows = [(None if i % 5 == 0 else "ab"[i % 2], float(t), int(c)) for i, (t, c) in enumerate(zip(rng.permutation(400) * 1.5 - 90, rng.integers(0, 9, 400), strict=True))]
    got = budget.largest_prefix(spark.createDataFrame(rows, "g string, t double, cost long"), ["g"], "t", 200).collect()
    assert len(got) == 400
    for r in got:
        assert r["admitted"] == (sum(c for g, t, c in rows if g == r["g"] and t <= r["t"]) <= 200)
    assert budget.largest_prefix(spark.createDataFrame([], "g string, t double, cost long"), ["g"], "t", 200).count() == 0


def test_merges(spark):
    kinds = "source_path string, asset_id string"
    stored = spark.createDataFrame([("p", "old"), ("p", "new"), ("q", "x")], kinds)
    assert sorted(map(tuple, joins.without_stale(stored, spark.createDataFrame([("p", "new")], kinds)).collect())) == [("p", "new"), ("q", "x")]
    old, new = spark.createDataFrame([("1", 1), ("2", 2)], "point_id string, v int"), spark.createDataFrame([("2", 9), ("3", 3)], "point_id string, v int")
    assert sorted(map(tuple, joins.upserted(old, new).collect())) == [("1", 1), ("2", 9), ("3", 3)]
    seen = joins.seen_merge(spark.createDataFrame([("a", "t0")], "id string, first_seen string"), spark.createDataFrame([("a",), ("b",)], "id string"), "id", F.lit("t1"))
    assert sorted(map(tuple, seen.collect())) == [("a", "t0", "t1"), ("b", "t1", "t1")]


def test_batches(spark):
    rows = spark.range(10).withColumn("k", F.lit(1))
    got = ranking.batches(rows, 9, [F.col("id")], ["k"]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [9, 1]


def test_discovery_json(spark):
    sources = spark.createDataFrame([(0, "s", "S"), (1, "t", "T")], "position int, id string, place string")
    own = spark.createDataFrame([("s", "camera-001", "u", 5, 640, 360)], "source_id string, camera_id string, stream_url string, bandwidth long, width long, height long")
    errors = spark.createDataFrame([("s", "late"), ("t", "gone")], "source_id string, error string")
    a, b = (r["json"] for r in cameras.discovery_json(own, sources, errors).collect())
    assert '"resolution":[640,360]' in a and "late" not in a and '"cameras":[]' in b and "gone" in b
