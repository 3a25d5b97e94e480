"""Vectors, times, identities, regions, strings, URLs and playlists against fixed values."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from reelspark.functions import identity, playlists, regions, strings, times, urls, vectors
from reelspark.operators import cameras, joins


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*v):
    return F.array(*[F.lit(float(x)) for x in v])


@pytest.mark.parametrize(("a", "b", "want"), [((1, 0, 0), (2, 0, 0), 1.0), ((1, 0), (0, 1), 0.0), ((1, 0), (-1, 0), -1.0)])
def test_cosine(spark, a, b, want):
    assert one(spark, vectors.cosine_similarity(vec(*a), vec(*b))) == pytest.approx(want)


@pytest.mark.parametrize(("a", "b"), [((1, 0), (1, 0, 0)), ((0, 0), (1, 0)), ((float("nan"), 0), (1, 0)), ((float("inf"), 0), (1, 0))])
def test_cosine_refuses(spark, a, b):
    with pytest.raises(Exception, match="vectors must be"):
        one(spark, vectors.cosine_similarity(vec(*a), vec(*b)))


def test_query_vector():
    assert vectors.check_query([1, 2], 2) == [1.0, 2.0]
    for bad in ([], [0, 0], [float("nan"), 1], [1, 2, 3]):
        with pytest.raises(ValueError):
            vectors.check_query(bad, 2)


@pytest.mark.parametrize(("seconds", "want"), [(5e-7, 1), (1.5e-6, 2), (123.456, 123456000), (0.0, 0)])
def test_microseconds(spark, seconds, want):
    assert one(spark, times.to_microseconds(F.lit(seconds))) == want


@pytest.mark.parametrize(("seconds", "want"), [(0.0, "00:00:00.000"), (3661.5, "01:01:01.500"), (360000.0005, "100:00:00.000"), (0.0015, "00:00:00.002")])
def test_clock(spark, seconds, want):
    assert one(spark, times.clock(F.lit(seconds))) == want


def test_slice_path(spark):
    moment = F.lit(datetime(2026, 8, 22, 10, 15, 0, 123456, tzinfo=timezone.utc))
    assert one(spark, times.slice_path(F.lit("nl/sittard/markt"), F.lit("camera-001"), moment)) == "nl/sittard/markt/cameras/camera-001/2026/08/22/2026-08-22T10-00-00Z__start-10-15-00-123456Z.mkv"
    assert one(spark, times.seconds_to_next_hour(moment)) == 2699


@pytest.mark.parametrize(("header", "attempt", "want"), [("7", 1, 7.0), ("-3", 1, 0.0), (None, 1, 2.0), ("soon", 3, 8.0), (None, 9, 30.0)])
def test_retry_delay(spark, header, attempt, want):
    assert one(spark, times.retry_delay(F.lit(header).cast("string"), F.lit(attempt))) == want


def test_point_id_matches_the_standard(spark):
    row = {"asset_id": "a" * 64, "dimension": 768, "height": 1080, "model_id": 'mod"é\\l', "preprocessing_version": 1, "region_kind": "full", "sample_kind": "keyframe", "timestamp_us": 123456000, "width": 1920, "x": 0, "y": 0}
    want = str(uuid.uuid5(uuid.NAMESPACE_URL, identity.VISUAL_PREFIX + json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
    df = spark.createDataFrame([(row["asset_id"], 768, row["model_id"], 1, "full", "keyframe", 123456000, (0, 0, 1920, 1080, 1.0))], "asset_id string, dimension int, model_id string, preprocessing_version int, region_kind string, sample_kind string, timestamp_us long, region struct<x int, y int, width int, height int, scale double>")
    assert df.select(identity.point_id()).first()[0] == want
    scaled = df.withColumn("region", F.col("region").withField("scale", F.lit(0.5)))
    moved = df.withColumn("region", F.col("region").withField("x", F.lit(5)))
    assert scaled.select(identity.point_id()).first()[0] == want != moved.select(identity.point_id()).first()[0]
    null = df.withColumn("timestamp_us", F.lit(None).cast("long")).select(identity.point_id()).first()[0]
    assert null == str(uuid.uuid5(uuid.NAMESPACE_URL, identity.VISUAL_PREFIX + json.dumps(row | {"timestamp_us": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))


def test_asset_id(spark):
    text = identity.ASSET_PREFIX + json.dumps({"file_size": 5, "mtime_ns": 17, "relative_path": "é/a.mkv"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, identity.asset_id(F.lit(5).cast("long"), F.lit(17).cast("long"), F.lit("é/a.mkv"))) == hashlib.sha256(text.encode()).hexdigest()


def test_regions(spark):
    def cells(w, h):
        df = spark.createDataFrame([(w, h)], "width int, height int")
        return [(r["region_kind"], r["region"]["x"], r["region"]["y"], r["region"]["width"]) for r in regions.explode_regions(df).orderBy("region_index").collect()]

    assert len(cells(4, 4)) == 5 and len(cells(100, 100)) == 10 and len(cells(1, 1)) == 1 and len(cells(11, 7)) == 5
    small = cells(8, 8)
    assert small[0] == ("full", 0, 0, 8) and {c[1] for c in small[1:]} == {0, 3, 4} and [c[2] for c in small[1:4]] == [0, 0, 0]
    large = cells(2688, 1512)
    assert len(large) == 10 and {c[1] for c in large[1:]} == {0, 1008, 1344} and {c[2] for c in large[1:]} == {0, 567, 756}


def test_crop(spark):
    w, h = 4, 3
    data = bytes(v for y in range(h) for x in range(w) for v in (x, y, (x + y) % 256))
    df = spark.createDataFrame([(w, h, bytearray(data), (1, 1, 2, 2, 0.5))], "width int, height int, rgb24 binary, region struct<x int, y int, width int, height int, scale double>")
    assert bytes(regions.crop_frames(df).first()["rgb24"]) == bytes([1, 1, 2, 2, 1, 3, 1, 2, 3, 2, 2, 4])


@pytest.mark.parametrize(("text", "want"), [("Sittard Markt", "sittard-markt"), ("  Łódź Café! ", "odz-cafe"), ("日本", "unknown"), (None, "unknown")])
def test_slug(spark, text, want):
    assert one(spark, strings.slugify(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("flag", "want"), [(None, True), (" ", True), ("No", False), ("OFF ", False), ("yes", True), ("0", False)])
def test_enabled(spark, flag, want):
    assert one(spark, strings.is_enabled(F.lit(flag).cast("string"))) is want


@pytest.mark.parametrize(("value", "want"), [("12.0", "12"), (" 90-1 ", "90-1"), ("12.5", "12.5"), ("007", "007")])
def test_cell_id(spark, value, want):
    assert one(spark, strings.cell_id(F.lit(value))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://cam.example/live/index.m3u8", True), ("https://cam.example/live/INDEX.M3U8?x=1", True), ("https://t.example/log?u=a.m3u8", False), ("ftp://cam.example/a.m3u8", False),
        ("https://www.youtube.com/a.m3u8", False), ("https://x.gstatic.com/a.m3u8", False), ("https://notyoutube.com/a.m3u8", True), ("/a.m3u8", False),
    ],
)
def test_admissible(spark, url, want):
    assert one(spark, urls.is_playlist(F.lit(url))) is want


def test_extraction(spark):
    from reelspark.plans.discovery import page_urls

    html = r'<video src="https://cdn.example/a/index.m3u8?x=1&y=2"> var u="https:\/\/cdn.example\/b\/live.M3U8"; src:https://cdn.example/c.m3u8; <a href="../d/e.m3u8">//cdn.example/f.m3u8 beacon?u=https%3A%2F%2Fx.example%2Fg.m3u8 k=h.m3u8 https://youtu.be/z.m3u8'
    pages = spark.createDataFrame([("s", "https://site.example/page/view.html", html), ("t", "https://x.example/", "nothing " * 5000)], "source_id string, url string, html string")
    found = {r["url"] for r in page_urls(pages).collect()}
    assert found == {
        "https://cdn.example/a/index.m3u8?x=1&y=2", "https://cdn.example/b/live.M3U8", "https://cdn.example/c.m3u8", "https://site.example/d/e.m3u8", "https://cdn.example/f.m3u8", "https://site.example/page/h.m3u8",
    }


FAMILIES = [
    (["https://a.example/s/playlist.m3u8", "https://a.example/s/chunklist_w1.m3u8"], 1),
    (["https://a.example/cam_output_0.m3u8", "https://a.example/cam_output_1.m3u8"], 1),
    (["https://a.example:443/s/index.m3u8", "https://a.example/s/index.m3u8"], 1),
    (["https://cdn01.a.example/123e4567-e89b-12d3-a456-426614174000.m3u8", "https://cdn02.a.example/123e4567-e89b-12d3-a456-426614174000.m3u8"], 1),
    (["https://cdn01.a.example/live/playlist.m3u8", "https://cdn02.a.example/live/playlist.m3u8"], 2),
    (["https://a.example/front.m3u8", "https://a.example/back.m3u8"], 2),
    (["https://a.example/s/index.m3u8?token=1", "https://a.example/s/index.m3u8?token=2"], 1),
    (["https://a.example/s/index.m3u8?cam=1&token=9", "https://a.example/s/index.m3u8?cam=2"], 2),
    (["https://a.example/c/tracks-v1/mono.m3u8", "https://a.example/c/index.m3u8"], 1),
    (["https://a.example/c/video1_stream.m3u8", "https://a.example/c/index.m3u8"], 1),
]


@pytest.mark.parametrize(("given", "n"), FAMILIES)
def test_families(spark, given, n):
    rows = spark.createDataFrame([("s", u) for u in given], "source_id string, url string")
    groups = cameras.families(rows).collect()
    assert len(groups) == n and sorted(u for g in groups for u in g["urls"]) == sorted(given)


def test_preferred(spark):
    rows = spark.createDataFrame([("s", "https://a.example/s/chunklist.m3u8"), ("s", "https://a.example/s/playlist.m3u8?token=1"), ("s", "https://a.example/s/playlist.m3u8")], "source_id string, url string")
    assert cameras.families(rows).first()["preferred"] == "https://a.example/s/playlist.m3u8"


MASTER = """#EXTM3U
#EXT-X-STREAM-INF:BANDWIDTH=800000,RESOLUTION=640x360,CODECS="avc1,mp4a"
low/index.m3u8
#EXT-X-STREAM-INF:AVERAGE-BANDWIDTH=2500000,BANDWIDTH=9,RESOLUTION=1920x1080
# comment

high/index.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=x,RESOLUTION=bad
/mid.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=1
"""


def test_playlist(spark):
    rows = playlists.explode_variants(spark.createDataFrame([("https://a.example/x/master.m3u8", MASTER)], "url string, text string"))
    got = [(r["variant_url"], r["bandwidth"], r["width"]) for r in rows.orderBy("position").collect()]
    assert got == [("https://a.example/x/low/index.m3u8", 800000, 640), ("https://a.example/x/high/index.m3u8", 2500000, 1920), ("https://a.example/mid.m3u8", 0, None)]
    assert playlists.best_variant(rows, "url").first()["variant_url"].endswith("high/index.m3u8")


def test_resolution_falls_back(spark):
    groups = cameras.families(spark.createDataFrame([("s", "https://a.example/s/playlist.m3u8"), ("s", "https://a.example/s/chunklist_1.m3u8"), ("s", "https://a.example/static.m3u8"), ("s", "https://a.example/t.m3u8")], "source_id string, url string"))
    probes = spark.createDataFrame([("https://a.example/s/playlist.m3u8", False, None, 0, None, None), ("https://a.example/s/chunklist_1.m3u8", False, None, 0, None, None), ("https://a.example/static.m3u8", False, None, 0, None, None), ("https://a.example/t.m3u8", True, "https://a.example/t/best.m3u8", 5, 640, 360)], "url string, ok boolean, stream_url string, bandwidth long, width long, height long")
    observed = spark.createDataFrame([("s", "https://a.example/s/chunklist_1.m3u8")], "source_id string, url string")
    got = [(r["camera_id"], r["stream_url"]) for r in cameras.numbered(cameras.resolved(groups, probes, observed)).orderBy("camera_id").collect()]
    assert got == [("camera-001", "https://a.example/s/chunklist_1.m3u8"), ("camera-002", "https://a.example/t/best.m3u8")]


def test_positional_joins(spark):
    good = F.array(F.lit(1), F.lit(2))
    assert [tuple(r) for r in one(spark, joins.zipped(good, F.array(F.lit("a"), F.lit("b"))))] == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="unequal"):
        one(spark, joins.zipped(good, F.array(F.lit("a"))))
    items = lambda *i: F.array(*[F.struct(F.lit(x).alias("index"), F.lit(x * 10).alias("v")) for x in i])
    assert [r["v"] for r in one(spark, joins.by_index(items(1, 0), F.lit(2)))] == [0, 10]
    for bad in (items(0, 0), items(0, 2), items(0)):
        with pytest.raises(Exception, match="indexes"):
            one(spark, joins.by_index(bad, F.lit(2)))


def test_relative_references(spark):
    from urllib.parse import urljoin

    bases = ["https://a.example/x/y/master.m3u8?t=1#f", "http://a.example", "https://a.example/a//b/c", "https://a.example/a/../b/./c", "https://u@a.example:80/p/"]
    references = ["b.m3u8", "../b.m3u8", "../../../b", "./b", "b/../c?x=../y", "/r/../s", "//h.example/z/../k", "?q=1", "#k", "", "https://o.example/a/../b", "a//b", "..", ".", "a/.", "x/..", "b?u=http://x/", "a:b", "/"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in references], "b string, r string")
    for got in rows.select("b", "r", urls.join_url(F.col("b"), F.col("r")).alias("url")).collect():
        assert got["url"] == urljoin(got["b"], got["r"]), got
    assert one(spark, urls.join_url(F.lit("https://a.example/"), F.lit(None).cast("string"))) is None


def test_attributes(spark):
    own = one(spark, playlists.attributes(F.lit('#EXT-X-STREAM-INF:BANDWIDTH=1,CODECS="a,b",BANDWIDTH=2,NAME= x ')))
    assert own == {"BANDWIDTH": "2", "CODECS": "a,b", "NAME": "x"}


def test_playlist_line_ends(spark):
    text = "#EXTM3U\r#EXT-X-STREAM-INF:BANDWIDTH=1\r#EXT-X-STREAM-INF:BANDWIDTH=2\r\n  \r\n  v.m3u8  \rw.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=3\n"
    rows = playlists.explode_variants(spark.createDataFrame([("https://a.example/m.m3u8", text), ("https://a.example/n.m3u8", None), ("https://a.example/o.m3u8", "")], "url string, text string"))
    assert [(r["variant_url"], r["bandwidth"]) for r in rows.orderBy("position").collect()] == [("https://a.example/v.m3u8", 1), ("https://a.example/v.m3u8", 2)]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.example/x//y/CHUNKLIST_b1.m3u8", "/x/y/"), ("https://a.example/x/stream.m3u8/", "/x/"), ("https://a.example/c/tracks-v2/mono.m3u8", "/c/"), ("https://a.example/c/cam_output_10.m3u8", "/c/cam"),
        ("https://a.example/123e4567-e89b-12d3-a456-426614174000.m3u8", "/123e4567-e89b-12d3-a456-426614174000"), ("https://a.example", "/"), ("https://a.example/x//front.m3u8", "/x//front.m3u8"), ("https://a.example/index.m3u8", "/"),
    ],
)
def test_family_path(spark, url, want):
    assert one(spark, urls.family_path(F.lit(url))) == want
