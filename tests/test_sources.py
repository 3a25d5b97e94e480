"""Media listing and probes, journals, source lists, the store, indexing, embedders."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.functions import regions
from reelspark.operators.budget import RollingLimiter
from reelspark.plans import discovery, embedding, indexing
from reelspark.schema import violations
from reelspark.session import EmbeddingSettings, Settings, closing_all
from reelspark.sources import journal, lists, media
from reelspark.sources.store import Identity, IncompatibleStore, VisualStore

INSTANCE = "123e4567-e89b-12d3-a456-426614174000"


def test_scan(spark, tmp_path):
    for name in ("b.MKV", "sub/a.JpEg", "notes.txt", ".hidden/c.jpg", "noext", ".jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    got = [(os.path.relpath(r["path"], tmp_path), r["media_type"]) for r in media.scan(spark, str(tmp_path)).collect()]
    assert got == [(".hidden/c.jpg", "image"), ("b.MKV", "video"), ("sub/a.JpEg", "image")]
    with pytest.raises(FileNotFoundError):
        media.scan(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        media.scan(spark, str(tmp_path / "notes.txt"))


def probe(spark, kind, **stream):
    duration = stream.pop("duration", "12.5")
    payload = json.dumps({"streams": [stream], "format": {"duration": duration}})
    return media.parse_probe(spark.createDataFrame([("p", kind, payload)], "path string, media_type string, payload string")).first()


def test_probe(spark):
    r = probe(spark, "video", codec_name="h264", width=64, height=48, avg_frame_rate="25/1", r_frame_rate="0/0")
    assert (r["width"], r["codec"], r["fps"], r["duration_seconds"], r["error"]) == (64, "h264", 25.0, 12.5, None)
    assert probe(spark, "video", codec_name="h264", width=64, height=48, avg_frame_rate="0/0", r_frame_rate="30000/1001")["fps"] == pytest.approx(29.97002997)
    assert "codec" in probe(spark, "video", codec_name="", width=64, height=48, avg_frame_rate="25/1", r_frame_rate="25/1")["error"]
    assert "frame rate" in probe(spark, "video", codec_name="h264", width=64, height=48, avg_frame_rate="0/0", r_frame_rate="0/0")["error"]
    photo = probe(spark, "image", width=5, height=4)
    assert photo["codec"] is None and photo["error"] is None
    assert "sides" in probe(spark, "image", width=0, height=4)["error"]


def test_keyframes(spark):
    def times(*frames):
        payload = json.dumps({"frames": [{"key_frame": k, "best_effort_timestamp_time": t} for k, t in frames]})
        return spark.createDataFrame([(payload,)], "p string").select(media.keyframe_times(F.col("p"))).first()[0]

    assert times((1, "0.0"), (0, "0.2"), (1, "2.0"), (1, "1.0"), (1, "2.0")) == [0.0, 2.0, 1.0]
    with pytest.raises(Exception, match="key frames"):
        times((0, "0.0"))


def line(asset="a" * 64, instance=INSTANCE, **other):
    return json.dumps({"schema_version": 1, "index_instance_id": instance, "asset_id": asset, "source_path": "a.mkv", "status": "completed"} | other)


def test_journal(spark, tmp_path):
    path = str(tmp_path / "state" / "completed.jsonl")
    assert journal.completed(spark, path, INSTANCE).count() == 0
    journal.mark_completed(path, INSTANCE, ("a" * 64, "a.mkv"))
    journal.mark_completed(path, "00000000-0000-4000-8000-000000000000", ("b" * 64, "b.mkv"), ("d" * 64, "d.mkv"))
    with open(path, "a") as f:
        f.write("\n\n" + line("c" * 64) + '\n{"schema_ver')
    assert sorted(r[0][0] for r in journal.completed(spark, path, INSTANCE).collect()) == ["a", "c"]
    for bad in ("nonsense", line(status="open"), line(extra=1), line(asset="A" * 64), line(schema_version=2)):
        with open(path, "w") as f:
            f.write(f"\n{bad}\n{line()}\n")
        with pytest.raises(Exception, match="line 2"):
            journal.completed(spark, path, INSTANCE).collect()
    with pytest.raises(journal.JournalError):
        journal.completed(spark, path, "no")
    with pytest.raises(journal.JournalError):
        journal.mark_completed(path, INSTANCE, ("short", "a.mkv"))


def test_dataset_identity(tmp_path):
    own = journal.dataset_identity(str(tmp_path))
    assert journal.dataset_identity(str(tmp_path)) == own
    (tmp_path / ".reelspark" / "dataset.json").write_text("{}")
    with pytest.raises(journal.JournalError):
        journal.dataset_identity(str(tmp_path))


def test_source_lists(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('﻿id,place,city,country,url,description,enabled\n90-1,Markt,Sittard,Netherlands,"https://a.example/x,y",,yes\n2,P,C,N,https://b.example,,no\n3,P,C,N,https://www.youtube.com/x,,\n4,P,C,N,,,\n5.0,,C,N,https://c.example,"said ""so""",\n', encoding="utf-8")
    got = lists.read_sources(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["url"], r["slug"]) for r in got] == [("5", "https://c.example", "n/c/unknown"), ("90-1", "https://a.example/x,y", "netherlands/sittard/markt")]
    assert got[0]["description"] == 'said "so"'
    path.write_text("id,place\n1,x\n")
    with pytest.raises(ValueError, match="must have"):
        lists.read_sources(spark, str(path))
    with pytest.raises(ValueError, match="unknown form"):
        lists.read_sources(spark, "s.txt")
    cells = [["title"], ["No.", "Place Name", "City", "Country", "Link"], [7.0, "P", "C", "N", "https://d.example"], ["Link", "No.", "Place Name", "City", "Country"], ["https://e.example", "8", "Q", "C", "N"]]
    assert [(r["id"], r["url"]) for r in lists.from_cells(spark, cells).orderBy("id").collect()] == [("7", "https://d.example"), ("8", "https://e.example")]


IDENTITY = Identity("m", 3, 1)


def visual(spark, rows):
    kinds = "asset_id string, source_path string, media_type string, sample_kind string, timestamp_seconds double, timestamp_us long, region_kind string, region struct<x int, y int, width int, height int, scale double>, vector array<float>, model_id string, dimension int, preprocessing_version int"
    return spark.createDataFrame(rows, kinds)


def row(asset="a", second=1.0, x=0, vector=(1.0, 0.0, 0.0), kind="tile", scale=0.5, path=None, **change):
    own = [asset * 64, path or f"{asset}.mkv", "video", "keyframe", second, int(second * 1e6), kind, (x, 0, 10, 10, scale), list(vector), "m", 3, 1]
    names = ["asset_id", "source_path", "media_type", "sample_kind", "timestamp_seconds", "timestamp_us", "region_kind", "region", "vector", "model_id", "dimension", "preprocessing_version"]
    for k, v in change.items():
        own[names.index(k)] = v
    return tuple(own)


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []), ({"asset_id": "A" * 64}, ["asset_id"]), ({"source_path": "/a.mkv"}, ["source_path"]), ({"source_path": "a/../b"}, ["source_path"]), ({"source_path": "a\\b"}, ["source_path"]),
        ({"media_type": "image"}, ["media"]), ({"vector": [1.0, 2.0]}, ["vector"]), ({"vector": [1.0, float("nan"), 0.0]}, ["vector"]), ({"vector": [0.0, 0.0, 0.0]}, []), ({"timestamp_us": 5}, ["timestamp_us"]),
        ({"region": (0, 0, 0, 5, 0.5)}, ["region"]), ({"region": (0, 0, 5, 5, 1.5)}, ["region"]), ({"region_kind": "full"}, ["full_region"]), ({"model_id": "other"}, ["identity"]),
    ],
)
def test_invariants(spark, change, want):
    df = visual(spark, [row(**change)])
    assert df.select(violations(df, IDENTITY.row()).alias("v")).first()["v"] == want


def test_store(spark, tmp_path):
    store = VisualStore(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.open(IDENTITY)
    instance = store.ensure(IDENTITY, INSTANCE)
    assert store.ensure(IDENTITY, INSTANCE) == store.open(IDENTITY) == instance
    for other in (Identity("x", 3, 1), Identity("m", 4, 1), Identity("m", 3, 2)):
        with pytest.raises(IncompatibleStore):
            store.open(other)
    with pytest.raises(IncompatibleStore):
        store.ensure(IDENTITY, "00000000-0000-4000-8000-000000000000")
    store.upsert(visual(spark, [row(second=12.0), row(second=12.0, x=5, vector=(0.6, 0.8, 0.0)), row("b", 20.0)]), IDENTITY)
    store.upsert(visual(spark, [row(second=12.0, vector=(0.0, 1.0, 0.0))]), IDENTITY)  # the same id, another vector
    assert store.visuals().count() == 3
    best = store.search([0.0, 1.0, 0.0], 2, IDENTITY).collect()
    assert [round(r["score"], 5) for r in best] == [1.0, 0.8]
    assert [r["region"]["x"] for r in store.timeline("a" * 64, 10_000_000, 14_000_000).orderBy("region.x").collect()] == [0, 5]
    with pytest.raises(Exception, match="invalid visual"):
        store.upsert(visual(spark, [row("c"), row(vector=(1.0,))]), IDENTITY)
    assert store.visuals().count() == 3  # nothing was written
    store.delete_stale(spark.createDataFrame([("b.mkv", "c" * 64)], "source_path string, asset_id string"))
    assert store.visuals().select("asset_id").distinct().count() == 1


make = functools.partial(embedding.HashEmbedder, 8)


def decode(rows):
    size = 4 * 4 * 3
    frames = rows.select("asset_id", "source_path", "media_type", F.when(F.col("media_type") == "video", F.lit(2.0)).alias("timestamp_seconds"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    content = F.encode(F.rpad(F.col("source_path"), size, "x"), "US-ASCII")
    return frames.withColumn("rgb24", content).withColumn("error", F.when(F.contains("source_path", F.lit("bad")), F.lit("unreadable")))


def test_indexing_restarts(spark, tmp_path):
    root = tmp_path / "media"
    (root / "s").mkdir(parents=True)
    for name in ("a.mkv", "s/b.jpg", "bad.mkv"):
        (root / name).write_bytes(b"x" * 9)
    store = VisualStore(spark, str(tmp_path / "store"))
    run = indexing.run(spark, str(root), store, make, decode)
    assert (run.indexed, run.skipped, run.failed, run.exit_code) == (2, 0, 1, 1)
    assert "FAILED bad.mkv [decode]\n  unreadable" in run.text()
    assert store.visuals().count() == 10  # five regions of each
    again = indexing.run(spark, str(root), store, make, decode)
    assert (again.indexed, again.skipped, again.failed) == (0, 2, 1) and store.visuals().count() == 10
    os.utime(root / "a.mkv", (5, 5))  # a new revision replaces the old one
    third = indexing.run(spark, str(root), store, make, decode)
    assert (third.indexed, third.skipped) == (1, 1) and store.visuals().count() == 10


def test_embedders():
    v = make().embed_texts(["a", "b", "a"])
    assert v.shape == (3, 8) and (v[0] == v[2]).all() and (v[0] != v[1]).any()

    sizes = []

    def model(part):
        sizes.append(len(part))
        if len(part) > 2:
            raise RuntimeError("device out of memory")
        return np.array([[float(x)] for x in part])

    own = embedding.BatchedEmbedder(Identity("m", 1, 1), model, 8)
    assert own.embed([1, 2, 3, 4, 5]).ravel().tolist() == [1, 2, 3, 4, 5] and own.batch_size == 2 and sizes == [5, 4, 2, 2, 1]

    now = [0.0]
    calls = []

    def call(part):
        calls.append((now[0], len(part)))
        return np.array([[float(x)] for x in part]), 1000 * len(part)

    limited = embedding.LimitedEmbedder(Identity("m", 1, 1), call, lambda x: 1000, RollingLimiter(100, 3000), lambda: now[0], lambda s: now.__setitem__(0, now[0] + s), batch_size=2)
    assert limited.embed([1, 2, 3, 4]).ravel().tolist() == [1, 2, 3, 4] and calls == [(0.0, 2), (0.0, 1), (60.0, 1)]
    assert embedding.resolve_backend("auto", {"mlx": True}) == "mlx"
    with pytest.raises(RuntimeError):
        embedding.resolve_backend("cuda", {})
    with pytest.raises(RuntimeError):
        embedding.create_embedder(EmbeddingSettings())
    assert embedding.create_embedder(EmbeddingSettings(), {"local": lambda s: make()}).identity.dimension == 8


def test_embedding_column(spark):
    got = spark.createDataFrame([("a",), ("b",)], "t string").select(embedding.embed_column(make)(F.col("t")).alias("v")).collect()
    assert [len(r["v"]) for r in got] == [8, 8]


def test_settings_from_environment():
    own = Settings.from_environment({"REEL_SEARCH__RESULT_LIMIT": "3", "REEL_VISUAL_BATCH_SIZE": "9", "OTHER": "1"})
    assert own.search.result_limit == 3 and own.visual_batch_size == 9 and own.search.candidate_limit == 200


def test_discovery(spark, tmp_path):
    pages = spark.createDataFrame([("s", "https://p.example/x", '<a href="live/index.m3u8">')], "source_id string, url string, html string")
    requests = spark.createDataFrame([("s", "https://c.example/cam/chunklist_1.m3u8"), ("s", "https://c.example/x.js")], "source_id string, url string")
    text = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5,RESOLUTION=64x48\nv.m3u8"
    lists_ = spark.createDataFrame([("https://p.example/live/index.m3u8", "https://p.example/live/index.m3u8", text), ("https://c.example/cam/chunklist_1.m3u8", None, None)], "url string, final_url string, text string")
    got = discovery.cameras(pages, requests, lists_).orderBy("camera_id").collect()
    assert [(r["camera_id"], r["stream_url"]) for r in got] == [("camera-001", "https://c.example/cam/chunklist_1.m3u8"), ("camera-002", "https://p.example/live/v.m3u8")]
    source = {"id": "s", "url": "https://p.example/x", "slug": "a/b/c"}
    for now in ("t1", "t2"):
        discovery.write_metadata(str(tmp_path), source, [{"camera_id": "camera-001", "stream_url": "u"}], now)
    own = json.loads((tmp_path / "a/b/c/cameras/camera-001/camera.json").read_text())
    assert (own["first_seen"], own["last_seen"]) == ("t1", "t2")
    assert json.loads((tmp_path / "a/b/c/source.json").read_text())["camera_count"] == 1


def test_cli(spark, capsys, tmp_path):
    from reelspark import cli

    assert cli.main(["search", "  "]) == 1
    path = tmp_path / "s.csv"
    path.write_text("id,place,city,country,url\n1,P,C,N,https://a.example\n2,P,C,N,https://b.example\n")
    assert cli.main(["sources", str(path), "--only", "2"]) == 0
    assert '"id":"2"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--limit", "0"])


def script(tmp_path, name, body):
    path = tmp_path / name
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(0o755)
    return str(path)


def test_probe_program(spark, tmp_path):
    good = script(tmp_path, "probe", """echo '{"streams":[{"codec_name":"h264","width":64,"height":48,"avg_frame_rate":"25/1","r_frame_rate":"25/1"}],"format":{"duration":"3.0"}}'\n""")
    rows = spark.createDataFrame([("a.mkv", "video")], "path string, media_type string")
    assert media.parse_probe(media.probe(rows, good)).first()["fps"] == 25.0
    bad = media.probe(rows, script(tmp_path, "broken", "echo no >&2\nexit 3\n")).first()
    assert bad["payload"] is None and bad["error"].startswith("a.mkv: no")
    assert media.probe(rows, str(tmp_path / "absent")).first()["error"].startswith("a.mkv")


def test_keyframe_sampler(spark, tmp_path):
    def frames(body, times="[0.0, 1.5]"):
        run = media.sampler()
        return run(F.lit("a.mkv"), F.lit(2), F.lit(1), F.lit(times), F.lit(script(tmp_path, "decoder", body))).collect()

    got = frames("printf 'abcdefABCDEF'\n")
    assert [(r["timestamp_seconds"], bytes(r["rgb24"])) for r in got] == [(0.0, b"abcdef"), (1.5, b"ABCDEF")]
    for body, said in (("printf 'abcdef'\n", "fewer"), ("printf 'abcdefABCDEFx'\n", "more"), ("printf 'abcdefABCDEF'\nexit 2\n", "failed")):
        with pytest.raises(Exception, match=said):
            frames(body)


def test_frames_must_fit(spark):
    kinds = "width int, height int, rgb24 binary"
    assert media.checked_frames(spark.createDataFrame([(1, 1, bytearray(b"abc"))], kinds)).count() == 1
    with pytest.raises(Exception, match="three bytes"):
        media.checked_frames(spark.createDataFrame([(1, 1, bytearray(b"ab"))], kinds)).collect()


PROBE = """case "$*" in
*lost.mkv*) echo lost >&2; exit 3;;
*-show_frames*still.mkv*) echo '{"frames":[{"key_frame":0,"best_effort_timestamp_time":"0.0"}]}';;
*-show_frames*) echo '{"frames":[{"key_frame":1,"best_effort_timestamp_time":"0.0"},{"key_frame":0,"best_effort_timestamp_time":"0.5"},{"key_frame":1,"best_effort_timestamp_time":"1.5"},{"key_frame":1,"best_effort_timestamp_time":"1.5"}]}';;
*) echo '{"streams":[{"codec_name":"h264","width":4,"height":4,"avg_frame_rate":"25/1","r_frame_rate":"25/1"}],"format":{"duration":"3.0"}}';;
esac
"""
DECODER = """case "$*" in
*-noautorotate*-i*short.mkv*) printf '%048d' 1;;
*-noautorotate*-i*broken.mkv*) printf '%096d' 1; exit 2;;
*-noautorotate*-i*) printf '%096d' 1;;
esac
"""


@pytest.fixture
def media_folder(tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    for name in ("good.mkv", "lost.mkv", "still.mkv", "short.mkv", "broken.mkv", "x.jpg"):
        (root / name).write_bytes(b"x" * 9)
    return root


def test_a_bad_asset_leaves_the_others(spark, tmp_path, media_folder):
    settings = Settings(ffprobe=script(tmp_path, "probe", PROBE), ffmpeg=script(tmp_path, "decoder", DECODER), visual_batch_size=2)
    store, said = VisualStore(spark, str(tmp_path / "store")), []
    run = indexing.run(spark, str(media_folder), store, make, settings=settings, say=said.append)
    assert (run.indexed, run.failed) == (1, 5) and said
    assert [(p, stage) for p, stage, _ in run.failures] == [("broken.mkv", "sampling"), ("lost.mkv", "probe"), ("short.mkv", "sampling"), ("still.mkv", "sampling"), ("x.jpg", "decode")]
    assert {stage for _, stage, _ in run.failures} <= set(indexing.STAGES)
    rows = store.visuals().collect()
    assert len(rows) == 10 and {r["source_path"] for r in rows} == {"good.mkv"} and {r["timestamp_us"] for r in rows} == {0, 1_500_000}
    assert not [n for n in os.listdir(tmp_path / "store") if n.startswith(("staged", "pending"))]
    again = indexing.run(spark, str(media_folder), store, make, settings=settings)
    assert (again.indexed, again.skipped, again.failed) == (0, 1, 5) and store.visuals().count() == 10


def test_a_frame_without_vector_fails_its_asset(spark, tmp_path):
    seen = [("a", b"abc" * 16), ("b", b"xyz" * 16), ("c", b"abc" * 15)]
    todo = spark.createDataFrame([(n, "video", f"{n}.mkv", n * 64, 4, 4, None) for n, _ in seen], "path string, media_type string, source_path string, asset_id string, width int, height int, error string")
    content = dict(seen)

    def frames(path, kind, width, height, probe, decoder):
        yield 0.0, width, height, content[path]

    def choosy():
        class Choosy(embedding.HashEmbedder):
            def embed_images(self, images):
                if b"xyz" * 16 in map(bytes, images):
                    raise RuntimeError("no vector for this")
                return super().embed_images(images)

        return Choosy(8)

    got = indexing.sampled(todo, choosy, Settings(), frames).collect()
    assert {(r["source_path"], r["stage"], r["error"]) for r in got if r["error"]} == {("b.mkv", "embedding", "no vector for this"), ("c.mkv", "regions", "cannot reshape array of size 45 into shape (4,4,3)")}
    assert [r["region_kind"] for r in got if r["source_path"] == "a.mkv"] == ["full"] + ["tile"] * 4


def test_regions_of_one_frame(spark):
    sides = [(w, h) for w in (1, 2, 7, 8, 11, 100) for h in (1, 5, 8, 99)]
    rows = regions.explode_regions(spark.createDataFrame(sides, "width int, height int")).orderBy("width", "height", "region_index").collect()
    for w, h in sides:
        own = [(r["region_kind"], r["region"].asDict()) for r in rows if (r["width"], r["height"]) == (w, h)]
        assert own == regions.region_list(w, h)
    for bad in ((0.0,), (1.5,)):
        with pytest.raises(ValueError):
            regions.regions(F.col("w"), F.col("h"), bad)


def test_images_that_cannot_be_read(spark):
    rows = media.decode_images(spark.createDataFrame([("a.jpg", bytearray(b"no image"), 4, 4)], "path string, content binary, width int, height int")).collect()
    assert rows[0]["rgb24"] is None and rows[0]["error"].startswith("a.jpg: ")


def test_retries_follow_the_service():
    slept, answers = [], [embedding.ServiceError(429, "7"), embedding.ServiceError(503), ConnectionError("gone"), None]

    def call(part):
        if (e := answers.pop(0)) is not None:
            raise e
        return np.ones((len(part), 1)), 1

    own = lambda: embedding.LimitedEmbedder(Identity("m", 1, 1), call, lambda x: 1, RollingLimiter(100, 3000), lambda: 0.0, slept.append)
    assert own().embed([1]).tolist() == [[1.0]] and slept == [7.0, 4.0, 8.0]
    answers[:] = [embedding.ServiceError(400), None]
    with pytest.raises(embedding.ServiceError):
        own().embed([1])


def test_limits_are_divided_among_tasks(spark, tmp_path, media_folder):
    own = EmbeddingSettings(engine="api", requests_per_minute=9, tokens_per_minute=100, concurrency=2)
    assert (embedding.divided(own).requests_per_minute, embedding.divided(own, 4).tokens_per_minute) == (4, 25)
    with pytest.raises(ValueError):
        embedding.divided(own, 10)
    todo = spark.createDataFrame([(n, "video", n, n * 64, 4, 4, None) for n in "abcdefgh"], "path string, media_type string, source_path string, asset_id string, width int, height int, error string")
    assert indexing.sampled(todo.repartition(2), make, Settings(), lambda p, *_: iter([(0.0, 4, 4, b"x" * 48)])).rdd.getNumPartitions() == 2


def test_closing_keeps_the_first_error():
    closed = []

    class Held:
        def __init__(self, name, fails=False):
            self.name, self.fails = name, fails

        def close(self):
            closed.append(self.name)
            if self.fails:
                raise OSError(self.name)

    with pytest.raises(KeyError) as e, closing_all(Held("a"), Held("b", True), object()):
        raise KeyError("first")
    assert closed == ["b", "a"] and e.value.__notes__ == ["closing failed too: b"]
    with pytest.raises(OSError, match="c"), closing_all(Held("c", True), Held("d")):
        pass


def test_index_and_discover_commands(spark, tmp_path, media_folder, capsys, monkeypatch):
    from reelspark import cli

    for name, value in (("REEL_FFPROBE", script(tmp_path, "probe", PROBE)), ("REEL_FFMPEG", script(tmp_path, "decoder", DECODER)), ("REEL_EMBEDDING__ENGINE", "hash")):
        monkeypatch.setenv(name, value)
    store = str(tmp_path / "store")
    assert cli.main(["index", str(media_folder), "--store", store]) == 1
    shown = capsys.readouterr()
    assert shown.out.startswith("Indexed: 1\nSkipped: 0\nFailed: 5\n") and "FAILED lost.mkv [probe]" in shown.out and "1 indexed" in shown.err
    assert cli.main(["search", "a boat", "--store", store]) == 0
    assert "1. good.mkv" in capsys.readouterr().out
    assert cli.main(["index", str(tmp_path / "absent"), "--store", store]) == 1
    (tmp_path / "s.csv").write_text("id,place,city,country,url\n1,P,C,N,https://a.example\n2,Q,C,N,https://b.example\n")
    spark.createDataFrame([("1", "https://a.example/x", '<a href="live/index.m3u8">')], "source_id string, url string, html string").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("1", "https://c.example/seen.m3u8")], "source_id string, url string").write.parquet(str(tmp_path / "requests"))
    capsys.readouterr()
    given = ["discover", str(tmp_path / "s.csv"), "--pages", str(tmp_path / "pages"), "--requests", str(tmp_path / "requests")]
    assert cli.main(given) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(x["id"], [c["stream_url"] for c in x["cameras"]]) for x in out] == [("1", ["https://c.example/seen.m3u8"]), ("2", [])]
    assert cli.main([*given, "--candidates-only"]) == 0 and "live/index.m3u8" in capsys.readouterr().out
