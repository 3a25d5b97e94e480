"""Operators on pairs and groups, and the pipeline, against brute force; and their edge cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from test_text_operators import EDGE, frame

import corpus_pipeline
from reelspark.llm import decontaminate, embed_dedup, langid, minhash, pii
from reelspark.llm.common import connected_components, shingles, span_hashes, word_hashes


class Union:
    def __init__(self, ids):
        self.of = {i: i for i in ids}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def text(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


def edited(rng, given, n):
    own = given.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = f"z{rng.randint(0, 10**6)}"
    return " ".join(own)


# Components and hashes


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + rng.randint(0, 50), 200 + rng.randint(0, 50)) for _ in range(40)] + [(7, 7), (300, 301), (301, 300)]
    want = Union({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    a, b = word_hashes("The  cat\nsat É"), word_hashes("x the cat sat é")
    assert a.tolist() == b.tolist()[1:] and len(set(a.tolist())) == 4 and not len(word_hashes(None))
    long = "word " * 100_000
    assert len(word_hashes(long)) == 100_000 and len(set(word_hashes(long).tolist())) == 1
    assert len(shingles(word_hashes("a b"), 5)) == 1 and len(shingles(word_hashes("a b c d e f"), 5)) == 2
    data = np.frombuffer(b"abcabc", dtype=np.uint8)
    assert len(set(span_hashes(data, np.array([0, 3]), np.array([3, 6])).tolist())) == 1


# MinHash


def brute_similarity(a, b):
    p, q = (dict(zip(x[0].tolist(), x[1].tolist(), strict=True)) for x in (a, b))
    return sum(1 / sum(max(p.get(y, 0) / p[x], q.get(y, 0) / q[x]) for y in p.keys() | q.keys()) for x in p.keys() & q.keys())


def test_similarity_and_estimate():
    rng = random.Random(2)
    for _ in range(12):
        base = text(rng, rng.randint(20, 200), 30)
        a, b = minhash.weighted(base), minhash.weighted(edited(rng, base, rng.randint(0, 6)))
        exact = minhash.similarity(a, b)
        assert exact == pytest.approx(brute_similarity(a, b))
        assert abs((minhash.signature(*a, registers=2000) == minhash.signature(*b, registers=2000)).mean() - exact) < 0.06


def classes(docs, least=0.8):
    """By all pairs."""
    own = {i: minhash.weighted(t) for i, t in docs if t}
    out = Union([i for i, _ in docs])
    for a, b in itertools.combinations(own, 2):
        if len(own[a][0]) and len(own[b][0]) and minhash.similarity(own[a], own[b]) >= least:
            out.join(a, b)
    return {i: out.find(i) for i, _ in docs}


def corpus(rng):
    passage = text(rng, 60)
    docs = [text(rng, rng.randint(30, 80)) for _ in range(25)]
    docs += [passage + " " + text(rng, rng.randint(10, 60)) for _ in range(45)]  # share a passage, mostly unlike
    base = text(rng, 120)
    docs += [edited(rng, base, rng.randint(0, 7)) for _ in range(45)]  # near copies, not all alike pairwise
    docs += [docs[3]] * 20 + ["a b", "a b", "A  b", "solo"]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)  # so that a few documents go through all rounds
    docs = corpus(random.Random(seed))
    got = minhash.near_duplicates(frame(spark, [(i, t, "en") for i, t in docs])).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(docs) and all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_a_text_and_its_repetition_in_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    word = lambda c, n: [f"{c}{i}" for i in range(n)]
    r, q, t = word("r", 34), word("q", 70), word("t", 90)
    docs = [r + q[:4] + t[: 90 - i] for i in range(8)]  # alike; the least of them lead the keys of r
    docs += [part + word(f"{part[-1]}{j}x", 80) for part in (q, q[:4] + t) for j in range(14)]  # so that shingles of r are the rarest
    docs += [r + q, r + q + r + q]  # no shingle repeats; nearly all do
    docs = list(enumerate((" ".join(d) for d in docs), 1))
    members = spark.createDataFrame([(1, i, 1, len(docs)) for i, _ in docs], "key long, id long, leader long, n long")
    found = {x["id"]: x["component"] for x in minhash._links(members, spark.createDataFrame(docs, "id long, text string"), 0.8).collect()}
    want = classes(docs)
    assert want[len(docs)] == len(docs) - 1 and {i: found.get(i, i) for i, _ in docs} == want


def test_one_of_each_class_where_ids_repeat(spark):
    """Unlike texts under one id stay, like ones go whatever their ids; which is left doesn't hang on the order of rows."""
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "en"), (1, other, "en"), (1, one, "de"), (2, one + " more", "en"), (3, "quite another text of its own here", "fr"), (None, one, "en"), (4, None, "en"), (4, "", "en")]
    want = [(1, one, "de"), (1, other, "en"), (3, rows[4][1], "fr"), (4, "", "en"), (4, None, "en"), (None, one, "en")]
    for turn in (rows, rows[::-1]):
        got = [(r["doc_id"], r["text"], r["lang"]) for r in minhash.keep_one(frame(spark, turn)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_shared_map_joins_ranges(spark):
    texts = frame(spark, [(i, f"x{i} a b c d e f g {i % 3} h i j k", "en") for i in range(30)]).selectExpr("doc_id as id", "text").repartition(5)
    counts = {}
    for r in texts.collect():
        for h in minhash._bucket(minhash.weighted(r["text"])[0]).tolist():
            counts[h] = counts.get(h, 0) + 1
    assert set(np.flatnonzero(minhash._shared_map(texts)).tolist()) == {h for h, n in counts.items() if n > 1}


def test_near_duplicates_edge_rows(spark):
    got = minhash.near_duplicates(frame(spark, EDGE)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted({str(i) for i, _, _ in EDGE}) and all(r["kept"] for r in got)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    kept = minhash.keep_one(frame(spark, [*EDGE, (9, "the cat and the dog of the house", "en")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(i) for i, _, _ in EDGE}) and kept.columns == frame(spark, []).columns


# Decontamination

ITEM = "Tom has 12 apples and gives 5 apples to Mary before he walks 3 km to the old market hall."


def leaks(spark, texts, items):
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(*x, "t", 1) for x in items], "item_id long, text string, kind string, doc_id long")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(docs, bench).collect()}


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 0])
def test_leaks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    texts = [
        f"intro words here. Then: {ITEM} end", "foo bar Jim has 40 apples and gives 7 apples to Anna before he walks 9 miles to the old market hall baz",
        "foo bar Jim has 40 apples and gives 40 apples to Anna before he walks 9 miles to the old market hall baz", None, "", "Tom has 12 apples and gives 5 pears", f"{ITEM} {ITEM}", "alpha beta gamma delta epsilon zeta",
    ]
    got = leaks(spark, texts, [(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, ""), (4, "alpha beta gamma delta epsilon zeta"), (5, "too short")])
    assert got == {(0, 1): "verbatim", (1, 1): "reparameterised", (6, 1): "verbatim", (7, 4): "verbatim"}
    assert leaks(spark, texts, []) == {} and leaks(spark, [], [(1, ITEM)]) == {}


def test_leaks_against_containment(spark):
    rng = random.Random(6)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    items = [(i, plain(rng.randint(12, 60))) for i in range(15)]
    texts = [plain(rng.randint(0, 80)) for _ in range(60)]
    for k in range(0, 60, 4):
        texts[k] += ". " + items[k % 15][1] + " " + plain(5)
    assert set(leaks(spark, texts, items)) == {(k, i) for k, t in enumerate(texts) for i, x in items if x in t}


def test_leaks_without_template_windows(spark):
    """Items short or dense in numbers and names: word for word at any length, of fewer than three words only as the whole document."""
    items = [(1, "Who wrote Hamlet in 1600?"), (2, "12 + 7 = 19, 3 + 4 = 7, 20 + 1 = 21, 5 + 6 = 11"), (3, "Paris"), (4, "two words"), (5, "see Tom at 5")]
    texts = ["so: Who wrote Hamlet in 1600? Nobody.", "Who wrote Faust in 1800?", "sums 12 + 7 = 19, 3 + 4 = 7, 20 + 1 = 21, 5 + 6 = 11 end", "12 + 7 = 19, 3 + 4 = 7, 20 + 1 = 22", "Paris", "in Paris", "Two words.", "two words more", "we see Tom at 5 pm"]
    assert leaks(spark, texts, items) == {(0, 1): "verbatim", (2, 2): "verbatim", (4, 3): "verbatim", (6, 4): "verbatim", (8, 5): "verbatim"}


def brute_leaks(texts, items):
    """Slot consistency by brute force: all alignments of all pairs, token by token."""
    found = set()
    shapes = [decontaminate.template(t) for t in texts]
    for i, x in items:
        q, kinds, says = decontaminate.template(x)
        size = min(decontaminate.WINDOW, len(q))
        good = [a for a in range(len(q) - size + 1) if (kinds[a : a + size] == 0).sum() >= decontaminate.LITERALS]
        for k, (t, own, said) in enumerate(shapes):
            met = set()
            for shift in range(-len(q), len(t)):
                here = [a for a in good if a + shift >= 0 and a + shift + size <= len(t) and all(t[a + shift + j] == q[a + j] for j in range(size))]
                slots = {(int(kinds[a + j]), int(says[a + j]), int(said[a + shift + j])) for a in here for j in range(size) if kinds[a + j]}
                forth, back = {(a, b) for a, b, _ in slots}, {(a, c) for a, _, c in slots}
                if len(forth) == len(slots) == len(back):
                    met |= set(here)
            longest = max((sum(1 for _ in g) for _, g in itertools.groupby(enumerate(sorted(met)), lambda p: p[1] - p[0])), default=-size)
            if good and met and (len(met) / len(good) >= decontaminate.COVERAGE or longest + size - 1 >= decontaminate.LONG_RUN):
                found.add((k, i))
    return found


def test_leaks_against_all_alignments(spark):
    rng = random.Random(8)
    names, words = ["Tom", "Mary", "Jim", "Anna", "Bob"], ["gives", "takes", "apples", "pears", "market", "walks", "home", "then", "the", "with"]
    draw = lambda n: " ".join(rng.choice([rng.choice(words)] * 5 + [rng.choice(names), str(rng.randint(1, 30)), f"{rng.randint(1, 9)} km"]) for _ in range(n))
    items = [(i, draw(rng.randint(16, 40))) for i in range(12)]
    texts = []
    for _ in range(60):
        own = rng.choice(items)[1].split()
        new = {w: rng.choice(names) if w in names else str(rng.randint(1, 30)) for w in set(own) if w in names or w.isdigit()}
        own = [new.get(w, w) if rng.random() < 0.97 else w for w in own][: rng.randint(6, 40)]
        texts.append(f"{draw(rng.randint(1, 6))} {' '.join(own)} {draw(rng.randint(0, 6))}")
    want = brute_leaks(texts, items)
    assert 5 < len(want) < 60 and set(leaks(spark, texts, items)) == want


@pytest.mark.parametrize("size", [5, 17, 64])
def test_templates_do_not_hang_on_pieces(monkeypatch, size):
    from reelspark.llm import common

    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Tom ", "5 ", "km ", "kg\n", "3.5 ", "Éa ", ". ", "! Mary ", "12:30 ", "\n\n", "  "]) for _ in range(rng.randint(0, 60)))
        whole = decontaminate.template(text)
        with monkeypatch.context() as m:
            m.setattr(common, "_SEGMENT", size)
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(decontaminate.template(text), whole, strict=True))


def test_long_texts_match_at_every_offset(spark):
    texts = ["word " * n + ITEM for n in (0, 26205, 26210, 26213, 26215, 26218, 26240)]
    assert leaks(spark, texts, [(1, ITEM)]) == {(k, 1): "verbatim" for k in range(len(texts))}


# Vectors


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 5) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, kept int")


def brute_vectors(rows, limit=0.93):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out, n = Union([i for i, _, _ in rows if i is not None]), dict.fromkeys([i for i, _, _ in rows], 0)
    for (i, u, a), (j, v, b) in itertools.combinations(good, 2):
        if a == b and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= limit:
            n[i] += 1
            n[j] += 1
            out.join(i, j)
    return {i: (n[i], out.find(i)) for i, _, _ in rows if i is not None}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=64).tolist(), i % 3) for i in range(200)]
    for i in range(200, 420):
        base = np.array(rows[int(rng.integers(0, 12))][1])
        rows.append((i, (base + rng.normal(size=64) * rng.uniform(0.05, 0.6)).tolist(), int(rng.integers(0, 3))))
    rows += [(500 + i, rows[5][1], rows[5][2]) for i in range(30)] + [(600, None, 1), (601, [0.0] * 64, 1), (602, [float("nan")] * 64, 1), (603, [None] * 64, 1), (604, rows[5][1], None), (605, [], 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == brute_vectors(rows)
    none = embed_dedup.near_vectors(vectors(spark, [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)])).collect()
    assert [(r["n_links"], r["component_id"]) for r in none] == [(0, None)] * 2
    assert embed_dedup.near_vectors(vectors(spark, [])).count() == 0


def test_vectors_of_mixed_lengths(spark):
    rng, rows = np.random.default_rng(8), []
    for d in (64, 128, 70, 3):
        for _ in range(6):
            base = rng.normal(size=d)
            rows += [(len(rows) + k, (base + rng.normal(size=d) * 0.1 * k).tolist(), 1) for k in range(3)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == brute_vectors(rows) and all(sum(got[i][0] > 0 for i in range(at, at + 18)) > 9 for at in range(0, 72, 18))


def test_estimates_are_unbiased():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.08
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    errors = []
    for turn in range(20):
        q = embed_dedup.rotation(64, turn)
        a, b = x @ q.T, y @ q.T
        errors.append((np.sign(a) * b).sum(axis=1) / 8 / (np.abs(a).sum(axis=1) / 8) - (x * y).sum(axis=1))
    assert abs(np.mean(errors)) < 0.01 and np.allclose(q @ q.T, np.eye(64))
    bits, bands = embed_dedup.band_plan(100_000)
    assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** bands <= embed_dedup.MISS


# The pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    parts = {"en": ["the", "and", "ing", "ow"], "fr": ["le", "eau", "que", "é"]}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(30, 60))), lang))
    item = " ".join("".join(rng.choice(parts["en"]) for _ in range(2)) + str(k) * 0 + "xq" * (k % 3) for k in range(20))
    rows += [(100, rows[1][1], "en"), (101, edited(rng, rows[2][1] + " " + rows[4][1], 1), "fr"), (102, rows[2][1] + " " + rows[4][1], "fr"), (103, rows[5][1] + ". " + item, "en"), (104, " ".join(reversed(rows[7][1].split())) + " mail me@x.org now", "en"), (105, "", "en"), (106, None, "fr"), (107, "12 34", "en")]
    own = frame(spark, rows)
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = own
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == own.columns, name
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        was = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "language ID":
            model = langid.fit(before)
            assert kept.keys() == {i for i, t in was.items() if not model.predict(t)[2]} and not {105, 106, 107} & kept.keys() and len(kept) >= 84
        elif name == "near duplicates":
            want = classes(sorted(was.items()))
            assert kept.keys() == set(want.values()) and 100 not in kept and 102 not in kept
        elif name == "decontamination":
            assert was.keys() - kept.keys() == {103}
        else:
            assert kept == {i: pii.masked(t) for i, t in was.items()} and "[EMAIL]" in kept[104]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == kept.keys() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_pipeline_over_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
