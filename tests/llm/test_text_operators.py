"""Operators that read each text by itself, against libraries, brute force and held-out rows; and their edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from reelspark.llm import attention_lm as lm
from reelspark.llm import bpe_count, html_text, langid, pii, piece_viterbi, toxicity
from reelspark.llm.vocabulary import Vocabulary, default_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, `key` string, uid long"
ODD = ["", " ", "  a  b ", "a\n\n b\t c", "日本語 text 😀 ▁x", "<s> </s> <unk> <0x0A>", "a" * 3000, "\x00 a", "naïve café — “quoted”"]


def frame(spark, rows):
    """Documents with more columns than are asked for, some with names that operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", None, 1.5, "x", "y", 7) for i, t, lang in rows], DOCS)


EDGE = [(1, None, "en"), (2, "", "en"), (3, "the cat and the dog of the house", "en"), (3, "the cat and the dog of the house", "en"), (None, "le chat et la maison de la ville", None), (4, "12 34 !!", "fr"), (5, "word " * 30000, "en"), (6, "le chat et la maison de la ville", "fr"), (8, "x" * 50000, None)]


@pytest.mark.parametrize("name", ["pii", "bpe", "langid", "pieces", "lm", "toxicity"])
def test_edge_rows(spark, name):
    labels = spark.createDataFrame([(3, 1, 1), (6, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    run = {
        "pii": pii.find_spans, "bpe": bpe_count.token_counts, "langid": langid.identify, "pieces": lambda d: piece_viterbi.digests(piece_viterbi.encode_documents(d)),
        "lm": lambda d: lm.score_documents(d, steps=5), "toxicity": lambda d: toxicity.toxicity(d, labels),
    }[name]
    got = run(frame(spark, EDGE)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _, _ in EDGE)
    by = {r["doc_id"]: r.asDict() for r in got}
    if name == "bpe":
        assert (by[1]["n_tokens"], by[1]["n_bytes"], by[5]["over_limit"]) == (0, 0, True)
    if name == "langid":
        assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[4]["lang_pred"] == "und" and by[1]["score"] == 0
    if name == "pieces":
        assert all(r["round_trip"] for r in got) and by[1]["n_tokens"] == 0
    if name == "lm":
        assert by[1]["n_tokens"] == by[2]["n_tokens"] == 1 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    empty = run(frame(spark, []))
    assert empty.count() == 0 and empty.columns == list(by[1])


# Token counts


def test_merges_count_as_the_library_does():
    own, library = bpe_count.PairMerger(Vocabulary.load(default_path())), sentencepiece.SentencePieceProcessor(model_file=default_path())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" aethnoi.\n,éß▁😀01") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert own.text(t) == len(library.encode(t)), t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_counts_as_in_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=default_path())
    assert bpe_count.merger(default_path()).text(text) == len(library.encode(text))


# Pieces


def brute_viterbi(coder, word):
    best = {0: (0.0, ())}
    normal, scores = coder.vocabulary.normal, coder.vocabulary.scores
    for end in range(1, len(word) + 1):
        options = []
        for at in range(end):
            i = normal.get(word[at:end])
            if i is not None:
                options.append((best[at][0] + scores[i], at, (*best[at][1], i)))
        if word[end - 1] not in normal:
            options.append((best[end - 1][0] + coder.low, end - 1, (*best[end - 1][1], *coder._unknown(word[end - 1]))))
        top = max(options, key=lambda o: (o[0], -o[1]))
        best[end] = (top[0], top[2])
    return list(best[len(word)][1])


def test_pieces_against_brute_force():
    own = piece_viterbi.coder(default_path())
    rng = random.Random(2)
    words = sorted({"▁" + "".join(rng.choice("aethnoisé😀.") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    packed = own.encode_words(words)
    for w in words:
        assert np.frombuffer(packed[w], own.kind).tolist() == brute_viterbi(own, w), w


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_characters="▁", exclude_categories=["Cs"]), max_size=60))
def test_pieces_round_trip(text):
    own = piece_viterbi.coder(default_path())
    (ids,) = own.encode([text])
    assert own.decode(ids) == text


# Personal data

_E, _I = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_C, _P = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in _E.finditer(text)] + [(m.start(), 1, m.end()) for m in _I.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _C.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in _P.finditer(text) if 9 <= len(digits(m)) <= 15])


PARTS = ["4111111111111111", " ", ".", "1", "255", "256", "a@b.c", "+1 ", "(988) ", "555-2485", "é", "-", "@", "x.", "_", "a at b dot c", "٣"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    base, every = pii.find(text)
    assert base == plain_spans(text) and set(base) <= set(every)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail john (at) example (dot) com now", "email:5:32"), ("john at example dot com", "email:0:23"), ("j@exаmple.com now", "email:0:13"), ("４１１１１１１１１１１１１１１１ x", "card:0:16"),
        ("joe[at]mail3.example.com", "email:0:24"), ("plus one nine eight eight five five five two four eight five", "phone:0:60"), ("We met at noon. dot com", ""), ("one two three", ""),
    ],
)
def test_disguises(text, want):
    base, every = pii.find(text)
    assert not base and pii.joined(every) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a 4111–1111–1111–1111 b", "card:2:21"), ("+49–151–23456789", "phone:0:16"), ("+49 (151)–23456789", "phone:0:18"), ("4111\xa01111\xa01111\xa01111", "card:0:19"),
        ("joe@my–site.com", "email:0:15"), ("john\xa0at\xa0example\xa0dot\xa0com", "email:0:23"), ("from 1990 – 2000, so – it went", ""),
    ],
)
def test_disguises_by_common_characters(text, want):
    base, every = pii.find(text)
    assert not base and pii.joined(every) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("to john@exam\u200bple.com now", "email:3:20"), ("4111\u200b1111\u200d1111\u20601111", "card:0:19"), ("+49\xad151\ufeff23456789", "phone:0:16"),
        ("a\u200b john@example.com \u200cb", "email:3:19"), ("\u200b12.0.0.1\u200b", "ip:1:9"),
    ],
)
def test_disguises_by_dropped_characters(text, want):
    base, every = pii.find(text)
    assert pii.joined(every) == want and (not base or base == every)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("+49\u00a0170\u00a01234567", [(0, 3, 15)]), ("john\u00ad@example.com", [(0, 0, 17)]), ("+49\u2013170\u20131234567", [(0, 3, 15)]), ("john_ at example dot com", [(0, 0, 24)]), ("jo- at x.example.org", [(0, 0, 20)]),
        ("arrive at 5.30 with un ou deux", []), ("(+49 one seven zero 1234567)", [(1, 3, 27)]),
    ],
)
def test_disguises_stand_alone(text, want):
    """A disguise is found by itself, and no less beside another."""
    assert pii.find(text)[1] == want
    assert [x for x in pii.find(text + " \uff20 [at] ")[1] if x[2] <= len(text)] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["one", "Two", "un", "7", "12abc", "abc12", "plus", "at", "dot", "x", "é3", " ", " ", ", ", "-", ".", "(", ")", "[at]", "\n", "+"]), max_size=25))
def test_shapes_leave_nothing_out(parts):
    text = "".join(parts)
    every = pii._pattern(tuple(pii._SHAPES))
    shapes = pii._shapes(text)
    assert [m.span() for m in every.finditer(text) if m.lastgroup != "run" or pii._SPELLED_WORD.search(m[0])] == [m.span() for m in (pii._pattern(shapes).finditer(text) if shapes else ()) if m.lastgroup != "run" or pii._SPELLED_WORD.search(m[0])]


def test_masking():
    assert pii.masked("a john@x.org b +1 (988) 555-2485.") == "a [EMAIL] b [PHONE]." and pii.masked(None) is None and pii.masked("plain") == "plain"


# Language


def syllables(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_held_out(spark):
    rng, parts = random.Random(3), {"aa": ["ki", "lo", "mi"], "bb": ["zur", "ech", "ung"], "cc": ["qué", "ión", "lla"]}
    rows = [(i, syllables(rng, parts[lang], rng.randint(4, 60)), lang) for i, lang in zip(range(600), itertools.cycle(parts), strict=False)]
    got = langid.identify(frame(spark, rows)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held) >= 0.99 * len(held)


@pytest.mark.parametrize(("text", "letters"), [("½", False), ("²", False), ("Ⅳ", False), ("12 _ 3!", False), ("", False), (None, False), ("ª", True), ("日本", True), ("1a", True)])
def test_letters(text, letters):
    rng = np.random.default_rng(1)
    model = langid.from_counts(["a", "b"], rng.integers(0, 9, (2, langid.BUCKETS)).astype(float))
    assert (model.predict(text)[0] != "und") is letters


def test_codewords():
    for k in (2, 3, 4, 5, 6, 12, 40):
        code = langid.code_matrix(k)
        assert code.shape[0] == k and len({tuple(r) for r in code.tolist()}) == k and (np.abs(code.sum(axis=0)) < k).all()
    one = langid.from_counts(["xx"], np.ones((1, langid.BUCKETS)))
    assert one.predict("abc") == ("xx", 1.0, False) and langid.from_counts([], np.zeros((0, langid.BUCKETS))).predict("abc")[0] == "und"


# Toxicity


def test_toxic_documents_held_out(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = syllables(rng, ["ka", "to", "ri", "nel", "sha"], rng.randint(20, 80)).split()
        for _ in range(len(words) // 12 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grubloser", "vexqu" + rng.choice(["an", "or", "il"])]))
        rows.append((i, " ".join(words), "en"))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity(frame(spark, rows), labels).collect() if r["held_out"]]
    assert len(got) > 100 and sum(r["predicted"] == marks[r["doc_id"]][2] for r in got) >= 0.98 * len(got)


def brute_kinds(classes):
    """The kinds of a clause read off its words, without machines."""
    out = []
    for i, x in enumerate(classes):
        aimed, reported = any(c & toxicity.TARGET for c in classes), any(c & toxicity.REPORT for c in classes[: i + 1])
        negated = any(c & toxicity.NEGATION for c in classes[max(0, i - toxicity.REACH) : i])
        own = [3 if reported else 2 if negated else 1 if aimed else 0] if x & toxicity.INSULT else []
        out.append(tuple(own + ([5 if aimed else 4] if x & toxicity.THREAT and not reported and not negated else [])))
    return out


def test_machine_against_enumeration():
    """All short clauses: the composed machine gives one path, that of the rules, and the same as its parts run one after another."""
    words = [0, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT, toxicity.THREAT, toxicity.INSULT | toxicity.TARGET]
    for n in range(5):
        for clause in itertools.product(words, repeat=n):
            weight, kinds = toxicity.CLAUSE.best(clause)
            assert kinds == brute_kinds(clause) and weight == sum(map(len, kinds))
    rng = random.Random(4)
    for _ in range(300):
        clause = [rng.choice(words) for _ in range(rng.randint(5, 30))]
        assert toxicity.CLAUSE.best(clause)[1] == brute_kinds(clause)


def paths(machine, symbols):
    """Every accepting path by enumeration: (weight, outputs)."""
    found = [(0.0, [], x) for x in machine.starts]
    for s in symbols:
        found = [(w + v, [*o, out], to) for w, o, x in found for out, v, to in machine.arcs[x][s]]
    return [(w, o) for w, o, x in found if x in machine.finals]


def test_composition_against_enumeration():
    """Random machines: the paths of a composition are those of the second over what the first writes, with weights added."""
    rng = random.Random(5)

    def drawn(alphabet, out):
        rows = {(s, x): [(rng.choice(out), float(rng.randint(-3, 3)), rng.randrange(3)) for _ in range(rng.randint(0, 2))] for s in range(3) for x in alphabet}
        good = {x for x in range(3) if rng.random() < 0.7}
        return toxicity.Transducer([0, 1], good.__contains__, alphabet, lambda s, x: rows[s, x])

    for _ in range(60):
        one, two = drawn("ab", "xyz"), drawn("xyz", "pq")
        both = one.then(two)
        for word in itertools.product("ab", repeat=4):
            want = sorted((w + v, o) for w, mid in paths(one, word) for v, o in paths(two, mid))
            assert sorted(paths(both, word)) == want
            got = both.best(word)
            assert (got[0] if got else None) == (want[-1][0] if want else None)


def test_score_ties_and_both_labels(spark):
    """A score of exactly the threshold counts as toxic; a document with both labels is toxic in the fit."""
    docs = frame(spark, [(i, f"text number {i} with some words", "en") for i in range(6)])
    grammar = toxicity.Grammar()
    same = grammar.score("text number 0 with some words")
    assert {r["predicted"] for r in toxicity.score_documents(docs, grammar, threshold=same).collect()} == {1}
    labels = spark.createDataFrame([(i, 1, t) for i in range(6) for t in (0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 6


def test_clause_kinds():
    g = toxicity.Grammar({"idiot$": 2.0})
    kind = lambda t: [toxicity.KINDS[i] for i in np.flatnonzero(g.clauses(t)[0])]
    assert kind("what an idiot") == ["insult"] and kind("you are an idiot.") == ["aimed insult"] and kind("he is not an idiot") == ["negated insult"]
    assert kind("she said he is an idiot") == ["reported insult"] and kind("she left. Idiot!") == ["insult"] and kind("i will kill you") == ["aimed threat"]
    assert kind("not today. an idiot") == ["insult"] and kind("the 1d10t left") == ["insult"] and kind("") == []
    assert g.score("you idiot") > g.score("nobody is an idiot") > g.score("a fine day")


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use the cookies of the web to make it all better for you.</div>
<article><header><h1>A &amp; B</h1></header><p>First  <b>bold</b>&nbsp;text<br>after break<p>Second &lt;p&gt; one<!-- no --><div class="ad">Buy</div><form>Name <input></form></article>
<section id="comments"><p>The reader says that this is the best of all the texts that there are on the web.</p></section><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "A & B\nFirst bold text\nafter break\nSecond <p> one"


def test_page_without_article():
    good = "This is the story of a man who lived in the house by the sea and had no one to talk to for a long time."
    links = '<div><a href="/1">one of the many</a> <a href="/2">two of the many</a></div>'
    page = f"<body>{links}<h2>Far</h2><h2>Near</h2><div>{good}</div><div>between</div><div>{good}</div><div>edge</div>{links}</body>"
    # Ambiguous blocks go with the nearer neighbour; between one that is in and one that is out they are out.
    assert html_text.main_text(page).split("\n") == ["Near", good, "between", good]


KEPT = "<article><p title='hidden costs'>A.<p data-id=share>B.<div aria-hidden=false>C.</div><p class='related-work'>D.</p><section id=notice-of-award>E.</section><div class='related-posts'>X</div><div class='cookie-notice-2'>Y</div><p>F.</article>"


def test_attributes_of_pages():
    assert html_text.main_text(KEPT) == "A.\nB.\nC.\nD.\nE.\nF."
    for n in range(1, 9):
        assert html_text.main_text(f"<article><span class='ad'>{'<div>' * n}x</span><p>Kept one.") == "Kept one."


def brute_labels(found, given):
    """Pass two by looking at all pairs of blocks."""
    out = []
    for i, block in enumerate(found):
        if given[i][0] >= 0 or block.out:
            out.append(given[i][0])
            continue
        own = [j for j, b in enumerate(found) if b.article == block.article and not b.out]
        ways = sorted((abs(own.index(i) - k), j) for k, j in enumerate(own) if given[j][0] >= 0)
        near = [given[j][0] for d, j in ways if d == ways[0][0]]
        if not near:
            out.append(int(bool(block.article) or not any(x[0] == 1 for x in given)))
        elif len(near) == 1 or len(set(near)) == 1:
            out.append(near[0])
        else:
            out.append(1 if block.article else near[1] if block.heading else 0)
    return out


def test_neighbours_against_all_pairs():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(0, 14)
        found = [html_text.Block("x", 0, rng.random() < 0.2, rng.choice([0, 0, 1, 2]), rng.random() < 0.3) for _ in range(n)]
        given = [(0, "mark") if b.out else (rng.choice([-1, -1, 0, 1]), "") for b in found]
        assert [x for x, _ in html_text.second_pass(found, given)] == brute_labels(found, given)


def test_blocks_are_decided_by_density_and_neighbours(sf_dir="/root/testdata/sf0.01"):
    """On the shared pages: the share of blocks that links, density, length or neighbours decide, and not what an element says of itself."""
    import pyarrow.parquet as pq

    by = Counter(why for page in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist() for _, why in html_text.labelled(page)[1])
    assert (by["links"] + by["density"] + by["length"] + by["neighbour"]) / by.total() > 0.85


def test_pages_of_any_size(spark):
    schema = "page_id long, url string, html string, text int"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<p>The cat is on the mat and the dog is in the yard of the house.</p>" * 40_000 + "<b>" * 20_000 + "</b>" * 20_000 + "</article>"
    row = html_text.extract(spark.createDataFrame([(1, "u", long, 5), (None, None, None, None)], schema)).filter("page_id = 1").first()
    assert row["n_chars"] == len(row["text"]) and row["text"].count("\n") == 39_999


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<script>", "<p>x", "&", "<a b='", "text only", "<div><div><div>", "</p></p>", "<p>a</div>b"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["text"] == "" for r in got) == 2


# Language model


def test_base_scores(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["The", "cat", "sat", "éa", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 40))), "en") for i in range(120)]
    got = {r["doc_id"]: r for r in lm.score_documents(frame(spark, rows), steps=20).collect()}
    seen: Counter = Counter()
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update([*lm.tokens(t), None])
    n, v = sum(seen.values()), len(seen)
    for i, t, _ in rows:
        own = [*lm.tokens(t), None]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(seen[w] > 0 for w in own), n)


def output(n=300, seed=9):
    return lm.Output.of(np.sort(np.random.default_rng(seed).integers(1, 1000, n))[::-1].astype(float))


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.fresh_weights(np.zeros(lm.HEAD), 300).items()}
    for k in "UV":
        w[k] += rng.normal(0, 0.1, w[k].shape)
    out = output()
    out.log_counts = out.log_counts.astype(np.float64)
    symbols = rng.integers(0, 300, 70)
    batch = lm.Model(None, out, w).windows(symbols)
    _, d = lm.gradients(w, out, *batch)
    far = int(symbols[symbols >= lm.OWN][0])
    for k in w:
        at = (int(symbols[3]), 2) if k == "E" else (far, 1) if k == "V" else tuple(rng.integers(0, s) for s in w[k].shape)
        old = w[k][at]
        w[k][at] = old + 1e-4
        up, _ = lm.gradients(w, out, *batch)
        w[k][at] = old - 1e-4
        down, _ = lm.gradients(w, out, *batch)
        w[k][at] = old
        assert (up - down) / 2e-4 == pytest.approx(d[k][at], rel=2e-2, abs=1e-6), k


def distribution(model, inputs):
    """Log probabilities of all symbols after each window place, by the definition."""
    logits, s = lm.forward(model.weights, inputs, keep=True)
    logits = logits.astype(np.float64)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    out = np.empty((len(logits), len(model.weights["V"])))
    out[:, : lm.OWN] = logits[:, : lm.OWN]
    for i, (a, b) in enumerate(itertools.pairwise(model.output.bounds)):
        q = (s["g"] @ model.weights["V"][a:b].T + model.output.log_counts[a:b]).astype(np.float64)
        out[:, a:b] = logits[:, [lm.OWN + i]] + q - np.log(np.exp(q).sum(axis=1, keepdims=True))
    return out


def test_symbols_alone_are_those_of_the_text():
    cutter = lm.Cutter(lm.Vocabulary.load(lm.default_path()))
    model = lm.Model(np.arange(len(lm.Vocabulary.load(lm.default_path()).pieces) + 1, dtype=np.uint16), None, {})
    reading, both = lm.Reader(cutter, model, {}), lm.Reader(cutter, model, {b"the": 1.0})
    for text in ("", "the cat and the dog", "the cat again", "x" * 200 + " the " + "x" * 200, "\u00e4\u4e2d \U0001f600"):
        words = lm.tokens(text)
        assert reading.only(words).tolist() == both.text(words)[0].tolist() == both.only(words).tolist()


def test_loss_by_definition_with_padding_and_large_scores():
    rng = np.random.default_rng(4)
    for scale in (1.0, 40.0):
        model = lm.Model(None, output(), lm.fresh_weights(rng.normal(size=lm.HEAD), 300))
        for k in ("U", "V"):
            model.weights[k] += rng.normal(0, 0.3, model.weights[k].shape).astype(np.float32)
        for k in ("E", "b"):
            model.weights[k] *= np.float32(scale)
        parts = [model.windows(rng.integers(0, 300, n)) for n in (5, 40)]
        inputs, targets, real = (np.concatenate(x) for x in zip(*parts, strict=True))
        loss, d = lm.gradients(model.weights, model.output, inputs, targets, real)
        told = distribution(model, inputs)
        told = told[np.arange(len(told)), np.where(real, targets, 0).ravel()][real.ravel()]
        assert loss == pytest.approx(-np.maximum(told, np.log(1e-30)).mean(), rel=1e-4)
        assert all(np.isfinite(g).all() for g in d.values())


def test_each_id_is_scored_once():
    rng = np.random.default_rng(1)
    model = lm.Model(None, output(), lm.fresh_weights(rng.normal(size=lm.HEAD), 300))
    for k in "UV":
        model.weights[k] += rng.normal(0, 1, model.weights[k].shape).astype(np.float32)
    texts = [rng.integers(0, 300, n).astype(np.uint16) for n in (1, 15, 16, 17, 33, 100)]
    for symbols, got in zip(texts, lm.log10_probabilities(model, texts, size=3), strict=True):
        inputs, targets, real = model.windows(symbols)
        assert real.sum() == len(symbols) and targets[real].tolist() == symbols.tolist()
        want = distribution(model, inputs)
        assert np.exp(want).sum(axis=1) == pytest.approx(1, rel=1e-4)
        assert got == pytest.approx(want[np.arange(len(want)), np.maximum(targets.ravel(), 0)][real.ravel()].sum() / math.log(10), rel=1e-5)


@pytest.mark.parametrize("n", [1, 2, 40, 64, 65, 100, 200, 5000])
def test_groups_cover_all_symbols(n):
    counts = np.random.default_rng(n).integers(0, 50, n).astype(float)
    model = lm.build(None, counts)
    out, every = model.output, np.arange(len(model.weights["V"]))
    assert sorted(model.symbol_of.tolist()) == list(range(n)) and (np.diff(out.bounds) >= 0).all() and out.bounds[0] == lm.OWN and out.bounds[-1] == len(every)
    kinds = out.classes(every)
    assert kinds[: lm.OWN].tolist() == list(range(lm.OWN)) and kinds.max() < lm.HEAD
    found = sorted((int(p), group.start + int(w)) for group, where, who in out.groups(every) for p, w in zip(where, who, strict=True))
    assert found == [(i, i) for i in range(lm.OWN, len(every))]
    # Untrained, every id has its share of the counts plus one.
    got = lm.log10_probabilities(model, [model.symbol_of[[i]] for i in range(min(n, 20))])
    assert got == pytest.approx(np.log10((counts[: len(got)] + 1) / (counts.sum() + len(every))), abs=1e-4)


def test_training_learns():
    own = np.array([1, 2, 3, 4, 200, 250] * 140, dtype=np.uint16)
    model = lm.Model(None, output(), lm.fresh_weights(np.zeros(lm.HEAD), 300))
    losses = lm.train(model, [own], steps=200, batch=32)
    assert losses[0] > 4 and losses[-1] < 0.3


def test_held_out_below_unigram():
    """On the shared documents: held-out bits an id of the trained model are fewer than those of the counts of the same ids, by half a bit at least."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    cutter = lm.Cutter(Vocabulary.load(default_path()))
    ids = [[*itertools.chain.from_iterable(cutter.word(w) for w in lm.tokens(r["text"])), -1] for r in rows]
    counts = np.zeros(len(Vocabulary.load(default_path()).pieces) + 1)
    for own, out in zip(ids, held, strict=True):
        if not out:
            np.add.at(counts, own, 1)
    model = lm.build(cutter, counts)
    texts = [model.symbol_of[own] for own in ids]
    shown = [t for t, out in zip(texts, held, strict=True) if out]
    size = sum(map(len, shown))
    before = -lm.log10_probabilities(model, shown).sum() / size / math.log10(2)
    assert before == pytest.approx(-np.mean(np.log2((counts[np.concatenate([o for o, out in zip(ids, held, strict=True) if out])] + 1) / (counts.sum() + len(counts)))), abs=1e-3)
    lm.train(model, [t for t, out in zip(texts, held, strict=True) if not out], 300)
    after = -lm.log10_probabilities(model, shown).sum() / size / math.log10(2)
    print(f"held-out bits an id: {before:.3f} by counts, {after:.3f} by the model")
    assert after < before - 0.5


def test_every_id_is_told_apart():
    rng = np.random.default_rng(2)
    counts = np.arange(400, 0, -1).astype(float)
    model = lm.build(None, counts)
    assert sorted(model.symbol_of.tolist()) == list(range(400)) and model.symbol_of[-1] == lm.OWN - 1
    model.weights["U"] += rng.normal(0, 1, model.weights["U"].shape).astype(np.float32)
    # Two contexts that differ only in ids beyond the classes of their own.
    a, b = model.symbol_of[[1, 300, 5, -1]], model.symbol_of[[1, 301, 5, -1]]
    got = lm.log10_probabilities(model, [a, b])
    assert abs(got[0] - got[1]) > 1e-4


def test_all_documents_are_learnt_from(spark):
    rows = [(i, " ".join(["one", "two", "three", "four"] * 100), "en") for i in range(64)]
    # No steps over the sample: what is learnt comes from the rounds.
    got = [r for r in lm.score_documents(frame(spark, rows), sample=1, steps=0, batch=2).collect() if r["held_out"]]
    assert got and all(r["score"] / r["n_tokens"] > -0.3 for r in got)  # -0.6 by counts alone
    w = lm.fresh_weights(np.arange(lm.HEAD), 300)
    assert all((v == w[k]).all() for k, v in lm.weights_of(lm.rows_of(w), w).items())


def test_longest_pieces():
    vocabulary = Vocabulary.load(default_path())
    cutter, rng = lm.Cutter(vocabulary), random.Random(0)
    for _ in range(2000):
        text, out, at = "▁" + "".join(rng.choice("aethnoç日😀.,▁thein1") for _ in range(rng.randint(1, 12))), [], 0
        while at < len(text):
            for size in range(min(20, len(text) - at), 0, -1):
                if text[at : at + size] in vocabulary.normal:
                    out.append(vocabulary.normal[text[at : at + size]])
                    break
            else:
                size = 1
                out += [vocabulary.byte_ids[b] for b in text[at].encode()]
            at += size
        assert cutter.word(text[1:].encode()) == out
