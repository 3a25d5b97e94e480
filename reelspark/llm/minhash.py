"""Near duplicates by ProbMinHash over weighted word shingles, banding and verification.

A document is the multiset of its shingles of five words, each weighted by how often it occurs. Every shingle starts a
Poisson process of that rate; each arrival falls on one of REGISTERS registers, which keeps its earliest arrival. Arrivals later
than the latest register can't change anything, so a process ends there. Two documents agree in a register with
probability J_P, their probability Jaccard similarity (the plain Jaccard similarity where weights are even). Registers are
grouped into bands; documents that agree in a band are candidates, and the exact J_P of their texts decides (>= 0.8).

Groups of any size: documents with equal shingle multisets are one node from the start. In each bucket of a band first
only the least document meets the others, so a group of m near copies costs about m pairs. In buckets of up to SMALL documents that are
not one component by then, pairs of different components meet. Larger ones hold documents that share a passage but
aren't alike; those documents are put into new buckets by an exact prefix filter over their rare shingles, where the same goes on, more
documents meeting the others each round, until every bucket is one component or all its pairs were tested. No pair of different components that shares a band is left
out: the only miss is a pair with no band in common, at most 3e-6 for J_P = 0.8.

Shuffled are band keys (BANDS longs a document) and the texts of documents that share a bucket; ids are broadcast only if their count is
checked (BROADCAST_IDS), else joined by shuffle.

Edge cases: null and empty texts and texts of white space link with nothing; a text of fewer than five words has one
shingle of all its words; a null doc_id links with nothing and is kept (class_id null); rows that repeat a doc_id are one document and get one row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed, connected_components, map_texts, mix, shingles, small, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: In buckets of so many documents all pairs of different components meet; the number that do grows by this in larger ones.
SMALL = 32
#: Most ids that are broadcast (8 MB); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_GOLD, _ODD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Arrivals that fill all registers, mostly.
_ARRIVALS = int(REGISTERS * (np.log(REGISTERS) + 2))


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a whole text, sorted, and how often each occurs."""
    return np.unique(shingles(word_hashes(text), WORDS), return_counts=True)


def signature(hashes: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each register the shingle that arrives first."""
    best, who = np.full(registers, np.inf), np.zeros(registers, dtype=np.uint64)
    active, last = np.arange(len(hashes)), np.zeros(len(hashes))
    rate = weights.astype(np.float64)
    done = 0
    while len(active):
        columns = int(min(4096, max(1, -(-_ARRIVALS // len(active)))))
        turn = np.arange(done + 1, done + columns + 1, dtype=np.uint64) * _GOLD
        draw = mix(hashes[active][:, None] + turn[None, :])
        gap = -np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[active][:, None]
        times = np.cumsum(gap, axis=1) + last[active][:, None]
        draw *= _ODD
        draw ^= draw >> _U(32)
        register = (((draw & _U(0xFFFFFFFF)) * _U(registers)) >> _U(32)).astype(np.intp)
        last[active] = times[:, -1]
        flat, at = times.ravel(), register.ravel()
        early = np.flatnonzero(flat < best[at])
        early = early[np.argsort(-flat[early], kind="stable")]  # the earliest is written last
        best[at[early]] = flat[early]
        who[at[early]] = hashes[active][early // columns]
        done += columns
        active = active[last[active] < best.max()]
    return who


def band_keys(who: np.ndarray) -> np.ndarray:
    rows = who.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
    for i in range(ROWS):
        key = mix(key + rows[:, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity: the sum over common x of 1 / (sum over y of max(a(y)/a(x), b(y)/b(x)))."""
    (ha, wa), (hb, wb) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = wa.astype(np.float64), wb.astype(np.float64)
    xa, xb = wa[ia], wb[ib]
    order = np.argsort(xa / xb, kind="stable")
    xa, xb = xa[order], xb[order]
    first = np.searchsorted(xa / xb, xa / xb, side="left")
    head_a, head_b = np.concatenate(([0.0], np.cumsum(xa))), np.concatenate(([0.0], np.cumsum(xb)))
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    return float((1.0 / ((only_a + head_a[-1] - head_a[first]) / xa + (only_b + head_b[first]) / xb)).sum())


def signatures(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, a 128-bit digest (h1, h2) of the shingle multiset, and band keys; texts without words have none."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for part in bounded(batch):
                h1, h2, keys = [], [], []
                for text in part["text"]:
                    hashes, counts = weighted(text)
                    if len(hashes):
                        own = hashes + counts.astype(np.uint64) * _GOLD
                        h1.append(int(mix(own).sum().astype(np.int64)))
                        h2.append(int(mix(own * _ODD).sum().astype(np.int64)))
                        keys.append(band_keys(signature(hashes, counts)))
                    else:
                        h1.append(None)
                        h2.append(None)
                        keys.append([])
                yield {"doc_id": part["doc_id"], "h1": h1, "h2": h2, "keys": keys}

    columns = {"doc_id": F.col(id_column).cast("long"), "text": F.col(text_column)}
    return map_texts(documents, columns, run, "doc_id long, h1 long, h2 long, keys array<long>")


def semi(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """rows whose key is (or, left_anti, is not) in ids: by broadcast if there are few ids, counted first, else by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts(id, text) are at least so similar."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, own = None, None
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if held != x:
                    held, own = x, weighted(x)
                if similarity(own, weighted(y)) >= least:
                    a.append(i)
                    b.append(j)
            yield {"a": a, "b": b}

    both = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(small(pairs), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return map_texts(both, {c: F.col(c) for c in ("a", "b", "text_a", "text_b")}, run, "a long, b long")


def near_duplicates(documents: DataFrame, least: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept (it is that one): one row for each document."""
    own = checkpointed(signatures(documents, id_column, text_column))
    named = own.filter(F.col("doc_id").isNotNull() & (F.size("keys") > 0))
    nodes = checkpointed(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")))
    copies = named.select("doc_id", "h1", "h2").join(nodes.select("h1", "h2", "rep"), ["h1", "h2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    banded = nodes.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpointed(banded.join(buckets, "key"))
    edges = copies
    if not members.isEmpty():  # some bucket has two documents
        met = members.select("id").distinct()
        texts = checkpointed(
            semi(documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter(F.col("text").isNotNull()), checkpointed(met), "id")
        )
        edges = copies.unionByName(_links(members, texts, least).select(F.col("id").alias("a"), F.col("component").alias("b")))
    parts = connected_components(edges)
    ids = named_ids(own)
    out = ids.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
    out = out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = own.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def named_ids(own: DataFrame) -> DataFrame:
    return own.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()


class _Linker:
    """Pairs that were tested and those that are links; both grow from round to round."""

    def __init__(self, texts: DataFrame, least: float) -> None:
        self.texts, self.least = texts, least
        self.tested: DataFrame | None = None
        self.news: list[DataFrame] = []
        self.parts: DataFrame | None = None

    def test(self, pairs: DataFrame) -> None:
        """Verifies those of pairs (a < b, distinct) that weren't yet."""
        if self.tested is None:
            self.tested = checkpointed(pairs)
            self.news.append(checkpointed(verified(self.tested, self.texts, self.least)))
            return
        fresh = checkpointed(pairs.join(small(self.tested), ["a", "b"], "left_anti"))
        self.tested = checkpointed(self.tested.unionByName(fresh))
        self.news.append(checkpointed(verified(fresh, self.texts, self.least)))

    def components(self) -> DataFrame:
        """id, component of all linked documents: what was known, joined by the links found since."""
        for links in self.news:
            if self.parts is None:
                self.parts = connected_components(links)
                continue
            known = small(self.parts)
            of = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))  # noqa: B023, E731
            drawn = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
            drawn = checkpointed(drawn.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).filter("a <> b"))
            if drawn.isEmpty():
                continue
            joined = checkpointed(connected_components(drawn).withColumnRenamed("id", "k").withColumnRenamed("component", "c"))
            old = self.parts.join(small(joined), F.col("component") == F.col("k"), "left").select("id", F.coalesce("c", "component").alias("component"))
            new = joined.select(F.col("k").alias("id"), F.col("c").alias("component")).join(known.select("id"), "id", "left_anti")
            self.parts = checkpointed(old.unionByName(new))
        self.news = []
        return self.parts

    def leaders(self, members: DataFrame) -> None:
        """The least document of each bucket meets the others."""
        self.test(members.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())

    def split(self, members: DataFrame) -> DataFrame:
        """members of those buckets whose documents are not all of one component, with their component as part."""
        parts = small(self.components())
        own = [c for c in members.columns if c not in ("id", "leader", "part")]
        # A document's keys stand together while its component is looked up: one row a document in the join.
        lists = members.groupBy("id").agg(F.collect_list(F.struct(*own)).alias("keys")).join(parts, "id", "left")
        placed = lists.select("id", F.coalesce("component", "id").alias("part"), F.inline("keys"))
        open_keys = checkpointed(placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key"))
        return checkpointed(placed.join(small(open_keys), "key"))

    def meet(self, members: DataFrame, share: int) -> None:
        """About so many documents of each split bucket, all if it has no more, meet those of other components."""
        unit = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        bound = [c for c in ("r", "total", "common") if c in members.columns]
        chosen = checkpointed(members.filter(unit * F.col("n") < share).select("key", F.col("id").alias("x"), F.col("part").alias("px"), *[F.col(c).alias(f"{c}_x") for c in bound]))
        both = members.join(small(chosen), "key").filter(F.col("part") != F.col("px"))
        both = both.filter(_may_match(self.least, "_x")) if bound else both
        self.test(both.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct())


def _links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """id, component of the documents of members(key, id, leader, n) that are linked."""
    linker = _Linker(texts, least)
    linker.leaders(members)
    left = linker.split(members.filter("n > 2"))
    if left.isEmpty():
        return linker.components()
    linker.meet(left.filter(F.col("n") <= SMALL), SMALL)
    left = linker.split(left.filter(F.col("n") > SMALL))
    if left.isEmpty():
        return linker.components()
    # Large buckets of documents that mostly aren't alike: they share a passage. Only their rare shingles tell them apart.
    rare = _rare_buckets(semi(texts, left.select("id").distinct(), "id"), least)
    linker.leaders(rare)
    left, share = rare.filter("n > 2"), 1
    while True:
        left = linker.split(left.filter(F.col("n") > share))
        if left.isEmpty():
            return linker.components()
        # Few pairs pass the bound, so many documents of a key can meet at once.
        share *= SMALL * SMALL
        linker.meet(left, share)


def _may_match(least: float, other: str) -> Column:
    """Whether two documents of a key of _rare_buckets can be alike enough, by what each can have in common at most."""
    general = F.col("r") + F.col(f"r{other}") <= 1 / least - 1 + 1e-9
    even = F.least("common", f"common{other}") * (1 + least) >= least * (F.col("total") + F.col(f"total{other}")) - 1e-6
    # least() passes over a null; the bound holds only where no shingle repeats in either.
    flat = F.col("common").isNotNull() & F.col(f"common{other}").isNotNull()
    return general & (~flat | even)


#: Shingles counted together, and the most common ones that are told apart: bounds of the order by rarity, not of what is found.
CHUNK, COMMON = 1_000_000, 500_000


def _common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the texts share, sorted, and about how often: at most COMMON, the most frequent ones.

    Only the order in which shingles are tried depends on this; any fixed order finds the same pairs.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> dict:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys, n = keys[n > 1], n[n > 1]
            return {"key": keys.view(np.int64).tolist(), "n": n.tolist()}

        for batch in batches:
            for text in batch["text"]:
                held.append(weighted(text)[0])
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = map_texts(texts, {"text": F.col("text")}, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2")
    rows = found.orderBy(F.col("n").desc(), "key").limit(COMMON).toArrow()  # two numbers a row
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


#: Buckets of the map of shingles that more than one text has.
MAP_BITS = 23
#: Ranges that such maps are joined by.
SLICES = 32


def _shared_map(texts: DataFrame) -> np.ndarray:
    """For each bucket of shingles whether two of the texts or more have one of it: no shared shingle is missed.

    Each task makes a map of fixed size and gives it in SLICES parts; parts of one range are joined, each range by a task of its own. Where there are very many texts the map fills up, and then
    spares less work; results don't depend on it.
    """
    size = 1 << MAP_BITS

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen = None
        for batch in batches:
            seen = np.zeros(size, dtype=np.uint8) if seen is None else seen
            for text in batch["text"]:
                at = _bucket(weighted(text)[0])
                seen[at] = np.minimum(seen[at] + 1, 2)
        if seen is not None:
            one, two = (np.packbits(seen > k).reshape(SLICES, -1) for k in (0, 1))
            yield {"slice": list(range(SLICES)), "one": [zlib.compress(x.tobytes(), 1) for x in one], "two": [zlib.compress(x.tobytes(), 1) for x in two]}

    def join(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, x, y in zip(batch["slice"], batch["one"], batch["two"], strict=True):
                one, two = held.setdefault(part, (np.zeros(size // 8 // SLICES, dtype=np.uint8), np.zeros(size // 8 // SLICES, dtype=np.uint8)))
                a = np.frombuffer(zlib.decompress(x), dtype=np.uint8)
                two |= np.frombuffer(zlib.decompress(y), dtype=np.uint8) | (one & a)
                one |= a
        yield {"slice": list(held), "two": [two.tobytes() for _, two in held.values()]}

    maps = map_texts(texts, {"text": F.col("text")}, run, "slice int, one binary, two binary")
    joined = map_texts(maps.repartition(SLICES, "slice"), {c: F.col(c) for c in ("slice", "one", "two")}, join, "slice int, two binary")
    out = np.zeros((SLICES, size // 8 // SLICES), dtype=np.uint8)
    for row in joined.collect():  # SLICES rows, a map of fixed size in all
        out[row["slice"]] = np.frombuffer(row["two"], dtype=np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - MAP_BITS)).astype(np.intp)


def _rare_buckets(texts: DataFrame, least: float) -> DataFrame:
    """members(key, id, leader, n, r) by an exact prefix filter: every pair of texts(id, text) that is alike enough shares a key.

    If s and t are the shares of their weight that two documents have in common shingles, J_P is at most
    1 / (1 + (1 - s) / s + (1 - t) / t): the sum over common x of 1 / sum over y of max(a(y)/a(x), b(y)/b(x)) is least where
    the maximum is replaced by any mean of the two, and what is left is concave. So for J_P >= least both 1 - s and 1 - t
    are at most 1 - least, and in any fixed order of all shingles the first common one comes within the first
    1 - least of the weight of both; what stands before it is not common, so with r = before / (1 - before) the sum of both r is at
    most 1 / least - 1. Where no shingle repeats in either, J_P is k / (m + n - k) for k common ones of m and n, so what may be
    common in either bounds it more closely (null in common means that some shingle repeats). The order is by rarity: what many
    documents share comes last and makes few keys. The leader of a key is the document with the least r.
    """

    shared = np.packbits(_shared_map(texts))
    common = texts.sparkSession.sparkContext.broadcast((*_common_shingles(texts), shared))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known, often, bits = common.value
        shared = np.unpackbits(bits).astype(bool)
        for batch in batches:
            out: dict[str, list] = {"id": batch["id"], "total": [], "flat": [], "keys": [], "before": []}
            for text in batch["text"]:
                hashes, counts = weighted(text)
                total = int(counts.sum())
                rank = np.zeros(len(hashes), dtype=np.int64)
                if len(known) and len(hashes):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rank = np.where(known[at] == hashes, often[at], 0)
                order = np.lexsort((hashes, rank))
                before = (np.cumsum(counts[order]) - counts[order]) / max(total, 1)
                head = (before <= 1 - least + 1e-9) & shared[_bucket(hashes[order])]
                out["total"].append(total)
                out["flat"].append(bool(total == len(hashes)))
                out["keys"].append(hashes[order][head].view(np.int64).tolist())
                out["before"].append(before[head].tolist())
            yield out

    own = map_texts(texts, {"id": F.col("id"), "text": F.col("text")}, run, "id long, total long, flat boolean, keys array<long>, before array<double>")
    head = own.select("id", "total", "flat", F.explode(F.arrays_zip("keys", "before")).alias("k"))
    before = F.col("k.before")
    head = checkpointed(head.select(F.col("k.keys").alias("key"), "id", (before / (1 - before)).alias("r"), "total", F.when(F.col("flat"), F.col("total") * (1 - before)).alias("common")))
    first = F.min(F.struct("r", "id", "total", "common")).alias("first")
    groups = head.groupBy("key").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = checkpointed(groups.select("key", "n", F.col("first.id").alias("leader"), *[F.col(f"first.{c}").alias(f"{c}_l") for c in ("r", "total", "common")]))
    near = head.join(small(groups), "key")
    # The leader has the least r: a document that can't match it by r matches nobody of its key.
    return checkpointed(near.filter(F.col("r") + F.col("r_l") <= 1 / least - 1 + 1e-9).drop("r_l", "total_l", "common_l"))


def keep_one(documents: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """documents with one of each class of near duplicates, all columns as they were.

    Where an id is repeated, each (doc_id, text) is a document of its own, in that order: unlike texts under one id all stay, and of rows
    equal in both the one whose JSON comes first. Rows without an id are kept.
    """
    repeated = documents.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return semi(documents, checkpointed(near_duplicates(documents, least).filter(~F.col("kept")).select("doc_id")), "doc_id", "left_anti")
    text = F.coalesce(F.sha2("text", 256), F.lit(""))
    rows = documents.filter(F.col("doc_id").isNotNull())
    # Numbers that rise with (doc_id, text), fixed by being written.
    keys = rows.select(F.col("doc_id").alias("_id"), text.alias("_text")).distinct().repartitionByRange("_id", "_text").sortWithinPartitions("_id", "_text")
    keys = checkpointed(keys.withColumn("_key", F.monotonically_increasing_id()))
    keyed = rows.withColumn("_hash", text).join(keys, (F.col("doc_id") == F.col("_id")) & (F.col("_hash") == F.col("_text"))).drop("_id", "_text", "_hash")
    own = checkpointed(keyed.groupBy("_key").agg(F.min_by(F.struct(*documents.columns), F.to_json(F.struct(*documents.columns))).alias("r")).select("_key", "r.*"))
    gone = checkpointed(near_duplicates(own, least, "_key").filter(~F.col("kept")).select(F.col("doc_id").alias("_key")))
    return semi(own, gone, "_key", "left_anti").select(*documents.columns).unionByName(documents.filter(F.col("doc_id").isNull()))


