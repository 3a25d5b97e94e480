"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words within a sentence) and units (after a number) give way to typed
placeholders, all other words stay in lower case without punctuation. Windows of WINDOW template tokens are hashed and joined
by hash, benchmark against documents. A match that a document shares with an item on one alignment must fill the slots
consistently: a value of the item always stands for one value of the document and the other way round. So copies are caught with their
numbers or names replaced, while texts that merely share a form are not. A document leaks an item if consistent matches
cover half of the item's windows or LONG_RUN tokens of it in a row.

Template windows need LITERALS tokens that are no placeholders; items of fewer than WINDOW tokens have one window of their own length.
An item without any such window (short, or dense in numbers and names) is matched word for word instead: windows of what its tokens say,
all of which a document must hold; an item of fewer than WORDS tokens leaks only where it is the whole document, since
so few words stand in any text.

The benchmark's windows are broadcast only if their number is checked: the hashes (BROADCAST_WINDOWS), which then thin out the documents'
windows before the join, and the rows that are joined (BROADCAST_ROWS). Beyond that all windows of the documents are joined by shuffle. Either way each
document's matches are gathered by (document, item), never by item or window.

Long texts are read in pieces so that tables stay small; whether a sentence or a number goes on is carried from piece to piece, so a
piece's border changes nothing.

Edge cases: null and empty texts match nothing; rows with a null doc_id or item_id are left out of the result (a pipeline keeps
such documents); repeated rows count once; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _segments, bounded, checkpointed, map_texts, runs, shingles, span_hashes

WINDOW = 8
LITERALS = 5
COVERAGE = 0.5
LONG_RUN = 20
#: Fewest words of an item that may leak as part of a longer text.
WORDS = 3
#: Most hashes of benchmark windows that are broadcast (8 MB), and most rows of them, of two arrays of up to WINDOW numbers each (30 MB).
BROADCAST_WINDOWS, BROADCAST_ROWS = 1_000_000, 150_000
LITERAL, NUMBER, NAME, UNIT = range(4)
#: Units, fixed values.
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years kmh mph hz khz mhz ghz kb mb gb tb w kw v a percent pct dollar dollars euro euros cent cents usd eur"
_PLACE = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03], dtype=np.uint64)

_TABLE = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 digit, 4 joins digits, 8 ends a sentence
_TABLE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_TABLE[[*range(0x30, 0x3A)]] = 2
_TABLE[[ord(c) for c in ",/"]] = 4
_TABLE[[ord(c) for c in ".:"]] = 4 | 8
_TABLE[[ord(c) for c in "!?;\n|"]] = 8


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0]


_UNITS = np.array(sorted(_hash(w) for w in UNITS.split()), dtype=np.uint64)


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its hash in the template, its kind, and the hash of what it says."""
    found, state = [], (True, False)
    for part in _segments(text.encode("utf-8", "surrogatepass")) if text else ():
        own, state = _template(part, state)
        found.append(own)
    if not found:
        return _NONE
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


_NONE = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint64)


def _template(part: bytes, state: tuple[bool, bool]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[bool, bool]]:
    """The tokens of a piece that ends at white space; state: a sentence begins here, and the last token was a number."""
    begins, numbered = state
    data = np.frombuffer(part, dtype=np.uint8).copy()
    n = len(data)
    kind = _TABLE[data]
    after = np.append(data[1:], 0)
    if not part.isascii():
        # Typographic punctuation and Latin-1 signs are no letters; Latin-1 capitals are told by their second byte.
        wide = np.flatnonzero((data == 0xE2) & (after == 0x80))
        for k in range(3):
            kind[np.minimum(wide + k, n - 1)] = 0
        signs = np.flatnonzero(data == 0xC2)
        for k in range(2):
            kind[np.minimum(signs + k, n - 1)] = 0
        latin = (data == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    else:
        latin = np.zeros(n, dtype=bool)
    digit = kind == 2
    word = (kind == 1) | digit
    inner = (kind & 4) > 0
    if n > 2 and inner.any():
        inner[0] = inner[-1] = False
        at = np.flatnonzero(inner)
        word[at[digit[at - 1] & digit[at + 1]]] = True
    capital = ((data >= 0x41) & (data <= 0x5A)) | latin
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    data[np.flatnonzero(latin) + 1] += 0x20
    starts, ends = runs(word)
    stop = np.concatenate(([0], np.cumsum(((kind & 8) > 0) & ~word)))
    if not len(starts):
        return _NONE, (begins or bool(stop[-1]), numbered)
    value = span_hashes(data, starts, ends)
    digits = np.concatenate(([0], np.cumsum(digit)))
    number = digits[ends] > digits[starts]
    first = np.ones(len(starts), dtype=bool)
    first[0] = begins or bool(stop[starts[0]])
    first[1:] = stop[starts[1:]] > stop[ends[:-1]]
    name = capital[starts] & ~first & ~number
    unit = np.concatenate(([numbered], number[:-1])) & ~number
    if unit.any():
        unit[unit] = np.isin(value[unit], _UNITS)
    kinds = np.zeros(len(starts), dtype=np.uint8)
    kinds[name], kinds[number], kinds[unit] = NAME, NUMBER, UNIT
    return (np.where(kinds > 0, _PLACE[kinds], value), kinds, value), (bool(stop[-1] > stop[ends[-1]]), bool(number[-1]))


#: Keeps windows of what is said apart from those of templates.
_VERBATIM = np.uint64(0x8CB92BA72F3D8DD7)


def verbatim(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of what so many tokens say; of fewer than WORDS tokens only if they are the whole text."""
    if len(values) < size or not size or (size < WORDS and len(values) != size):
        return np.zeros(0, np.uint64)
    return shingles(values, size) ^ _VERBATIM


def windows(tokens: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of so many tokens, and which have literals enough."""
    if len(tokens) < size or size < LITERALS:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    literal = np.concatenate(([0], np.cumsum(kinds == LITERAL)))
    return shingles(tokens, size), literal[size:] - literal[:-size] >= LITERALS


def _own_size(tokens: np.ndarray, kinds: np.ndarray) -> int:
    """The size of an item's windows; less than 0 if they are of what it says."""
    size = min(WINDOW, len(tokens))
    return size if windows(tokens, kinds, size)[1].any() else -size


def _rows(key: str, fixed: frozenset | None, wanted):
    """A mapper that gives the windows of each text: of the sizes in fixed (less than 0: of what is said), or of an item's own size; only wanted ones."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names = (key, "size", "total", "tokens", "hash", "at", "kinds", "values")
        hashes = wanted.value if wanted is not None else None
        if hashes is not None and not len(hashes):
            return
        if hashes is not None:
            bits = np.zeros(1 << 22, dtype=bool)
            bits[(hashes & np.uint64((1 << 22) - 1)).astype(np.intp)] = True
        for batch in batches:
            for part in bounded(batch):
                out: dict[str, list] = {n: [] for n in names}
                for i, text in zip(part[key], part["text"], strict=True):
                    tokens, kinds, values = template(text)
                    for size in sorted(fixed) if fixed is not None else [_own_size(tokens, kinds)]:
                        if size > 0:
                            hashed, good = windows(tokens, kinds, size)
                        else:
                            hashed = verbatim(values, -size)
                            good = np.ones(len(hashed), dtype=bool)
                        total = int(good.sum())
                        if hashes is not None and total:
                            good &= bits[(hashed & np.uint64((1 << 22) - 1)).astype(np.intp)]
                            near = np.flatnonzero(good)
                            good = near[hashes[np.minimum(np.searchsorted(hashes, hashed[near]), len(hashes) - 1)] == hashed[near]] if len(near) else near
                        else:
                            good = np.flatnonzero(good)
                        for at in good.tolist():
                            slot = np.flatnonzero(kinds[at : at + max(size, 0)])
                            row = (i, size, total, len(tokens), int(hashed[at].astype(np.int64)), at, kinds[at + slot].tolist(), values[at + slot].astype(np.int64).tolist())
                            for n, v in zip(names, row, strict=True):
                                out[n].append(v)
                yield out

    return run


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, n_windows, coverage, longest_run (tokens), kind, n_changed."""
    spark = documents.sparkSession
    schema = "{} long, size int, total int, tokens int, hash long, at int, kinds array<int>, values array<long>"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).filter("item_id is not null and text is not null").distinct()
    items = checkpointed(map_texts(items, {"item_id": F.col("item_id"), "text": F.col("text")}, _rows("item_id", None, None), schema.format("item_id")))
    sizes = frozenset(r["size"] for r in items.select("size").distinct().collect()) or frozenset([WINDOW])  # twice WINDOW sizes at most
    few = items.select("hash").distinct().limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    wanted = None
    if few:
        wanted = spark.sparkContext.broadcast(np.sort(items.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64)))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).filter("doc_id is not null and text is not null")
    hits = map_texts(own, {"doc_id": F.col("doc_id"), "text": F.col("text")}, _rows("doc_id", sizes, wanted), schema.format("doc_id"))
    hits = hits.select("doc_id", "size", "hash", F.col("at").alias("p"), F.col("values").alias("said")).distinct()
    asked = items.select("item_id", "size", "total", "hash", F.col("at").alias("q"), "kinds", "values")
    matched = checkpointed(hits.join(F.broadcast(asked) if items.count() <= BROADCAST_ROWS else asked, ["hash", "size"]).withColumn("shift", F.col("p") - F.col("q")))

    # Slots of one alignment: a value of the item against what stands there in the document.
    place = ["doc_id", "item_id", "shift"]
    slots = matched.filter(F.size("kinds") > 0).select(*place, F.explode(F.arrays_zip("kinds", "values", "said")).alias("s")).select(*place, "s.*").distinct()
    forth = slots.groupBy(*place, "kinds", "values").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("values") != F.col("said")).cast("int")).alias("changed"))
    back = slots.groupBy(*place, "kinds", "said").agg(F.count(F.lit(1)).alias("n"))
    state = (
        forth.select(*place, "n", "changed").unionByName(back.select(*place, "n", F.lit(0).alias("changed"))).groupBy(*place).agg(F.max("n").alias("most"), F.sum("changed").alias("n_changed"))
    )
    fit = matched.join(state, place, "left").filter("most is null or most = 1")

    per = fit.groupBy("doc_id", "item_id").agg(
        F.max("size").alias("size"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_set("q")).alias("q"),  # at most the item's windows
        F.max(F.coalesce("n_changed", F.lit(0))).alias("n_changed"),
    )
    run = F.aggregate(
        "q",
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(x == a["last"] + 1, a["now"] + 1).otherwise(F.lit(1)).alias("now"),
            F.greatest(a["most"], F.when(x == a["last"] + 1, a["now"] + 1).otherwise(F.lit(1))).alias("most"),
        ),
    )["most"]
    whole = (F.col("size") > 0) | (F.size("q") == F.col("total"))
    scored = per.filter(whole).select(
        "doc_id",
        "item_id",
        F.size("q").cast("long").alias("n_windows"),
        (F.size("q") / F.col("total")).alias("coverage"),
        (run + F.abs("size") - 1).cast("long").alias("longest_run"),
        F.when(F.col("n_changed") > 0, F.lit("reparameterised")).otherwise(F.lit("verbatim")).alias("kind"),
        F.col("n_changed").cast("long").alias("n_changed"),
    )
    return scored.filter((F.col("coverage") >= COVERAGE) | (F.col("longest_run") >= LONG_RUN))


def drop_leaking(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that leak an item, all columns as they were."""
    from .minhash import semi

    return semi(documents, checkpointed(leaks(documents, benchmark).select("doc_id").distinct()), "doc_id", "left_anti")
