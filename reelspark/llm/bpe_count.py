"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a marked word stand in a linked list; a heap gives the adjacent pair of the lowest rank (the highest score,
then the leftmost), and each merge takes one symbol away. The count is what the word had at first less the merges; symbols
that no piece spells count as their UTF-8 bytes. No identifiers are made. A word's count depends on nothing around it, so
each worker keeps counts of the words that it has met, in two generations of bounded size.

Edge cases: null and empty texts have no tokens; a null doc_id is kept; repeated rows are counted each; other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_texts
from .vocabulary import Vocabulary, default_path

#: Words whose counts a worker keeps in each of two generations; it bounds memory (about 100 MB a generation), not results.
KEPT_WORDS = 500_000
#: Longer words are counted each time.
KEPT_LENGTH = 64


class PairMerger:
    """Counts the symbols that byte-pair merging leaves."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        normal = vocabulary.normal
        self.vocabulary = vocabulary
        order = sorted({-vocabulary.scores[i] for i in normal.values()})
        place = {s: n for n, s in enumerate(order)}
        self.rank = {p: place[-vocabulary.scores[i]] for p, i in normal.items()}
        self.bytes = vocabulary.byte_ids is not None
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one marked word."""
        rank = self.rank
        n = len(word)
        symbols: list = list(word)
        extra = 0
        if self.bytes:
            extra = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in symbols if c not in rank) if not word.isascii() else 0
        if n == 1:
            return 1 + extra
        if word in rank and n == 2:
            return 1
        get = rank.get
        heap = []
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        if not heap:
            return n + extra
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n:
                continue
            joined = left + symbols[j]
            if len(joined) != size:
                continue
            merges += 1
            symbols[i] = joined
            symbols[j] = None
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                pair = joined + symbols[k]
                r = get(pair)
                if r is not None:
                    heappush(heap, (r, i, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + joined
                r = get(pair)
                if r is not None:
                    heappush(heap, (r, h, len(pair)))
        return n - merges + extra

    def text(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        young, old = self.young, self.old
        total = 0
        get = young.get
        for w in self.vocabulary.splitter.findall(self.vocabulary.mark(text)):
            c = get(w)
            if c is None:
                c = old.get(w)
                if c is None:
                    c = self.word(w)
                if len(w) <= KEPT_LENGTH:
                    if len(young) >= KEPT_WORDS:
                        self.old, self.young = young, {}
                        young, old = self.young, self.old
                        get = young.get
                    young[w] = c
            total += c
        return total


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One merger a worker process; what it has learnt serves its next tasks too."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(Vocabulary.load(path))
    return _MERGERS[path]


def token_counts(documents: DataFrame, model_path: str | None = None, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text. One pass, no shuffle."""
    path = model_path or default_path()

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        own = merger(path)
        for batch in batches:
            for part in bounded(batch):
                n = [own.text(t) for t in part["text"]]
                yield {"doc_id": part["doc_id"], "n_bytes": part["n_bytes"], "n_tokens": n, "over_limit": [x > limit for x in n]}

    text = F.col(text_column)
    columns = {"doc_id": F.col(id_column).cast("long"), "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "text": text}
    return map_texts(documents, columns, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
