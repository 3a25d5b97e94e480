"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text is marked (spaces become marks, one stands in front) and cut into marked words, which no piece crosses. The distinct words
of a part of the table are sorted; walking them in order is a depth-first walk of their trie, and the forward scores and
back pointers of the prefix that a word shares with the one before it are used again. Only new characters are scored, each
against the pieces that end there (a trie of reversed pieces). The best segmentation is that of the highest sum of scores; of
equals, the one whose last piece is longest, from the end backwards. A character that no piece spells scores below all pieces
and becomes its UTF-8 bytes, or the unknown piece where the vocabulary has no bytes.

Decoding looks ids up, joins pieces and runs of bytes, turns marks into spaces and drops the one in front. With byte
pieces, decode(encode(text)) is the text itself, unless it holds the mark character (which reads as a space).

Edge cases: null gives null ids and null text; the empty text has no ids and decodes to itself; a null doc_id is kept; repeated
rows are answered each; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_texts
from .vocabulary import BYTE, CONTROL, SPACE, UNKNOWN, Vocabulary, default_path

#: Words whose ids a worker keeps from one part to the next; it bounds memory (about 30 MB), not results.
KEPT_WORDS, KEPT_LENGTH = 150_000, 24
#: What an unknown character scores below the lowest piece, fixed value.
UNKNOWN_PENALTY = 10.0


class PieceCoder:
    """Encodes distinct words in sorted order, decodes ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.root: dict = {}
        for piece, i in vocabulary.normal.items():
            node = self.root
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = (vocabulary.scores[i], i)
        self.low = min((vocabulary.scores[i] for i in vocabulary.normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.wide = len(vocabulary.pieces) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.control = [k in (CONTROL,) for k in vocabulary.kinds]
        self.surface = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(SPACE, " ") for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.byte = {i: int(vocabulary.pieces[i][3:5], 16) for i, k in enumerate(vocabulary.kinds) if k == BYTE}
        self.bytes_sorted = np.array(sorted(self.byte), dtype=np.int64)
        self.kept: dict[str, bytes] = {}

    def _unknown(self, c: str) -> list[int]:
        ids = self.vocabulary.byte_ids
        return [ids[b] for b in c.encode("utf-8", "surrogatepass")] if ids else [self.vocabulary.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word; words are distinct and sorted."""
        root, low, kind = self.root, self.low, self.kind
        best: list[float] = [0.0]
        start: list[int] = [0]
        piece: list[int] = [-1]
        out: dict[str, bytes] = {}
        before = ""
        for word in words:
            n, shared = len(word), 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], start[shared + 1 :], piece[shared + 1 :]
            for end in range(shared + 1, n + 1):
                node, top, frm, who = root, None, end - 1, -1
                at = end - 1
                while at >= 0:
                    node = node.get(word[at])
                    if node is None:
                        break
                    own = node.get("")
                    if own is not None:
                        score = best[at] + own[0]
                        if top is None or score >= top:
                            top, frm, who = score, at, own[1]
                    elif at == end - 1 and top is None:
                        top = best[at] + low
                    at -= 1
                if top is None:
                    top = best[end - 1] + low
                best.append(top)
                start.append(frm)
                piece.append(who)
            ids: list[int] = []
            end = n
            while end:
                frm, who = start[end], piece[end]
                if who >= 0:
                    ids.append(who)
                else:
                    ids += reversed(self._unknown(word[frm:end]))
                end = frm
            ids.reverse()
            out[word] = np.array(ids, dtype=kind).tobytes()
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each whole text."""
        split, mark = self.vocabulary.splitter.findall, self.vocabulary.mark
        words = [split(mark(t)) if t else [] for t in texts]
        distinct, kept = set().union(*words), self.kept
        table = {w: kept[w] for w in distinct if w in kept}
        new = self.encode_words(sorted(distinct.difference(table)))
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
        kept.update((w, x) for w, x in itertools.islice(new.items(), KEPT_WORDS) if len(w) <= KEPT_LENGTH)
        table.update(new)
        return [None if t is None else np.frombuffer(b"".join(map(table.__getitem__, w)), dtype=self.kind) for t, w in zip(texts, words, strict=True)]

    def decode(self, ids: np.ndarray | None) -> str | None:
        """The text that ids spell."""
        if ids is None:
            return None
        ids = np.asarray(ids, dtype=np.int64)
        surface = self.surface
        is_byte = np.isin(ids, self.bytes_sorted) if len(self.bytes_sorted) else np.zeros(len(ids), dtype=bool)
        if is_byte.any():
            edge = np.flatnonzero(np.diff(is_byte)) + 1
            parts = []
            for part, flag in zip(np.split(ids, edge), is_byte[np.concatenate(([0], edge))], strict=True):
                if flag:
                    parts.append(bytes(self.byte[i] for i in part.tolist()).decode("utf-8", "replace"))
                else:
                    parts += map(surface.__getitem__, part.tolist())
            text = "".join(parts)
        else:
            text = "".join(map(surface.__getitem__, ids.tolist()))
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder a worker process."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(Vocabulary.load(path))
    return _CODERS[path]


def encode_documents(documents: DataFrame, model_path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (the text that the ids spell), exact (it is the text): for every whole text. One pass, no shuffle."""
    path = model_path or default_path()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = coder(path)
        for batch in batches:
            for part in bounded(batch, size=2 << 20):
                ids = own.encode(part["text"])
                decoded = [own.decode(x) for x in ids]
                sizes = np.array([0 if x is None else len(x) for x in ids], dtype=np.int64)
                some = [x for x in ids if x is not None and len(x)]
                flat = np.concatenate(some).astype(np.int32) if some else np.zeros(0, np.int32)
                offsets = pa.array([None if x is None else o for x, o in zip(ids, (np.cumsum(sizes) - sizes).tolist(), strict=True)] + [int(sizes.sum())], type=pa.int32())
                yield {
                    "doc_id": part["doc_id"],
                    "ids": pa.ListArray.from_arrays(offsets, pa.array(flat)),
                    "decoded": decoded,
                    "exact": [None if t is None else d == t for t, d in zip(part["text"], decoded, strict=True)],
                }

    columns = {"doc_id": F.col(id_column).cast("long"), "text": F.col(text_column)}
    return map_texts(documents, columns, run, "doc_id long, ids array<int>, decoded string, exact boolean")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_hash, decoded_sha256, round_trip of what encode_documents returns."""
    return encoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.encode(F.coalesce("decoded", F.lit("")), "UTF-8"), 256).alias("decoded_sha256"),
        F.coalesce("exact", F.lit(True)).alias("round_trip"),
    )
