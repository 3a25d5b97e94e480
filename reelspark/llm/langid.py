"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit of the code has a binary classifier over hashed byte n-grams (a naive Bayes
log-odds, one weight a bucket) that predicts the bit. A text's margins are decoded to the codeword of the least weighted
logistic loss; a bit weighs more the more of its two sides' fitted n-gram mass its classifier's signs get right. Where the two nearest codewords are
close the answer is flagged as ambiguous.

Training reads only text and language of documents outside the held-out fold, from a bounded sample for each language
(SAMPLE_PER_LANGUAGE documents, drawn by a hash of the id, whole texts). What comes to the driver are counts of
n-gram buckets by language: at most BUCKETS rows a language.

Edge cases: null texts and texts without letters are `und` with score 0 and flagged ambiguous; with no training rows all are
`und`; with one language all texts with letters get it, score 1. A null doc_id counts as not held out (its remainder is
null) and is never learnt from. Repeated rows are answered each; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_texts, mix, remainder

UNDETERMINED = "und"
BITS = 15
BUCKETS = 1 << BITS
#: Bound of the training sample.
SAMPLE_PER_LANGUAGE = 1500
SMOOTHING = 0.5
_CHUNK = 1 << 16
#: Below this score an answer is ambiguous.
AMBIGUOUS = 0.5


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the whole text in lower case, digits and white space as one space, in parts."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    data = _FOLD[data]
    for at in range(0, max(1, len(data) - 2), _CHUNK):
        part = data[at : at + _CHUNK + 2].astype(np.uint32)
        key = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        yield ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.intp)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(0x21), *range(0x30, 0x3A)]] = 0x20


def code_matrix(k: int) -> np.ndarray:
    """A row of +1 and -1 for each of k classes. Up to 6 classes all splits; beyond, hashed bits, 8 for each doubling and more."""
    if k <= 6:
        rows = [[1 if (i == 0 or (b >> (i - 1)) & 1) else -1 for b in range(2 ** (k - 1) - 1)] for i in range(k)]
        return np.array(rows, dtype=np.float64).reshape(k, -1)
    n = 8 * int(np.ceil(np.log2(k))) + 7
    bits = mix(np.arange(1, k * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(k, n)
    code = np.where(bits & np.uint64(1), 1.0, -1.0)
    return code[:, np.abs(code.sum(axis=0)) < k]


@dataclass
class CodeModel:
    """What the fit gives: languages, their codewords, a weight for each bucket and bit, and a weight for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for buckets in ngrams(text):
            n += len(buckets)
            if len(buckets) > 4 * BUCKETS // 10:
                total += np.bincount(buckets, minlength=BUCKETS) @ self.weights
            else:
                total += self.weights[buckets].sum(axis=0)
        return total / max(1.0, np.sqrt(n))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, whether it is ambiguous."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.logaddexp(0.0, -self.code * self.margins(text))).sum(axis=1)
        odds = np.exp(-(loss - loss.min()))
        best = int(np.argmin(loss))
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < AMBIGUOUS


def fit(documents: DataFrame, fold: int = 4, held_out: int = 2, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> CodeModel:
    """Bit classifiers from a sample of at most about `sample` documents a language, none of the held-out fold."""
    train = documents.select(F.col(id_column).alias("i"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")).filter(
        (remainder(F.col("i"), fold) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return CodeModel([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    # A share of the hash range for each language; no order, no window, no limit that one task would have to hold.
    unit = F.pmod(F.xxhash64(F.col("i"), F.lit("langid")), F.lit(1 << 30))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(int(min(1.0, sample / n) * (1 << 30)))) for k, n in sizes.items()))
    chosen = train.filter(unit < F.try_element_at(share, F.col("lang")))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                own = seen.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for buckets in ngrams(text):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in seen.items():
            at = np.flatnonzero(own)
            yield {"lang": [lang] * len(at), "bucket": at.tolist(), "n": own[at].tolist()}

    counted = map_texts(chosen, {"lang": F.col("lang"), "text": F.col("text")}, count, "lang string, bucket int, n long")
    languages = sorted(sizes)
    table = np.zeros((len(languages), BUCKETS))
    place = {x: i for i, x in enumerate(languages)}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[place[r["lang"]], r["bucket"]] = r["n"]
    return from_counts(languages, table)


def from_counts(languages: list[str], table: np.ndarray) -> CodeModel:
    """The model of counts of buckets (columns) by language (rows)."""
    k = len(languages)
    if k < 2:
        return CodeModel(languages, np.zeros((k, 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    code = code_matrix(k)
    likely = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * table.shape[1])
    weights = np.empty((table.shape[1], code.shape[1]))
    trust = np.empty(code.shape[1])
    for j in range(code.shape[1]):
        up, down = likely[code[:, j] > 0].mean(axis=0), likely[code[:, j] < 0].mean(axis=0)
        weights[:, j] = np.log(up) - np.log(down)
        # Mass that the classifier's sign gets right, over both sides: 1/2 is a guess.
        right = 0.5 * (up[weights[:, j] > 0].sum() + down[weights[:, j] <= 0].sum())
        trust[j] = max(1e-3, 2 * right - 1)
    return CodeModel(languages, code, weights, trust / trust.mean())


def predict_languages(documents: DataFrame, model: CodeModel, fold: int = 4, held_out: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every whole text. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of a few bits: about 2 MB

    def predict(batches: Iterator[dict]) -> Iterator[dict]:
        own = shared.value
        for batch in batches:
            for part in bounded(batch):
                found = [own.predict(t) for t in part["text"]]
                yield {
                    "doc_id": part["doc_id"],
                    "held_out": part["held_out"],
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "ambiguous": [f[2] for f in found],
                }

    own = F.col(id_column)
    columns = {"doc_id": own.cast("long"), "held_out": F.coalesce(remainder(own, fold) == held_out, F.lit(False)), "text": F.col(text_column)}
    return map_texts(documents, columns, predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(documents: DataFrame, **fit_options: object) -> DataFrame:
    """Fits on documents outside the held-out fold and answers for all."""
    return predict_languages(documents, fit(documents, **fit_options))
