"""Language-model scores: a causal self-attention model in numpy over subword ids, and add-one unigram base scores.

Base scores follow word counts over all training documents: counted by task, summed by a shuffle, never gathered on the driver. Words that make
up a FREQUENT-th of the corpus or more (so FREQUENT words at most) are broadcast; the other words of each document are
joined with the counts by shuffle.

The model reads subword ids: each word, marked, is cut into the longest pieces of a public vocabulary, and every id has an embedding
of its own. Ids are told as symbols, numbers in order of corpus count. The output has two levels: a distribution over HEAD classes, OWN of them the
most frequent ids and the end of the text, the other GROUPS runs of rarer symbols; and within each group a distribution over its members, from the same
state of the network. Class and member together give a probability for every id of the vocabulary, and they sum to one; no id has a fixed share.
A text is read in windows of CONTEXT ids that advance by STRIDE: each id is scored exactly once, with CONTEXT - STRIDE ids before it or
more, by masked attention over a batch of windows.

What comes from where: counts of words and of ids cover all training documents, and so do the gradient steps. A bounded sample
(SAMPLE_DOCUMENTS, STEPS batches) only gives the weights to start from; then each training document is read in one of ROUNDS rounds, in which every task
takes steps over its own documents from the same weights, and the weights of all tasks are averaged: an embedding by how often a task read it, the
others by how many ids it learnt from. Scores therefore depend a little on how the rows are dealt to tasks.

Edge cases: null and empty texts have one token, the end; a null doc_id is never learnt from, counts as not held out and gets its
scores; repeated rows are scored each; with no training documents counts are 0 and the model is uniform over its classes; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, map_texts, remainder, written
from .vocabulary import SPACE, Vocabulary, default_path

#: At most so many words are broadcast, those of a FREQUENT-th of all tokens or more, and of at most WORD_BYTES bytes.
FREQUENT = 2_000_000
WORD_BYTES = 64
#: Classes of one symbol (the last is the end) and of a group of them.
OWN, GROUPS = 96, 32
HEAD = OWN + GROUPS
WIDTH, HIDDEN = 16, 32
CONTEXT, STRIDE = 32, 16
#: Bounds of the sample that the weights to start from are fitted to; windows a step.
SAMPLE_DOCUMENTS, STEPS, BATCH = 800, 400, 192
#: Rounds that all training documents are dealt to, and the pace of the first.
ROUNDS, PACE = 4, 0.004
#: Words whose ids a worker keeps in each of two generations; it bounds memory, not results.
KEPT_WORDS = 250_000
_LOG10 = math.log(10.0)


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Cutter:
    """Cuts words into the longest pieces from the left, along a trie of the pieces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes = vocabulary.byte_ids
        self.unknown = vocabulary.unknown
        self.root: dict = {}
        for p, i in vocabulary.normal.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.first = self.root.get(SPACE, {})

    def word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        out, at, n = [], 0, len(text)
        root = self.root
        # The mark in front is part of the first piece.
        node, who, end = self.first, self.first.get(""), 0
        i = 0
        while True:
            while i < n:
                node = node.get(text[i])
                if node is None:
                    break
                i += 1
                if "" in node:
                    who, end = node[""], i
            if who is not None:
                out.append(who)
                at = end
            else:
                c = text[at] if at < n and out else SPACE
                out += [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]
                at += c is not SPACE
            if at >= n:
                return out
            node, who, end, i = root, None, at, at


@dataclass
class Output:
    """The second level: where the groups begin in the symbols (one more: where the last ends), and for each symbol the log of its corpus count, less its group's largest."""

    bounds: np.ndarray
    log_counts: np.ndarray

    def __post_init__(self) -> None:
        symbols = np.arange(len(self.log_counts))
        self._class = np.where(symbols < OWN, symbols, OWN - 1 + np.searchsorted(self.bounds, symbols, side="right")).astype(np.uint8)

    def odds(self, group: slice, states: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
        """For each state the odds of the members of a group, not yet divided by their sum."""
        q = states @ w["V"][group].T
        q += self.log_counts[group]
        np.minimum(q, 60, out=q)  # far above any of a trained model; keeps exp finite
        return np.exp(q, out=q)

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        """The class of each symbol; symbols below 0 stay."""
        return np.where(symbols < 0, symbols, self._class.take(symbols, mode="clip"))

    @classmethod
    def of(cls, counts: np.ndarray) -> Output:
        """Groups of symbols by counts (plus one, falling): equal sums of the roots of counts, so that common groups are short and rare ones
        don't get too long; what was never counted has the last group for itself."""
        met = int((counts[OWN:] > 1).sum())
        parts = GROUPS - 1 if met < len(counts) - OWN else GROUPS
        mass = np.sqrt(counts[OWN : OWN + met] - 1)
        ends = np.searchsorted(np.cumsum(mass), np.arange(1, parts) / parts * mass.sum())
        # At least a member each, as far as there are so many.
        ends = np.minimum(np.maximum.accumulate(np.maximum(ends, np.arange(1, parts))), met)
        bounds = OWN + np.concatenate(([0], ends, [met], [len(counts) - OWN]))
        bounds = bounds[: GROUPS + 1] if parts < GROUPS else bounds[:-1]
        logs = np.log(counts)
        for begin, end in itertools.pairwise(bounds):
            logs[begin:end] -= logs[begin:end].max(initial=-np.inf)
        return cls(bounds, logs.astype(np.float32))

    def groups(self, symbols: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of the groups that symbols fall in: their members, the places in symbols that fall there, and which member each is."""
        far = np.flatnonzero(symbols >= OWN)
        kind = self._class.take(symbols[far])
        order = np.argsort(kind, kind="stable")
        far, kind = far[order], kind[order]
        goal, at = symbols[far], 0
        for end in [*(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(far)] if len(far) else ():
            i = int(kind[at]) - OWN
            begin = int(self.bounds[i])
            yield slice(begin, int(self.bounds[i + 1])), far[at:end], goal[at:end] - begin
            at = end


@dataclass
class Model:
    """Symbols of ids, the output's second level, and the weights of the network. The last embedding is that of the start, never predicted."""

    symbol_of: np.ndarray  # of each id and, last, of the end
    output: Output
    weights: dict[str, np.ndarray]
    name: str = ""

    def windows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs (n, CONTEXT), target symbols (n, STRIDE) and which targets are real, of one text's symbols."""
        n = -(-len(symbols) // STRIDE)
        padded = np.full(n * STRIDE + CONTEXT - STRIDE, -1, dtype=np.int64)
        head = CONTEXT - STRIDE
        padded[head] = len(self.weights["E"]) - 1
        padded[head + 1 : head + len(symbols)] = symbols[:-1]
        inputs = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[::STRIDE]
        targets = np.full(n * STRIDE, -1, dtype=np.int64)
        targets[: len(symbols)] = symbols
        targets = targets.reshape(n, STRIDE)
        return inputs, targets, targets >= 0


def fresh_weights(unigram: np.ndarray, symbols: int = HEAD, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    s = WIDTH**-0.5
    return {
        "E": normal(symbols + 1, WIDTH, scale=0.5), "P": normal(CONTEXT, WIDTH, scale=0.1),
        "Wq": normal(WIDTH, WIDTH, scale=s), "Wk": normal(WIDTH, WIDTH, scale=s), "Wv": normal(WIDTH, WIDTH, scale=s), "Wo": normal(WIDTH, WIDTH, scale=s),
        "W1": normal(WIDTH, HIDDEN, scale=s), "b1": np.zeros(HIDDEN, np.float32), "W2": normal(HIDDEN, WIDTH, scale=HIDDEN**-0.5),
        "U": np.zeros((WIDTH, HEAD), np.float32), "b": unigram.astype(np.float32), "V": np.zeros((symbols, WIDTH), np.float32),
    }


_CAUSAL = np.where(np.arange(CONTEXT)[None, :] <= np.arange(STRIDE)[:, None] + CONTEXT - STRIDE, 0.0, -1e9).astype(np.float32)


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the last axis, as a product, kept as an axis."""
    return (rows.reshape(-1, rows.shape[-1]) @ np.ones((rows.shape[-1], 1), rows.dtype)).reshape(*rows.shape[:-1], 1)


def _exp(rows: np.ndarray, *masks: np.ndarray) -> np.ndarray:
    """exp in place, 0 where masks say so. Rows are shifted by their largest, which changes no share, only if there are values that need it."""
    wild = rows.size > 0 and not (rows.max() < 60 and rows.min() > -60)
    for mask in masks:
        rows += mask
    if wild:
        rows -= rows.max(axis=-1, keepdims=True)
    return np.exp(rows, out=rows)


def forward(w: dict[str, np.ndarray], inputs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict | None]:
    """Logits (n * STRIDE, HEAD) of the ids that follow the last STRIDE inputs of each window."""
    n = len(inputs)
    x = w["E"].take(inputs, axis=0)
    x += w["P"]
    flat = x.reshape(-1, WIDTH)
    own = np.ascontiguousarray(x[:, CONTEXT - STRIDE :]).reshape(-1, WIDTH)
    pairs = np.concatenate([w["Wk"], w["Wv"]], axis=1)
    q = (own @ (w["Wq"] * np.float32(WIDTH**-0.5))).reshape(n, STRIDE, WIDTH)
    kv = (flat @ pairs).reshape(n, CONTEXT, 2 * WIDTH)
    a = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
    _exp(a, _CAUSAL, *([np.where(inputs < 0, np.float32(-1e9), np.float32(0))[:, None, :]] if (inputs[:, 0] < 0).any() else []))
    a /= _sums(a)
    c = (a @ kv[:, :, WIDTH:]).reshape(-1, WIDTH)
    h = c @ w["Wo"]
    h += own
    z = h @ w["W1"]
    z += w["b1"]
    np.maximum(z, 0, out=z)
    raw = z @ w["W2"]
    raw += h
    r = _sums(raw * raw)
    r /= WIDTH
    r += np.float32(1e-5)
    np.sqrt(r, out=r)
    # A column of ones goes with the state: the bias is a row of the product.
    state = np.empty((len(raw), WIDTH + 1), raw.dtype)
    g = np.divide(raw, r, out=raw)
    state[:, :WIDTH] = g
    state[:, WIDTH] = 1
    logits = state @ np.concatenate([w["U"], w["b"][None, :]])
    return logits, {"own": own, "flat": flat, "pairs": pairs, "q": q, "kv": kv, "a": a, "c": c, "h": h, "z": z, "g": g, "state": state, "r": r} if keep else None


class Scorer:
    """The same network for scoring alone: weights folded, sums as products, a distribution's logits and its normaliser in few passes."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w = w
        self.pairs = np.ascontiguousarray(np.concatenate([w["Wk"], w["Wv"]], axis=1))
        self.query = w["Wq"] * np.float32(WIDTH**-0.5)
        self.out = np.ascontiguousarray(np.concatenate([w["U"], w["b"][None, :]]))
        self.ones = np.ones(max(HEAD, CONTEXT), np.float32)

    def logits(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the classes and the states they come from."""
        w, n = self.w, len(inputs)
        x = w["E"].take(inputs, axis=0)
        x += w["P"]
        own = np.ascontiguousarray(x[:, CONTEXT - STRIDE :]).reshape(-1, WIDTH)
        kv = (x.reshape(-1, WIDTH) @ self.pairs).reshape(n, CONTEXT, 2 * WIDTH)
        a = (own @ self.query).reshape(n, STRIDE, WIDTH) @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        a += _CAUSAL
        if (inputs[:, 0] < 0).any():
            a += np.where(inputs < 0, np.float32(-1e9), np.float32(0))[:, None, :]
        np.minimum(a, np.float32(60), out=a)  # far above any score of a trained head; keeps exp finite
        np.exp(a, out=a)
        c = (a @ kv[:, :, WIDTH:]).reshape(-1, WIDTH)
        c /= (a.reshape(-1, CONTEXT) @ self.ones[:CONTEXT])[:, None]
        h = c @ w["Wo"]
        h += own
        z = h @ w["W1"]
        z += w["b1"]
        np.maximum(z, 0, out=z)
        h += z @ w["W2"]
        g = np.empty((len(h), WIDTH + 1), np.float32)
        np.divide(h, np.sqrt((h * h) @ self.ones[:WIDTH] / np.float32(WIDTH) + np.float32(1e-5))[:, None], out=g[:, :WIDTH])
        g[:, WIDTH] = 1
        return g @ self.out, g[:, :WIDTH]


def gradients(w: dict[str, np.ndarray], output: Output, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the real targets, and its gradients."""
    loss, d, rows = sparse_gradients(w, output, inputs, targets, real)
    full = {k: np.zeros_like(w[k]) for k in rows}
    for k, at in rows.items():
        full[k][at] = d[k]
    return loss, d | full


def sparse_gradients(w: dict[str, np.ndarray], output: Output, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The same, with gradients only of those rows of E and V that take part, and which those are."""
    logits, s = forward(w, inputs, keep=True)
    n, mask, symbols = len(inputs), real.ravel(), np.where(real, targets, 0).ravel()
    t = output.classes(symbols)
    at = np.arange(len(t))
    total = max(1, int(mask.sum()))
    p = _exp(logits)
    share = 1 / _sums(p)
    goal = at * HEAD + t
    hit = p.take(goal) * share[:, 0]
    one = (mask / np.float32(total)).astype(p.dtype)
    p *= share * one[:, None]
    p.reshape(-1)[goal] -= one
    du, g = s["state"].T @ p, s["g"]
    d: dict[str, np.ndarray] = {"U": du[:WIDTH], "b": du[WIDTH]}
    dn = p @ w["U"].T
    members, changes = [], []
    groups = list(output.groups(symbols))
    far = np.concatenate([np.zeros(0, np.int64), *[where for _, where, _ in groups]])
    near = g.take(far, axis=0)
    inner, begin = np.empty_like(near), 0
    for group, where, who in groups:
        part = slice(begin, begin + len(where))
        begin = part.stop
        states = near[part]
        q = output.odds(group, states, w)
        share = 1 / _sums(q)
        goal = at[: len(who)] * q.shape[1] + who
        hit[where] *= q.take(goal) * share[:, 0]
        q *= share / np.float32(total)
        q.reshape(-1)[goal] -= np.float32(1 / total)
        members.append(np.arange(group.start, group.stop))
        changes.append(q.T @ states)
        np.matmul(q, w["V"][group], out=inner[part])
    loss = float(-np.log(np.maximum(hit[mask], 1e-30)).sum() / total)
    dn[far] += inner
    dg = dn - g * (_sums(dn * g) / np.float32(WIDTH))
    dg /= s["r"]
    d["W2"] = s["z"].T @ dg
    dz = dg @ w["W2"].T
    dz *= s["z"] > 0
    d["W1"], d["b1"] = s["h"].T @ dz, dz.sum(axis=0)
    dh = dz @ w["W1"].T
    dh += dg
    d["Wo"] = s["c"].T @ dh
    dcf = dh @ w["Wo"].T
    dc = dcf.reshape(n, STRIDE, WIDTH)
    kv, a = s["kv"], s["a"]
    da = dc @ kv[:, :, WIDTH:].transpose(0, 2, 1)
    da -= _sums(dcf * s["c"]).reshape(n, STRIDE, 1)  # the sums of da * a, by the narrower product
    da *= a
    dkv = np.concatenate([da.transpose(0, 2, 1) @ s["q"], a.transpose(0, 2, 1) @ dc], axis=2).reshape(-1, 2 * WIDTH)
    dqf = (da @ kv[:, :, :WIDTH]).reshape(-1, WIDTH)
    scale = np.float32(WIDTH**-0.5)
    d["Wq"] = s["own"].T @ dqf * scale
    dp = s["flat"].T @ dkv
    d["Wk"], d["Wv"] = dp[:, :WIDTH], dp[:, WIDTH:]
    dx = (dkv @ s["pairs"].T).reshape(n, CONTEXT, WIDTH)
    dh += dqf @ (w["Wq"].T * scale)
    dx[:, CONTEXT - STRIDE :] += dh.reshape(n, STRIDE, WIDTH)
    if (inputs[:, 0] < 0).any():
        dx[inputs < 0] = 0
    d["P"] = (np.ones(n, dx.dtype) @ dx.reshape(n, -1)).reshape(CONTEXT, WIDTH)
    # Sixteen bits, where they are enough, are sorted by counting.
    read = np.maximum(inputs, 0).ravel().astype(np.uint16 if len(w["E"]) <= 1 << 16 else np.int64)
    order = np.argsort(read, kind="stable")
    read = read[order]
    begins = np.concatenate(([0], np.flatnonzero(read[1:] != read[:-1]) + 1))
    d["E"] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), begins, axis=0)
    d["V"] = np.concatenate(changes) if changes else np.zeros((0, WIDTH), w["V"].dtype)
    return loss, d, {"E": read[begins].astype(np.int64), "V": np.concatenate(members) if members else np.zeros(0, np.int64)}


def train(model: Model, texts: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 11) -> list[float]:
    """Adam over batches of windows of the sampled texts; the losses of the steps."""
    parts = [model.windows(t) for t in texts if len(t)]
    if not parts:
        return []
    inputs, targets, real = (np.concatenate(x) for x in zip(*parts, strict=True))
    rng = np.random.default_rng(seed)
    adam, losses = Adam(model.weights, model.output), []
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), min(batch, len(inputs)))
        losses.append(adam.step(inputs[pick], targets[pick], real[pick], rate * min(1.0, step / 20) * (0.1 + 0.9 * (1 - step / steps))))
    return losses


class Adam:
    """Steps that change the weights in place; a row of E or V changes only in steps that it takes part in."""

    def __init__(self, weights: dict[str, np.ndarray], output: Output) -> None:
        self.w, self.output = weights, output
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.s = {k: np.zeros_like(v) for k, v in weights.items()}
        self.n = 0

    def step(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, pace: float) -> float:
        loss, d, rows = sparse_gradients(self.w, self.output, inputs, targets, real)
        self.n += 1
        for k, g in d.items():
            at = rows.get(k)
            m, s = (self.m[k], self.s[k]) if at is None else (self.m[k].take(at, axis=0), self.s[k].take(at, axis=0))
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += (0.01 * g) * g
            change = np.sqrt(s)
            change *= (1 - 0.99**self.n) ** -0.5
            change += 1e-8
            np.divide(m, change, out=change)
            change *= pace / (1 - 0.9**self.n)
            if at is None:
                self.w[k] -= change
            else:
                self.m[k][at], self.s[k][at] = m, s
                self.w[k][at] -= change
        return loss


_TABLES = ("E", "V")


def rows_of(weights: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of WIDTH numbers: E, V, then the others one after another, filled up with zeros."""
    rest = np.concatenate([v.ravel() for k, v in weights.items() if k not in _TABLES])
    return np.concatenate([*(weights[k] for k in _TABLES), np.pad(rest, (0, -len(rest) % WIDTH)).reshape(-1, WIDTH)])


def weights_of(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The opposite of rows_of."""
    out, at = {}, 0
    for k in _TABLES:
        out[k] = rows[at : at + len(like[k])].astype(np.float32)
        at += len(like[k])
    rest, begin = rows[at:].ravel().astype(np.float32), 0
    for k, v in like.items():
        if k not in _TABLES:
            out[k] = rest[begin : begin + v.size].reshape(v.shape).copy()
            begin += v.size
    return {k: out[k] for k in like}


def learn(training: DataFrame, shared, path: str, batch: int = BATCH, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after steps over all training documents, from those of the shared model; each round's are averaged by a shuffle."""
    weights, spark = shared.value[0].weights, training.sparkSession
    names = [f"w{i}" for i in range(WIDTH)]
    for turn in range(rounds):
        given = spark.sparkContext.broadcast(weights)
        pace = PACE * (1 - turn / rounds)

        def run(batches: Iterator[dict], given=given, pace=pace) -> Iterator[dict]:
            (model, often), start = shared.value, given.value
            own_reader = reader(model, path, often)
            adam = Adam({k: v.copy() for k, v in start.items()}, model.output)
            own = Model(model.symbol_of, model.output, adam.w)
            size = len(start["E"])
            read, met, rng = np.zeros(size), np.zeros(HEAD), np.random.default_rng(13)
            for batch_rows in batches:
                for part in bounded(batch_rows, size=2 << 20):
                    texts = [own.windows(own_reader.only(tokens(t))) for t in part["text"]]
                    if not texts:
                        continue
                    inputs, goal, real = (np.concatenate(x) for x in zip(*texts, strict=True))
                    for pick in np.array_split(rng.permutation(len(inputs)), -(-len(inputs) // batch)):
                        adam.step(inputs[pick], goal[pick], real[pick], pace)
                    read += np.bincount(inputs[inputs >= 0], minlength=size)
                    met += np.bincount(model.output.classes(goal[real]), minlength=HEAD)
            if met.any():
                rows = rows_of(adam.w)
                group = np.zeros(len(start["V"]))
                for i, (begin, end) in enumerate(zip(model.output.bounds[:-1], model.output.bounds[1:], strict=True)):
                    group[begin:end] = met[OWN + i]
                n = np.concatenate([read, group, np.full(len(rows) - size - len(group), met.sum())])
                at = np.flatnonzero(n)
                yield {"row": at, "n": n[at]} | {c: rows[at, i] for i, c in enumerate(names)}

        mine = training.filter(F.pmod(F.xxhash64(F.col("i"), F.lit("round")), F.lit(rounds)) == turn)
        sums = map_texts(mine, {"text": F.col("text")}, run, "row int, n double, " + ", ".join(f"{c} float" for c in names))
        found = sums.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in names]).toArrow()
        rows = rows_of(weights)
        if found.num_rows:
            rows[found["row"].to_numpy()] = np.stack([found[c].to_numpy() for c in names], axis=1) / found["n"].to_numpy()[:, None]
        weights = weights_of(rows, weights)
        given.destroy()
    return weights


def log10_probabilities(model: Model, texts: list[np.ndarray], size: int = 512) -> np.ndarray:
    """Of each text's symbols the sum of log10 probabilities, in batches of windows of all texts together."""
    if not texts:
        return np.zeros(0)
    counts = np.array([-(-len(t) // STRIDE) for t in texts])
    begins = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(len(texts))
    head = CONTEXT - STRIDE
    # All texts on one line, each with its own padding in front, cut into windows at the right places.
    line = np.full(int(begins[-1]) * STRIDE + len(texts) * head, -1, dtype=np.int64)
    goal = np.full(int(begins[-1]) * STRIDE, -1, dtype=np.int64)
    for i, t in enumerate(texts):
        at = int(begins[i]) * STRIDE + i * head + head
        line[at] = len(model.weights["E"]) - 1
        line[at + 1 : at + len(t)] = t[:-1]
        goal[int(begins[i]) * STRIDE : int(begins[i]) * STRIDE + len(t)] = t
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(int(begins[-1])) * STRIDE + owner * head
    view = np.lib.stride_tricks.sliding_window_view(line, CONTEXT)
    scorer = Scorer(model.weights)
    for at in range(0, len(first), size):
        logits, states = scorer.logits(view[first[at : at + size]])
        symbols = goal[at * STRIDE : (at + size) * STRIDE]
        real = symbols >= 0
        t = model.output.classes(symbols)
        chosen = logits[np.arange(len(t)), np.maximum(t, 0)].astype(np.float64)
        top = logits.max()
        if top > 60:  # not with trained weights
            logits -= top
            chosen -= float(top)
        np.exp(logits, out=logits)
        one = np.where(real, chosen - np.log(logits @ scorer.ones[:HEAD]), 0.0)
        for group, where, who in model.output.groups(symbols):
            q = model.output.odds(group, states[where], model.weights)
            one[where] += np.log(q[np.arange(len(who)), who] / q.sum(axis=1, dtype=np.float64))
        np.add.at(out, owner[at : at + size], one.reshape(-1, STRIDE).sum(axis=1))
    return out / _LOG10


def build(cutter: Cutter, counts: np.ndarray) -> Model:
    """Symbols and groups from corpus counts of the ids (last: the end), and untrained weights that give each id its share of the counts plus one."""
    order = np.argsort(-counts[:-1], kind="stable")
    end = min(OWN - 1, len(order))
    symbol_of = np.full(len(counts), end, dtype=np.uint16)
    symbol_of[order] = np.delete(np.arange(len(order) + 1), end)
    by_symbol = np.ones(max(len(counts), HEAD))
    by_symbol[symbol_of] += counts
    output = Output.of(by_symbol)
    by_class = np.bincount(output.classes(np.arange(len(by_symbol))), weights=by_symbol, minlength=HEAD)
    return Model(symbol_of, output, fresh_weights(np.log(np.maximum(by_class, 1e-9) / by_class.sum()), len(by_symbol)), uuid.uuid4().hex)


class Reader:
    """Of words: their symbols, and log10 of their count if they are frequent. Keeps what it has met."""

    def __init__(self, cutter: Cutter, model: Model, often: dict[bytes, float]) -> None:
        self.cutter, self.model, self.often = cutter, model, often
        self.symbols = model.symbol_of.tolist()
        self.end = model.symbol_of[-1:].tobytes()
        self.young: dict[bytes, tuple[bytes, float | None]] = {}
        self.old: dict[bytes, tuple[bytes, float | None]] = {}

    def word(self, word: bytes) -> tuple[bytes, float | None]:
        own = self.old.get(word)
        if own is None:
            own = array("H", [self.symbols[i] for i in self.cutter.word(word)]).tobytes(), self.often.get(word)
        if len(word) <= WORD_BYTES:
            if len(self.young) >= KEPT_WORDS:
                self.young, self.old = {}, self.young
            self.young[word] = own
        return own

    def only(self, words: list[bytes]) -> np.ndarray:
        """Symbols with the end."""
        found = list(map(self.young.get, words))
        if None in found:
            found = [own or self.young.get(x) or self.word(x) for own, x in zip(found, words, strict=True)]
        return np.frombuffer(b"".join([s for s, _ in found]) + self.end, dtype=np.uint16)

    def text(self, words: list[bytes]) -> tuple[np.ndarray, Sequence[float], Counter]:
        """Symbols with the end, log10 counts of the frequent words, and the other words with how often they occur."""
        if not words:
            return np.frombuffer(self.end, dtype=np.uint16), [], Counter()
        found = list(map(self.young.get, words))
        if None in found:
            for i, own in enumerate(found):
                if own is None:
                    found[i] = self.young.get(words[i]) or self.word(words[i])
        symbols, logs = zip(*found, strict=True)
        rare = Counter([x for x, c in zip(words, logs, strict=True) if c is None]) if None in logs else Counter()
        counts = [c for c in logs if c is not None] if rare else logs
        return np.frombuffer(b"".join(symbols) + self.end, dtype=np.uint16), counts, rare


_READER: list[Reader] = []


def reader(model: Model, path: str, often: dict[bytes, float]) -> Reader:
    """One reader a worker process and model; what it has met serves the worker's next tasks too."""
    if not _READER or _READER[0].model.name != model.name:
        _READER[:] = [Reader(Cutter(Vocabulary.load(path)), model, often)]
    return _READER[0]


def _training(documents: DataFrame, fold: int, held_out: int) -> DataFrame:
    own = documents.select(F.col("doc_id").alias("i"), F.col("text").alias("text"))
    return own.filter(remainder(F.col("i"), fold) != held_out)


def word_counts(training: DataFrame) -> DataFrame:
    """word (binary; null for the end of a text), n: over all training documents."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        seen: Counter = Counter()
        for batch in batches:
            for part in bounded(batch):
                for text in part["text"]:
                    seen.update(tokens(text))
                seen[None] += len(part["text"])
                if len(seen) > 1_000_000:
                    yield {"word": list(seen), "n": list(seen.values())}
                    seen = Counter()
        yield {"word": list(seen), "n": list(seen.values())}

    rows = map_texts(training, {"text": F.col("text")}, count, "word binary, n long")
    return written(rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def id_counts(words: DataFrame, path: str) -> np.ndarray:
    """Counts of the ids of all words of the corpus, and of ends."""
    size = len(Vocabulary.load(path).pieces)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        cutter = Cutter(Vocabulary.load(path))
        own = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                if word is None:
                    own[-1] += n
                else:
                    for i in cutter.word(word):
                        own[i] += n
        at = np.flatnonzero(own)
        yield {"id": at.tolist(), "n": own[at].tolist()}

    out = np.zeros(size + 1)
    for r in map_texts(words, {"word": F.col("word"), "n": F.col("n")}, count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def score_documents(documents: DataFrame, model_path: str | None = None, fold: int = 7, held_out: int = 2, sample: int = SAMPLE_DOCUMENTS, steps: int = STEPS, batch: int = BATCH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    path = model_path or default_path()
    spark = documents.sparkSession
    training = _training(documents, fold, held_out)
    words = word_counts(training)
    sizes = words.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("ends")).first()
    total, kinds, ends = sizes["all"] or 0, sizes["kinds"] or 0, sizes["ends"] or 0
    often = (F.col("n") * F.lit(FREQUENT) >= F.lit(total)) & (F.octet_length("word") <= WORD_BYTES)
    frequent = {bytes(r["word"]): math.log10(r["n"] + 1) for r in words.filter(often).toLocalIterator()}

    cutter = Cutter(Vocabulary.load(path))
    model = build(cutter, id_counts(words, path))
    unit = F.pmod(F.xxhash64(F.col("i"), F.lit("attention")), F.lit(1 << 30))
    chosen = training.filter(unit < F.lit(int(min(1.0, sample / max(1, ends)) * (1 << 30)))).limit(2 * sample).collect()
    fitted = Reader(cutter, model, {})
    train(model, [fitted.only(tokens(r["text"])) for r in sorted(chosen, key=lambda r: str(r["i"]))], steps)
    shared = spark.sparkContext.broadcast((model, frequent))
    learnt = spark.sparkContext.broadcast(learn(training, shared, path, batch) if ends else model.weights)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        model, often = shared.value
        own_reader = reader(model, path, often)
        model = replace(model, weights=learnt.value)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in bounded(batch, size=2 << 20):
                out: dict[str, list] = {k: [] for k in ("uid", "n_tokens", "n_often", "often_sum", "rare", "times")}
                symbols = []
                for text in part["text"]:
                    own = tokens(text)
                    c, known, rare = own_reader.text(own)
                    symbols.append(c)
                    row += 1
                    for k, v in (("uid", row), ("n_tokens", len(own) + 1), ("n_often", len(known)), ("often_sum", math.fsum(known)), ("rare", list(rare)), ("times", list(rare.values()))):
                        out[k].append(v)
                score = log10_probabilities(model, symbols)
                yield out | {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": score.tolist()}

    own = F.col("doc_id")
    columns = {"doc_id": own.cast("long"), "held_out": F.coalesce(remainder(own, fold) == held_out, F.lit(False)), "text": F.col("text")}
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_often long, often_sum double, rare array<binary>, times array<long>, score double"
    read = written(map_texts(documents, columns, run, schema), "scored")
    rare = read.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("uid", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    # The left side has each word once a document; a word that is hot there though rare in training is split by adaptive execution.
    looked = rare.join(words.filter(F.col("word").isNotNull()), "word").groupBy("uid").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sum"))
    out = read.drop("rare", "times").join(looked, "uid", "left")
    base = F.col("often_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(total + kinds + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_often") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )
