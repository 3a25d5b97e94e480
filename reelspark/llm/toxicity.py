"""Toxicity by a weighted finite-state pattern grammar.

The lexicon transducer turns words into classes (insult, threat, target, negation, report) with weights. Four more are composed into
one machine that reads the classes of a clause: negation (how far one still reaches), report (whether one came before), target (it
guesses at the start whether the clause is aimed at somebody, and is only final if the guess came true) and
naming, which writes the kind of each match. Of the paths that accept a clause the best counts. What
is scored is the matched clause: its kinds (plain, aimed, negated, reported insult; threat; aimed threat) and the weights of
its words, never a word by itself. A logistic model over the sums by kind and the density of matches gives the score.

Words of threats, targets, negations and reports are fixed; the labelled sample of these corpora shows too few such clauses to learn words
from, so only what their kinds weigh is learnt.

What is learnt, and from what: the insult lexicon (words and word beginnings with their log-odds) and the weights of the
kinds, from a bounded sample (SAMPLE_TOXIC and SAMPLE_CLEAN distinct whole texts) of the labelled rows outside the held-out
fold. Labels are inputs of the fit only; language, source and id are inputs of nothing. Weights of kinds are drawn towards
fixed priors, which hold where the sample shows no such clause.

Edge cases: null and empty texts score what a text without matches scores (a small value over 0); a null doc_id counts as not
held out and is never learnt from; with no labels only the fixed seed lexicon and the priors hold; repeated rows are
answered each; a doc_id with both labels counts as toxic in the fit; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed, map_texts, remainder, shingles, word_hashes

#: Bounds of the training sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 9000
#: A word or beginning needs so many toxic texts and so high log-odds.
SUPPORT, ODDS = 5, 3.5
BEGINNINGS = range(3, 10)
#: Seeds and function words, fixed values.
SEEDS = frozenset("idiot moron imbecile dumbass asshole bastard scumbag idiota imbécil estúpido estúpida gilipollas connard connasse crétin abruti arschloch dummkopf vollidiot trottel".split())
SEED_WEIGHT = 2.0
THREATS = frozenset("kill murder strangle stab shoot matarte matar matarle tuer étrangler égorger töten umbringen erschlagen".split())
THREAT_WEIGHT = 2.0
TARGETS = frozenset("you your yours you're u ur yourself tú tu te ti usted ustedes vosotros vous toi tes votre vos du dich dir dein deine euch ihr".split())
NEGATIONS = frozenset("not never no isn't aren't don't doesn't nobody neither nunca jamás tampoco ni pas jamais aucun ne nicht kein keine keiner niemals nie".split())
REPORTS = frozenset("said says say saying called calls claimed claims wrote quoted quote reported dijo dice llamó escribió dit disait écrit appelé sagte sagt nannte schrieb".split())
#: Kinds of clauses and the prior weight of each, fixed values.
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat")
PRIOR = np.array([2.0, 2.5, 0.5, 0.5, 0.3, 2.0, 0.5, -4.0])
PENALTY = 1.0
#: Classes of a word, as bits; classes from INSULT on are matches. Then what the machine adds to a word on its way.
END, TARGET, NEGATION, REPORT, INSULT, THREAT = 1, 2, 4, 8, 64, 128
CLASSES = (TARGET, NEGATION, REPORT, INSULT, THREAT)
NEGATED, REPORTED, AIMED = 256, 512, 1024
#: Words before a match that a negation reaches over.
REACH = 3
#: Words whose tags a worker keeps; it bounds memory, not results.
KEPT_WORDS = 1_000_000
_TRIM = ".,;:!?\"'()[]{}<>«»“”„‘’¡¿…*_~-|"
_LEET = str.maketrans("013457@$", "oieastas")


def tokens(text: str) -> list[str]:
    return text.lower().replace("\n", " \x00 ").split()


def forms(word: str) -> set[str]:
    """The word as a whole, marked by $, and its beginnings that more letters follow."""
    return {word + "$", *(word[:n] for n in BEGINNINGS if n < len(word))}


class Transducer:
    """A weighted finite-state transducer over hashable states and symbols.

    arcs[state][symbol] lists (output, weight, next state); there may be several, and then a word may have several paths. Weights add up
    along a path; the path of the largest sum that ends in a final state counts.
    """

    def __init__(self, starts: Iterable, finals: Callable[[Hashable], bool], alphabet: Iterable, step: Callable) -> None:
        """What can be reached from the starts; step(state, symbol) gives the arcs."""
        self.starts, self.arcs, self.alphabet = tuple(starts), {}, tuple(alphabet)
        left = list(self.starts)
        while left:
            state = left.pop()
            if state not in self.arcs:
                self.arcs[state] = {x: tuple(step(state, x)) for x in self.alphabet}
                left += [to for ways in self.arcs[state].values() for _, _, to in ways]
        self.finals = frozenset(x for x in self.arcs if finals(x))

    def outputs(self) -> set:
        return {out for row in self.arcs.values() for ways in row.values() for out, _, _ in ways}

    def then(self, other: Transducer) -> Transducer:
        """The composition: what self writes, other reads; weights add up."""

        def step(state: tuple, symbol: Hashable) -> Iterator[tuple]:
            for mid, w, p in self.arcs[state[0]][symbol]:
                for out, v, q in other.arcs[state[1]][mid]:
                    yield out, w + v, (p, q)

        return Transducer(((p, q) for p in self.starts for q in other.starts), lambda x: x[0] in self.finals and x[1] in other.finals, self.alphabet, step)

    def best(self, symbols: Sequence) -> tuple[float, list] | None:
        """The weight and the outputs of the best accepting path, of equal ones the first; None if there is none."""
        front = {x: (0.0, None) for x in self.starts}
        for symbol in symbols:
            new: dict = {}
            for state, (weight, trail) in front.items():
                for out, w, to in self.arcs[state][symbol]:
                    if to not in new or weight + w > new[to][0]:
                        new[to] = weight + w, (out, trail)
            front = new
        ends = [front[x] for x in front if x in self.finals]
        if not ends:
            return None
        weight, trail = max(ends, key=lambda e: e[0])
        out = []
        while trail is not None:
            out.append(trail[0])
            trail = trail[1]
        return weight, out[::-1]


def _negation(alphabet: Iterable[int]) -> Transducer:
    """Marks words that a negation among the REACH words before them reaches."""
    return Transducer([0], lambda _: True, alphabet, lambda left, x: [(x | NEGATED if left else x, 0.0, REACH if x & NEGATION else max(0, left - 1))])


def _report(alphabet: Iterable[int]) -> Transducer:
    """Marks words of reported speech: all from the first word of reporting on."""
    return Transducer([False], lambda _: True, alphabet, lambda on, x: [(x | REPORTED, 0.0, True) if on or x & REPORT else (x, 0.0, False)])


def _target(alphabet: Iterable[int]) -> Transducer:
    """Marks all words of a clause that has a target anywhere: that it has one is guessed before it is met."""

    def step(state: str, x: int) -> list[tuple]:
        if state == "none":
            return [] if x & TARGET else [(x, 0.0, "none")]
        return [(x | AIMED, 0.0, "met" if state == "met" or x & TARGET else "awaited")]

    return Transducer(["none", "awaited"], lambda x: x != "awaited", alphabet, step)


def _naming(alphabet: Iterable[int]) -> Transducer:
    """Writes the kinds (numbers in KINDS) of a marked word; a match weighs one."""

    def kinds(x: int) -> tuple[int, ...]:
        insult = (3 if x & REPORTED else 2 if x & NEGATED else 1 if x & AIMED else 0,) if x & INSULT else ()
        return insult + ((5 if x & AIMED else 4,) if x & THREAT and not x & (REPORTED | NEGATED) else ())

    return Transducer([0], lambda _: True, alphabet, lambda s, x: [(kinds(x), float(len(kinds(x))), s)])


def clause_machine() -> Transducer:
    """Negation, report, target and naming as one machine over sets of classes."""
    machine = _negation(sum(x) for n in range(len(CLASSES) + 1) for x in combinations(CLASSES, n))
    for build in (_report, _target, _naming):
        machine = machine.then(build(machine.outputs()))
    return machine


CLAUSE = clause_machine()


class Tags(dict):
    """The lexicon transducer: the tag of a word, worked out when it is first met."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def weight(self, core: str) -> float:
        own = self.lexicon
        return max((own[f] for f in forms(core) if f in own), default=0.0)

    def __missing__(self, word: str) -> int:
        if word == "\x00":
            return END
        core = word.strip(_TRIM)
        tag = END if word[-1] in ".!?;:" else 0
        if core in TARGETS:
            tag |= TARGET
        if core in NEGATIONS:
            tag |= NEGATION
        if core in REPORTS:
            tag |= REPORT
        if core in THREATS:
            tag |= THREAT
        if core and (self.weight(core) or (not core.isalpha() and not core.isdigit() and self.weight(core.translate(_LEET)))):
            tag |= INSULT
        if len(self) < KEPT_WORDS and len(word) <= 64:
            self[word] = tag
        return tag


@dataclass
class Grammar:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    def __post_init__(self) -> None:
        self.tags = Tags(self.lexicon)

    def __reduce__(self) -> tuple:
        return Grammar, (self.lexicon, self.weights)

    def clauses(self, text: str | None) -> tuple[np.ndarray, int]:
        """Sums of the weights of matched clauses by kind, and the number of words."""
        sums = np.zeros(len(KINDS))
        if not text:
            return sums, 0
        words = tokens(text)
        tags = list(map(self.tags.__getitem__, words))
        if not tags or max(tags) < INSULT:
            return sums, len(words)
        n = len(tags)
        at = 0
        while at < n:
            hit = next((i for i in range(at, n) if tags[i] >= INSULT), None)
            if hit is None:
                break
            start = hit
            while start > at and not tags[start - 1] & END:
                start -= 1
            end = hit
            while end < n - 1 and not tags[end] & END:
                end += 1
            self._clause(words, tags, start, end + 1, sums)
            at = end + 1
        return sums, n

    def _clause(self, words: list[str], tags: list[int], start: int, end: int, sums: np.ndarray) -> None:
        """One run of the composed machine over the classes of a clause; each match adds its weight to its kind."""
        _, kinds = CLAUSE.best([t & ~END for t in tags[start:end]])
        for word, found in zip(words[start:end], kinds, strict=True):
            for k in found:
                core = word.strip(_TRIM)
                sums[k] += THREAT_WEIGHT if KINDS[k].endswith("threat") else self.tags.weight(core) or self.tags.weight(core.translate(_LEET))

    def features(self, text: str | None) -> np.ndarray:
        sums, n = self.clauses(text)
        return np.concatenate((np.log1p(sums), [min(5.0, 25.0 * sums.sum() / max(n, 1)), 1.0]))

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def fit_weights(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Newton steps for a logistic model whose weights are drawn to the priors."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - labels) + PENALTY * (w - PRIOR)
        curve = (features * (p * (1 - p))[:, None]).T @ features + PENALTY * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    # An insult never speaks against toxicity.
    w[:-1] = np.maximum(w[:-1], 0.0)
    return w


def build_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words and beginnings of high log-odds; the shortest beginning stands for what begins with it."""
    lexicon = {f"{s}$": SEED_WEIGHT for s in SEEDS if not clean.get(f"{s}$")}
    chosen: dict[str, float] = {}
    for f in sorted(toxic, key=lambda x: (len(x), x)):
        a, b = toxic[f], clean.get(f, 0)
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
        if a >= SUPPORT and odds >= ODDS:
            plain = f.rstrip("$")
            if not any(plain[:n] in chosen for n in BEGINNINGS if n < len(f)):
                chosen[f] = float(min(odds, 8.0) / 2)
    return lexicon | chosen


def fit(documents: DataFrame, labels: DataFrame, fold: int = 3, held_out: int = 1, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Grammar:
    """Lexicon and weights from a bounded sample of labelled rows outside the held-out fold."""
    own = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic")).filter((remainder(F.col("i"), fold) != held_out) & F.col("toxic").isNotNull())
    own = own.groupBy("i").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"] > 0): r["n"] for r in own.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Grammar(build_lexicon({}, {}, 0, 0))
    unit = F.pmod(F.xxhash64(F.col("i"), F.lit("toxicity")), F.lit(1 << 30))
    share = F.lit(0)
    for k, most in ((1, sample_toxic), (0, sample_clean)):
        share = F.when((F.col("toxic") > 0).cast("int") == k, F.lit(int(min(1.0, most / max(1, sizes.get(k, 0))) * (1 << 30)))).otherwise(share)
    chosen = own.filter(unit < share)
    # The sample is bounded by its parameters, so it may be broadcast; the texts of the others are never shuffled.
    texts = documents.select(F.col("doc_id").alias("i"), F.col("text").alias("text")).join(F.broadcast(chosen), "i").filter(F.col("text").isNotNull())

    def sketch(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            low = [shingles(word_hashes(t), 5) for t in batch["text"]]
            yield batch | {"sketch": [int(x.min().astype("int64")) if len(x) else 0 for x in low]}

    # One text of those that share their least shingle: copies and near copies would count a chance word many times.
    texts = map_texts(texts, {"text": F.col("text"), "toxic": F.col("toxic")}, sketch, "text string, toxic int, sketch long")
    sample = checkpointed(texts.groupBy("sketch").agg(F.max(F.struct("toxic", "text")).alias("m")).select(F.col("m.text").alias("text"), (F.col("m.toxic") > 0).cast("int").alias("toxic")))
    n_clean, n_toxic = (sample.filter(F.col("toxic") == k).count() for k in (0, 1))

    def spread(only: frozenset | None):
        def count(batches: Iterator[dict]) -> Iterator[dict]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch["text"]:
                    cores = {w.strip(_TRIM) for w in set(tokens(text))} - {"", "\x00"}
                    found = set().union(*map(forms, cores)) if cores else set()
                    seen.update(found if only is None else found & only)
            yield {"form": list(seen), "n": list(seen.values())}

        return count

    def counted(label: int, only: frozenset | None):
        rows = map_texts(sample.filter(F.col("toxic") == label), {"text": F.col("text")}, spread(only), "form string, n long")
        return rows.groupBy("form").agg(F.sum("n").alias("n"))

    # At most sample_toxic texts' forms, each in SUPPORT texts or more.
    toxic = {r["form"]: r["n"] for r in counted(1, None).filter(F.col("n") >= SUPPORT).toLocalIterator()}
    clean = {r["form"]: r["n"] for r in counted(0, frozenset(toxic)).toLocalIterator()}
    grammar = Grammar(build_lexicon(toxic, clean, n_toxic, n_clean))
    shared = documents.sparkSession.sparkContext.broadcast(grammar)

    def measure(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"x": [shared.value.features(t).tolist() for t in batch["text"]], "toxic": batch["toxic"]}

    # A few numbers for each row of the bounded sample.
    rows = map_texts(sample, {"text": F.col("text"), "toxic": F.col("toxic")}, measure, "x array<double>, toxic int").collect()
    if rows and n_toxic and n_clean:
        grammar.weights = fit_weights(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float))
    return grammar


def score_documents(documents: DataFrame, grammar: Grammar, threshold: float = 0.7, fold: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(grammar)  # a lexicon of some hundred patterns

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = shared.value
        for batch in batches:
            for part in bounded(batch):
                scores = [own.score(t) for t in part["text"]]
                yield {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": scores, "predicted": [int(x >= threshold) for x in scores]}

    own = F.col("doc_id")
    columns = {"doc_id": own.cast("long"), "held_out": F.coalesce(remainder(own, fold) == held_out, F.lit(False)), "text": F.col("text")}
    return map_texts(documents, columns, run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labelled documents outside the held-out fold and scores all."""
    return score_documents(documents, fit(documents, labels))
