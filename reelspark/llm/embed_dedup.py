"""Near duplicates of embedding vectors by randomised-rotation binary codes with stored correction factors.

A unit vector is turned by seeded random rotations; the signs of the turned coordinates are its code. With the code goes
a correction factor f = <code, vector>, and from it an unbiased estimate of the inner product with any other vector v:
<code, v> / f. Of v four bit planes of each coordinate are kept; what rounding may add is part of the bound. The estimate
errs by more than EPSILON * sqrt((1 - f*f) / (f*f * (d - 1))) only with a probability that falls as exp(-EPSILON**2 / 2).
Pairs whose upper bound stays below the limit are dropped; all others are recomputed exactly, cosine in double precision,
and only that decides a link.

Candidates share all bits of one of several bands of the code. The bits of a pair at the limit agree with probability
1 - acos(limit) / pi each; bands are as many as leave a pair at the limit unmet with probability MISS at most. Bits a band grow with the
logarithm of the largest label, so that a bucket of unrelated vectors stays small. What goes with each band is a vector's number, code, planes and
correction factors, so shuffled bytes grow with the number of bands and not with its square; a pair that several bands let
through is made distinct before it is recomputed.

Equal vectors of one label are one node from the start, with a count; so exact copies cost nothing. The join by
bucket is an equi-join whose hot keys adaptive execution splits; what passes its condition are pairs that may be links. Links are
added up by node, and each task leaves a spanning forest of its links for the components. Vectors are broadcast to the pairs where their bytes are few
(BROADCAST_BYTES, from the counted rows), else joined by shuffle.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing
and get a row of their own; vectors of different lengths never link; a null vec_id gets a row with null component and links with
nothing; rows that repeat a vec_id are one vector (each of its contents links; the row counts distinct others); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, forest, map_texts, mix

COSINE = 0.93
#: A pair at the limit shares no band with this probability at most, and is estimated too low with about the same.
MISS = 1e-6
EPSILON = 5.3
PLANES = 4
#: Vectors of one label that a bucket holds by chance, about.
BUCKET = 16
#: Most bytes of vectors that are broadcast.
BROADCAST_BYTES = 32 << 20
_SEED = 20


def rotation(d: int, turn: int) -> np.ndarray:
    """A random rotation of d dimensions, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([_SEED, d, turn]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def band_plan(rows: int, limit: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of bands for labels of up to so many vectors."""
    bits = max(6, min(40, math.ceil(math.log2(max(2, rows) / BUCKET))))
    agree = 1 - math.acos(limit) / math.pi
    return bits, math.ceil(math.log(miss) / math.log(1 - agree**bits))


def encode(vectors: np.ndarray, bits: int, bands: int) -> dict[str, np.ndarray]:
    """Band keys (n, bands), code (n, words) and planes (n, PLANES * words) as longs, factor, low and step of unit vectors (n, d)."""
    n, d = vectors.shape
    words = -(-d // 64)
    signs, turned = [], None
    for turn in range(max(1, -(-bits * bands // d))):
        t = vectors @ rotation(d, turn).T
        turned = t if turned is None else turned
        signs.append(t > 0)
    flat = np.concatenate(signs, axis=1)
    weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    used = min(bands * bits, flat.shape[1]) // bits
    keys = (flat[:, : used * bits].reshape(n, used, bits) * weight).sum(axis=2, dtype=np.uint64)
    keys = mix(keys * np.uint64(bands + 1) + np.arange(used, dtype=np.uint64)).view(np.int64)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint64)

    def packed(flags: np.ndarray) -> np.ndarray:
        wide = np.zeros((n, words * 64), dtype=bool)
        wide[:, :d] = flags
        return (wide.reshape(n, words, 64) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)

    planes = np.concatenate([packed((level >> np.uint64(j)) & np.uint64(1) > 0) for j in range(PLANES)], axis=1)
    return {"keys": keys, "code": packed(signs[0]), "planes": planes, "factor": factor, "low": low, "step": step}


def _encoded(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sizes: dict[int, list[int]] = {}
            for i, v in enumerate(batch["vector"]):
                sizes.setdefault(len(v), []).append(i)
            for d, at in sizes.items():
                x = np.array([batch["vector"][i] for i in at], dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                own = encode(x, bits, bands)
                yield {"node": [batch["node"][i] for i in at], "label": [batch["label"][i] for i in at], "d": [d] * len(at)} | {k: v.tolist() for k, v in own.items()}

    schema = "node long, label string, d int, keys array<long>, code array<long>, planes array<long>, factor double, low double, step double"
    return map_texts(nodes, {"node": F.col("node"), "label": F.col("label").cast("string"), "vector": F.col("vector")}, run, schema)


def _estimate(code: str, factor: str, of: str, words: int) -> tuple[Column, Column]:
    """The estimate of <u, v> from u's code and v's planes, and the half width of its bound."""
    d = F.col("d").cast("double")
    planes, own = F.col(f"{of}_planes"), F.col(code)

    def count(j: int, masked: bool) -> Column:
        both = [F.bit_count(planes[j * words + w].bitwiseAND(own[w]) if masked else planes[j * words + w]) for w in range(words)]
        return sum(both[1:], both[0])

    # sum of sign * (low + step * level) = 2 * (sum over set bits) - (sum over all).
    on = sum((F.lit(1 << j) * count(j, True) for j in range(1, PLANES)), count(0, True))
    every = sum((F.lit(1 << j) * count(j, False) for j in range(1, PLANES)), count(0, False))
    ones = sum((F.bit_count(own[w]) for w in range(1, words)), F.bit_count(own[0]))
    low, step, f = F.col(f"{of}_low"), F.col(f"{of}_step"), F.col(factor)
    inner = (low * (2 * ones - d) + step * (2 * on - every)) / F.sqrt(d)
    width = F.lit(EPSILON) * F.sqrt(F.greatest(F.lit(0.0), 1 - f * f) / (f * f * F.greatest(d - 1, F.lit(1.0)))) + step * 0.5 * F.sqrt(d) / f
    return inner / f, width


def valid(vector: Column) -> Column:
    """A vector of finite components, not all zero."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & real & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(embeddings: DataFrame, limit: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("vector")))
    # One node for equal vectors of a label; numbers of nodes are fixed by being written.
    copies = good.select("vec_id", "label", F.sha2(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ","), 256).alias("same"), "vector")
    copies = checkpointed(copies.distinct())
    nodes = copies.groupBy("label", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("vector").alias("vector"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).agg(F.max("n").alias("largest"), F.sum("n").alias("n"), F.max("d").alias("d")).first()
    links = node_links(nodes, sizes["largest"] or 0, limit, (sizes["n"] or 0) * (sizes["d"] or 0) * 8)

    member = checkpointed(copies.select("vec_id", "label", "same").join(nodes.select("label", "same", "node", "rep", "many"), ["label", "same"]).select("vec_id", "node", "rep", "many"))
    far = links.select(F.col("x").alias("node"), F.col("y_many").alias("n")).unionByName(links.select(F.col("y").alias("node"), F.col("x_many").alias("n")))
    far = far.groupBy("node").agg(F.sum("n").alias("far"))
    counted = member.join(far, "node", "left").groupBy("vec_id").agg(F.sum(F.coalesce("far", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    edges = forest(links.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))).unionByName(member.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    parts = connected_components(edges).withColumnRenamed("id", "vec_id")
    ids = rows.filter(F.col("vec_id").isNotNull()).select("vec_id").distinct()
    out = ids.join(counted, "vec_id", "left").join(parts, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    nameless = rows.filter(F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def node_links(nodes: DataFrame, largest: int, limit: float, size: int) -> DataFrame:
    """Links between different vectors of nodes(node, label, rep, many, vector): x, y (nodes) with what rep and many each has; each link once."""
    bits, bands = band_plan(largest, limit)
    codes = checkpointed(_encoded(nodes, bits, bands))
    words = codes.agg(F.max(F.size("code")).alias("w")).first()["w"] or 1
    # Shorter vectors get words of zeros after their code and each of their planes, so that all are indexed alike.
    own, zeros = F.size("code"), F.array_repeat(F.lit(0).cast("long"), F.lit(words) - F.size("code"))
    planes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PLANES - 1)), lambda j: F.concat(F.slice("planes", j * own + 1, own), zeros)))
    padded = codes.withColumn("planes", F.when(own < words, planes).otherwise(F.col("planes"))).withColumn("code", F.when(own < words, F.concat("code", zeros)).otherwise(F.col("code")))
    # Keys are apart by band already; label and length are part of the bucket too. A chance meeting of buckets only costs an estimate where both are equal.
    carried = ("node", "group", "d", "code", "planes", "factor", "low", "step")
    side = padded.withColumn("group", F.xxhash64("label", "d")).select(F.explode("keys").alias("key"), *carried)
    side = side.withColumn("bucket", F.xxhash64("key", "group")).drop("key")

    def named(x: str) -> DataFrame:
        return side.select("bucket", "d", "group", *[F.col(c).alias(f"{x}_{c}") for c in carried if c not in ("d", "group")])

    forth, width = _estimate("x_code", "x_factor", "y", words)
    back, width_back = _estimate("y_code", "y_factor", "x", words)
    met = named("x").join(named("y"), ["bucket", "d", "group"])
    near = checkpointed(met.filter((F.col("x_node") < F.col("y_node")) & (forth + width >= limit) & (back + width_back >= limit)).select(F.col("x_node").alias("x"), F.col("y_node").alias("y")).distinct())
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"), F.col("rep").alias(f"{x}_rep"), F.col("many").alias(f"{x}_many"), F.col("vector").alias(f"{x}_vector"))
    sent = (lambda t: F.broadcast(t)) if size <= BROADCAST_BYTES else (lambda t: t)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    u, v = F.col("x_vector"), F.col("y_vector")
    exact = near.join(sent(of("x")), "x").join(sent(of("y")), "y").filter((F.col("x_label") == F.col("y_label")) & (F.size(u) == F.size(v)))
    return checkpointed(exact.filter(dot(u, v) / F.sqrt(dot(u, u) * dot(v, v)) >= limit).select("x", "y", "x_rep", "y_rep", "x_many", "y_many"))
