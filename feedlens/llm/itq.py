"""op5: embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (principal directions, then alternating signs
and orthogonal Procrustes) and turn a vector into balanced binary codes.  Each code is
cut into substrings, one hash table per substring and label: near vectors share at least
one substring with high probability, measured on pairs planted around the sampled vectors.  What a table returns is reranked with the original
vectors in double precision, in blocks, so links are exact and pairs are never listed:
a block yields link counts and a spanning forest.  Equal vectors are one row with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import components, pick, prepare, stored

SAMPLE, ROUNDS, MISS, BLOCK_ROWS = 8192, 30, 1e-4, 2048
PLANTED, MISSED, MOST = 4096, 1e-3, 64  # vectors with planted pairs, share that may be missed, rotations before substrings get shorter


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): up to 64 principal directions, rotated so that signs lose least."""
    r = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    c = min(64, x.shape[1])
    _, vec = np.linalg.eigh(np.cov((x - mean).T).reshape(x.shape[1], x.shape[1]) + 1e-12 * np.eye(x.shape[1]))
    top = vec[:, ::-1][:, :c]
    v = (x - mean) @ top
    rot, _ = np.linalg.qr(r.normal(size=(c, c)))
    for _ in range(rounds):
        b = np.sign(v @ rot)
        u, _, w = np.linalg.svd(v.T @ b)
        rot = u @ w
    return mean, top @ rot


def table_plan(rows: int, bits: int, least: float) -> tuple[int, int, int]:
    """(substring bits, substrings per code, rotations): substrings long enough for about one chance
    row per bucket, and enough of them that a pair at the threshold shares none with chance MISS."""
    sub = max(1, min(bits, max(12, min(24, math.ceil(math.log2(max(rows, 2)))))))
    per = max(1, bits // sub)
    same = (1 - math.acos(min(1.0, least)) / math.pi) ** sub
    return sub, per, max(1, math.ceil(math.log(MISS) / math.log(1 - same) / per)) if same < 1 else 1


def planted(x: np.ndarray, least: float, seed: int) -> list[np.ndarray]:
    """Partners of unit vectors at a cosine of ``least``: turned in any direction, and in the direction
    of the difference of two of the vectors (where the data varies)."""
    r = np.random.default_rng(seed)
    out = []
    for step in (r.normal(size=x.shape), x[r.permutation(len(x))] - x[r.permutation(len(x))] + 1e-9 * r.normal(size=x.shape)):
        step = step - (step * x).sum(axis=1, keepdims=True) * x
        step /= np.maximum(np.sqrt((step * step).sum(axis=1, keepdims=True)), 1e-300)
        out.append(least * x + math.sqrt(max(0.0, 1 - least * least)) * step)
    return out


def substrings(x: np.ndarray, mean: np.ndarray, proj: np.ndarray, sub: int) -> list[np.ndarray]:
    """The code's substrings as numbers, one array per table of the rotation (no bits: all rows meet)."""
    bit = (x - mean) @ proj >= 0
    return [part @ (1 << np.arange(part.shape[1], dtype=np.int64))
            for part in (bit[:, j * sub:(j + 1) * sub] for j in range(max(1, bit.shape[1] // max(1, sub))))]


def planned(x: np.ndarray, sub: int, count: int, least: float) -> tuple[int, list]:
    """(substring bits, rotations) for unit vectors like ``x``: at least ``count`` rotations, and more
    until pairs planted at the threshold share a substring, of either kind all but MISSED of them.

    Signs are taken after the mean, where such pairs lie further apart the longer the mean is; so
    the share is measured on the codes.  Where MOST rotations don't do, substrings get shorter."""
    base, models = x[:PLANTED], []
    pairs = planted(base, least, len(x))
    while True:
        missed, used = [np.ones(len(base), bool) for _ in pairs], 0
        while used < max(count, MOST):
            if used == len(models):
                models.append(learn_rotation(x, 100 + used))
            own = substrings(base, *models[used], sub)
            for lost, y in zip(missed, pairs):
                for a, b in zip(own, substrings(y, *models[used], sub)):
                    lost &= a != b
            used += 1
            if used >= count and max(m.mean() for m in missed) <= MISSED:
                return sub, models[:used]
        sub, count = sub - 1, 1


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plans(sample: list, rows: int, least: float) -> dict[int, tuple[int, list]]:
    """(substring bits, rotations) per length of the sampled vectors that has enough of them; each length has
    its own plan, so short vectors don't shorten the substrings of long ones."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        x = unit(np.array([v for v in sample if len(v) == dim], float))
        if len(x) >= 2 * dim:
            sub, _, count = table_plan(rows, min(64, dim), least)
            out[dim] = planned(x, sub, count, least)
    return out


def _codes(models: dict, rows: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            out: list = [None] * len(vecs)
            dims = np.array([len(v) for v in vecs])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unit(np.array([vecs[i] for i in at], float))
                own, rotations = models.get(int(dim)) or _plain_models(int(dim), rows, least)
                keys = [k for mean, proj in rotations for k in substrings(x, mean, proj, own)]
                for i, row in zip(at, np.stack(keys, axis=1).tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "codes"])
    return run


def _plain_models(dim: int, rows: int, least: float) -> tuple[int, list]:
    """Random rotations, for lengths that the sample does not hold often enough."""
    sub, _, count = table_plan(rows, min(64, dim), least)
    r = np.random.default_rng(dim)
    return sub, [(np.zeros(dim), np.linalg.qr(r.normal(size=(dim, dim)))[0][:, :64]) for _ in range(count)]


def _links(least: float):
    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        node = np.array([r[1] for r in rows], np.int64)
        weight = np.array([r[2] for r in rows], np.int64)
        side, table = np.array([r[3] for r in rows]), rows[0][4]
        code = np.array([r[5] for r in rows], np.int64)
        x = unit(np.array([r[6] for r in rows], float))
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        i, j = np.nonzero(x[left] @ x[right].T >= least)
        i, j = left[i], right[j]
        keep = (i < j) if side.min() == side.max() else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        if table:                       # a pair counts in the first table that holds it
            fresh = ~(code[i, :table] == code[j, :table]).any(axis=1)
            ci, cj = i[fresh], j[fresh]
        else:
            ci, cj = i, j
        got = np.bincount(ci, weight[cj], len(node)) + np.bincount(cj, weight[ci], len(node))
        low = np.arange(len(node))      # smallest row of the block's component
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            new = new[new]
            if (new == low).all():
                break
            low = new
        use = np.flatnonzero((got > 0) | (low != np.arange(len(node))))
        if len(use):
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[use]), pa.array(got[use].astype(np.int64)), pa.array(node[low[use]])],
                names=["node", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
                if row[0] != last:
                    if len(rows) > 1:
                        yield from solve(rows)
                    rows, last = [], row[0]
                rows.append(row)
        if len(rows) > 1:
            yield from solve(rows)
    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links (rows linked directly), component_id (smallest vec_id
    reachable, itself included), kept (vec_id = component_id).

    Links join rows with equal, non-null labels and a cosine of at least ``least`` in double
    precision.  Null, empty and zero vectors and vectors with null or non-finite components
    link with nothing, nor do vectors of different lengths.  Repeated rows link with each other;
    rows that share a vec_id count as one node; an empty table gives an empty result; extra
    columns are ignored.  A row without vec_id takes its component's smallest, null if none.

    The rotations are fitted on at most SAMPLE vectors, chosen by id hash; all rows are indexed."""
    spark = embeddings.sparkSession
    prepare(spark)
    e = pick(embeddings, vec_id="long", embedding="array<double>", label="string")
    fine = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    e = e.withColumn("fine", F.coalesce(fine, F.lit(False)))
    cls = e.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    cls = stored(cls.withColumn("node", F.coalesce("low", -F.abs(F.xxhash64("label", "embedding")))), "vectors")
    size = cls.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sample = [r[0] for r in cls.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").collect()]
    codes = cls.select("node", "embedding").mapInArrow(
        _codes(plans(sample, size, least), size, least), "node long, codes array<long>")
    codes = stored(codes, "codes")
    keys = (codes.join(cls.select("node", "label", F.size("embedding").alias("dim")), "node")
            .select("node", F.posexplode("codes").alias("t", "code"), "label", "dim")
            .select("node", "t", F.xxhash64("label", "dim", "t", "code").alias("key")))
    many = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = keys.join(many, "key").withColumn("c", F.ceil(F.col("m") / BLOCK_ROWS).cast("long"))
    met = met.withColumn("h", F.expr("pmod(xxhash64(node), c)")).withColumn("o", F.explode(F.expr("sequence(0L, c - 1)")))
    met = met.select(F.xxhash64("key", F.least("h", "o"), F.greatest("h", "o")).alias("k"), "node", "h", "t")
    rows = (met.join(codes, "node").join(cls.select("node", "weight", "embedding"), "node")
            .select("k", "node", "weight", "h", "t", "codes", "embedding"))
    dealt = rows.repartition("k").sortWithinPartitions("k")
    found = stored(dealt.mapInArrow(_links(least), "node long, links long, peer long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    whole = (cls.select("label", "embedding", "low", "weight", "node").join(links, "node", "left").join(comp, "node", "left")
             .select("label", "embedding", "low", "weight", F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("component", "node").alias("component")))
    lowest = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    whole = whole.join(lowest, "component").select(
        F.col("label").alias("l"), F.col("embedding").alias("v"), (F.col("weight") - 1 + F.col("links")).alias("n_links"), "component_id")
    linked = e.where("fine").join(whole, F.expr("label = l and embedding = v")).select("vec_id", "n_links", "component_id")
    alone = e.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
