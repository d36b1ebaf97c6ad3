"""op9: near-duplicate groups by b-bit MinHash.

1. ``sign``: every text becomes a set of word-shingle hashes; 256 minima, of which the
   first ones form band keys and the low 2 bits of all are kept, packed in 8 longs.
   Equal sets share a class (128-bit hash of the sorted set); one representative per
   class goes on, so a group of copies counts once.
2. ``candidates``: representatives that share a band key meet.  First every member of a
   bucket is paired with the bucket's smallest member only (linear in the bucket).
3. The collision-corrected similarity, estimated from the packed bits by bit counts,
   drops pairs far below the threshold (``MARGIN`` is over 4.5 standard errors).
4. ``verified``: the remaining pairs are confirmed exactly on the full shingle sets.
5. Pairs of one bucket that are still in different components are estimated in blocks
   and confirmed too, best first, until none is left: no cap, and never all pairs of
   a bucket that is already one component.

Bands of 5 minima; their number gives a pair at the threshold a chance below 1e-6 to
share no band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import components, pick, prepare, stored
from feedlens.llm.words import minima, permutations, shingles, word_hashes

MINIMA, BITS, BAND_ROWS, SEED = 256, 2, 5, 9
MARGIN = 0.125
PAIRS_PER_TASK = 256
BLOCK_ROWS = 2048
SIG = [f"s{i}" for i in range(MINIMA * BITS // 64)]


def band_count(threshold: float, miss: float = 1e-6) -> int:
    """Bands so that a pair at the threshold shares none with a chance below ``miss``."""
    n = math.ceil(math.log(miss) / math.log(1 - threshold ** BAND_ROWS))
    return min(n, MINIMA // BAND_ROWS)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text, A-Z lower-cased."""
    return np.unique(shingles(word_hashes((text or "").encode("utf-8", "replace").lower()), words))


def pack_bits(mins: np.ndarray) -> np.ndarray:
    """Low 2 bits of each minimum (after mixing in the high half), 32 to a 64-bit word."""
    low = ((mins >> np.uint64(40)) & np.uint64(3)).reshape(len(mins), -1, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def _sign(words: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(MINIMA, SEED)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                sets = [shingle_set(t, words) for t in texts[at:at + 256]]
                m = minima(sets, a, b)
                sig = pack_bits(m).view(np.int64)
                keys = np.stack([_band(m, j) for j in range(bands)], axis=1).view(np.int64)
                empty = np.array([len(s) == 0 for s in sets])
                cls = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()),
                     *[pa.array(sig[:, i]) for i in range(len(SIG))],
                     pa.array([None if e else k for e, k in zip(empty, keys.tolist())], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "cls", *SIG, "bands"])
    return run


def _band(m: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.full(len(m), j + 1, np.uint64)
        for i in range(BAND_ROWS):
            h = (h ^ m[:, j * BAND_ROWS + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def sign(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """(doc_id, n_shingles, cls, s0..s7, bands) per row; ``bands`` is null for an empty set."""
    schema = "doc_id long, n_shingles long, cls binary, " + ", ".join(f"{s} long" for s in SIG) + ", bands array<long>"
    return docs.mapInArrow(_sign(words, band_count(threshold)), schema)


def estimate(left: str = "l", right: str = "r"):
    """Column: similarity from the packed bits of two rows, corrected for chance agreement."""
    differ = sum((F.bit_count((F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}")))
                  .bitwiseAND(F.lit(0x5555555555555555))
                  .bitwiseOR(F.shiftrightunsigned(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}")), 1)
                             .bitwiseAND(F.lit(0x5555555555555555)))) for s in SIG), F.lit(0))
    chance = 2.0 ** -BITS
    return ((1 - differ / MINIMA) - chance) / (1 - chance)


def _pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw = [z.compress((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["node", "z"])


def _verify(words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, head, base = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, c, b, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                s = shingle_set(z.decompress(raw).decode("utf-8", "replace"), words)
                if b is None:
                    head, base = (a, c), s
                    continue
                assert head == (a, c)
                both = len(np.intersect1d(base, s, assume_unique=True))
                if den * both >= num * (len(base) + len(s) - both):
                    out.append((a, b, both, len(base) + len(s) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                             names=["a", "b", "shared", "joint"])
    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with den * shared >= num * joint on the full sets.  The partners of one
    ``a`` are dealt over tasks of about PAIRS_PER_TASK, so a hub is never one task."""
    deg = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).alias("c"))
    dealt = pairs.join(deg, "a").select("a", F.expr("pmod(xxhash64(b), c)").cast("long").alias("c"), "b")
    partner = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "c", "b", "z")
    heads = dealt.select("a", "c").distinct().join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", "c", F.lit(None).cast("long").alias("b"), "z")
    rows = heads.union(partner).repartition("a", "c").sortWithinPartitions("a", "c", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify(words, num, den), "a long, b long, shared long, joint long")


def _across(limit: int, least: float):
    """Per bucket block: query rows against base rows of other components, the best
    ``limit`` of each (query, component); ``more`` marks queries with further pairs."""
    def flush(rows) -> Iterator[pa.RecordBatch]:
        node = np.array(rows[1], np.int64)
        comp = np.array(rows[2], np.int64)
        query = np.array(rows[3], bool)
        sig = np.stack([np.array(c, np.int64) for c in rows[4:]], axis=1).view(np.uint64)
        bn, bc, bs = node[~query], comp[~query], sig[~query]
        odd = np.uint64(0x5555555555555555)
        a, b, m = [], [], []
        for n, c, s in zip(node[query], comp[query], sig[query]):
            x = bs ^ s
            differ = np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(axis=1, dtype=np.int64)
            est = ((1 - differ / MINIMA) - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)
            hit = np.flatnonzero((est >= least) & (bc != c))
            if not len(hit):
                continue
            order = hit[np.lexsort((bn[hit], -est[hit], bc[hit]))]
            first = np.flatnonzero(np.r_[True, np.diff(bc[order]) != 0])
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            order, more = order[rank < limit], bool((rank >= limit).any())
            a += np.minimum(bn[order], n).tolist()
            b += np.maximum(bn[order], n).tolist()
            m += [more] * len(order)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m)],
                                             names=["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*cols):
                if row[0] != key:
                    if held:
                        yield from flush(held)
                    held, key = [[] for _ in row[1:]], row[0]
                for h, v in zip(held, row[1:]):
                    h.append(v)
        if held:
            yield from flush(held)
    return run


def _other_pairs(buckets: DataFrame, sigs: DataFrame, comp: DataFrame, limit: int, least: float) -> DataFrame:
    """Estimated pairs of one bucket in different components: every row outside the bucket's
    largest component against the whole bucket, in blocks of about BLOCK_ROWS rows."""
    rows = (buckets.join(comp, "node", "left")
            .select("key", "node", F.coalesce("component", "node").alias("comp")))
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = (per.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("m"),
                                    F.max(F.struct("n", "comp")).alias("big"))
             .where("k > 1").select("key", F.ceil(F.col("m") / BLOCK_ROWS).alias("c"), F.col("big.comp").alias("main")))
    rows = rows.join(mixed, "key").join(sigs, "node")
    cols = ["node", "comp", *SIG]
    block = F.expr("pmod(xxhash64(node), c)").cast("long")
    base = rows.select(F.struct("key", block.alias("blk")).alias("key"), "node", "comp", F.lit(False).alias("q"), *SIG)
    query = rows.where("comp <> main").select("key", F.explode(F.expr("sequence(0L, c - 1)")).alias("blk"), *cols).select(
        F.struct("key", "blk").alias("key"), "node", "comp", F.lit(True).alias("q"), *SIG)
    dealt = base.union(query).repartition("key").sortWithinPartitions("key")
    flat = dealt.select(F.xxhash64("key.key", "key.blk").alias("k"), "node", "comp", "q", *SIG)
    return flat.mapInArrow(_across(limit, least), "a long, b long, more boolean")


def group_similar(signed: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Classes of ``signed`` with their group: (cls, component_id), component_id = smallest
    doc_id reachable over links of at least num/den.  ``signed`` must be a stored table.

    Classes without any doc_id are negative stand-ins and give a null component_id."""
    least = num / den - MARGIN
    reps = (signed.where("bands is not null").groupBy("cls")
            .agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in SIG]))
    node = F.coalesce("doc_id", -F.abs(F.xxhash64("cls")))
    reps = stored(reps.withColumn("node", node), "classes")
    keys = reps.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    buckets = stored(keys.join(shared, "key").select("key", "node", "hub"), "buckets")
    members = buckets.select("node").distinct()
    sigs = reps.select("node", *SIG)
    # the text of one row for each class that has a candidate
    held = reps.select(F.col("doc_id"), F.col("node"), "cls").join(members, "node", "left_semi")
    owner = signed.where("bands is not null").select("doc_id", "cls", "tkey").join(
        held.select("cls", "node", F.col("doc_id").alias("rep")), "cls").where("doc_id <=> rep")
    owner = owner.groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("o")).select("node", "o.*")
    one = docs.join(owner, F.expr("xxhash64(coalesce(text, '')) = tkey") & docs["doc_id"].eqNullSafe(owner["doc_id"]))
    texts = stored(one.select("node", "text").mapInArrow(_pack_text, "node long, z binary")
                   .dropDuplicates(["node"]), "texts")

    def estimated(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(sigs.alias("l"), F.col("a") == F.col("l.node"))
                .join(sigs.alias("r"), F.col("b") == F.col("r.node")))
        return both.where(estimate() >= least).select("a", "b")

    pairs = estimated(buckets.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    tested = stored(pairs, "pairs")
    links = stored(verified(tested, texts, words, num, den), "links")
    limit = 4
    while True:
        comp = stored(components(links.select("a", "b")), "components")
        more = stored(_other_pairs(buckets.select("key", "node"), sigs, comp, limit, least)
                      .groupBy("a", "b").agg(F.max("more").alias("more")), "others")
        new = stored(more.select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        left = more.agg(F.max("more").alias("m")).first()["m"]
        if new.isEmpty():
            if not left:
                break
        else:
            links = links.union(stored(verified(new, texts, words, num, den), "links"))
            tested = tested.union(new)
        limit *= 8
    comp = reps.select("cls", "doc_id", "node").join(comp, "node", "left").select(
        "cls", "doc_id", F.coalesce("component", "node").alias("component"))
    low = comp.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return comp.join(low, "component").select("cls", "component_id")


def near_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: doc_id, tkey (hash of the text), n_shingles, component_id, kept.

    Links documents whose sets of ``words``-word shingles have a Jaccard similarity of at
    least num/den.  Null and empty texts and texts without words have an empty set and are
    linked with nothing (component_id = doc_id, kept).  Repeated rows are one class; rows
    that share a doc_id count as one node.  Ties: the smallest doc_id is kept.  A row
    without doc_id takes the component's smallest doc_id, null if there is none, and is
    kept only in the latter case.  An empty table gives an empty result; extra columns
    are ignored."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string")
    keyed = d.withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    # mapInArrow sees (doc_id, text); the key of the row is added from the same columns
    signed = stored(_sign_with_key(keyed, words, num / den), "signed")
    groups = group_similar(signed, d, words, num, den)
    out = signed.select("doc_id", "tkey", "n_shingles", "cls").join(groups, "cls", "left")
    cid = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tkey", "n_shingles", cid.alias("component_id"),
                      F.col("doc_id").eqNullSafe(cid).alias("kept"))


def _sign_with_key(keyed: DataFrame, words: int, threshold: float) -> DataFrame:
    run, fields = _sign(words, band_count(threshold)), ", ".join(f"{s} long" for s in SIG)

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2).slice(at, out.num_rows)],
                                                 names=[*out.schema.names, "tkey"])
                at += out.num_rows
    return keyed.mapInArrow(with_key, f"doc_id long, n_shingles long, cls binary, {fields}, bands array<long>, tkey long")
