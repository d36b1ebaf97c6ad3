"""op11: Merkle manifest of a dataset on concatenated-level strings.

Leaves are numbered per source and cut into aligned blocks of RUN**2.  A block keeps each
of its levels as one string of concatenated hex digests: a run is a fixed-width substring,
its hash the parent; what flanks a digest inside its run is the digest's sibling segment.
The blocks' roots are the nodes of the next round, until one block per source is left; the
sources' roots go through the same rounds to the dataset's root.  Sibling segments above a
block are the same for all its rows, so they are looked up once per block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import numbered, pick, prepare, stored

RUN, DIGEST = 16, 64
BLOCK = RUN * RUN                   # two levels a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """``blocks``: one row per block of leaves with its level strings and the path above it;
    ``sources``: source, n (rows), subroot, root."""
    blocks: DataFrame
    sources: DataFrame


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row: doc_id, source, lang, n_chars and ``text``, each with its length in bytes."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, bad (the leaf of the tampered row; null where no letter changes)."""
    d = pick(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").rlike("[A-Z]")
    return d.select("doc_id", "source", leaf(F.col("text")).alias("leaf"),
                    F.when(touched, leaf(F.translate("text", UPPER, LOWER))).alias("bad"))


def _parents(level: str) -> Column:
    """Digests of the runs of a level string, concatenated."""
    w = RUN * DIGEST
    return F.expr(f"array_join(transform(sequence(0, (length({level}) - 1) div {w}), "
                  f"i -> sha2(substring({level}, int(i) * {w} + 1, {w}), 256)), '')")


def _flanks(level: str, at: str) -> str:
    """SQL of the segments left and right of digest ``at`` within its run."""
    return (f"named_struct('left', substring({level}, ({at}) div {RUN} * {RUN * DIGEST} + 1, ({at}) % {RUN} * {DIGEST}), "
            f"'right', substring({level}, (({at}) + 1) * {DIGEST} + 1, ({RUN - 1} - ({at}) % {RUN}) * {DIGEST}))")


def _path(l0: str, l1: str, n: str, at: str) -> str:
    """SQL of the segments from node ``at`` of a block to the block's root."""
    return (f"cast(case when {n} = 1 then array() when {n} <= {RUN} then array({_flanks(l0, at)}) "
            f"else array({_flanks(l0, at)}, {_flanks(l1, f'({at}) div {RUN}')}) end as {PATH})")


def _blocks(nodes: DataFrame, *payload: str) -> DataFrame:
    """grp, n, block, items (payload in order), l0, l1, top of nodes (grp, n, pos, digest, payload)."""
    b = (nodes.groupBy("grp", "n", F.expr(f"pos div {BLOCK}").alias("block"))
         .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", *payload))).alias("_i")))
    b = b.select("grp", "n", "block", F.expr("array_join(_i.digest, '')").alias("l0"),
                 F.expr(f"transform(_i, i -> struct({', '.join(f'i.{c}' for c in payload)}))" if payload else "null").alias("items"))
    b = b.withColumn("l1", F.when(F.col("n") > 1, _parents("l0")))
    return b.withColumn("top", F.when(F.col("n") == 1, F.col("l0")).when(F.col("n") <= RUN, F.col("l1"))
                        .otherwise(_parents("l1")))


def _tree(nodes: DataFrame, most: int, *payload: str) -> tuple[DataFrame, DataFrame]:
    """(first round's blocks with ``path`` to their group's root, grp and root); ``most``: nodes of the largest group."""
    rounds = [stored(_blocks(nodes, *payload), "merkle")]
    while most > BLOCK:
        most = -(-most // BLOCK)
        rounds.append(stored(_blocks(rounds[-1].where(F.col("n") > BLOCK).select(
            "grp", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block").alias("pos"),
            F.col("top").alias("digest"))), "merkle"))
    roots = rounds[0].where(F.col("n") <= BLOCK).select("grp", "top")
    for b in rounds[1:]:
        roots = roots.union(b.where(F.col("n") <= BLOCK).select("grp", "top"))
    up = rounds[-1].withColumn("path", F.array().cast(PATH))
    for b in rounds[-2::-1]:
        above = up.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), F.col("n").alias("_n"),
                          F.col("l0").alias("_l0"), F.col("l1").alias("_l1"), F.col("path").alias("_path"))
        up = b.join(above, F.expr(f"grp <=> _g and n > {BLOCK} and block div {BLOCK} = _b"), "left").withColumn(
            "path", F.expr(f"coalesce(concat({_path('_l0', '_l1', '_n', f'int(block % {BLOCK})')}, _path), cast(array() as {PATH}))")
        ).drop("_g", "_b", "_n", "_l0", "_l1", "_path")
    return up, roots.toDF("grp", "root")


def build(docs: DataFrame) -> Manifest:
    """Manifest of ``docs``: leaves ascend by doc_id per source (null first), sources by their bytes (null first).

    Null fields are written as ``-``; repeated ids are ordered by leaf, repeated rows are leaves of
    their own; empty and very long texts are hashed whole; extra columns are ignored; an empty
    table has no blocks and no sources.  No task holds more than one block and one range of leaves."""
    prepare(docs.sparkSession)
    l = numbered(stored(leaves(docs), "leaves"), ["source", "doc_id", "leaf"], {}, "position")
    l = stored(l, "placed")
    counts = l.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n"), F.min("position").alias("_first"))
    most = counts.agg(F.max("n")).first()[0] or 0
    nodes = l.join(counts, F.expr("source <=> _s")).select(
        F.col("source").alias("grp"), "n", (F.col("position") - F.col("_first")).alias("pos"),
        F.col("leaf").alias("digest"), "doc_id", "bad")
    blocks, roots = _tree(nodes, most, "doc_id", "bad")
    subroots = numbered(roots, ["grp"], {}, "pos")
    k = subroots.agg(F.count("*")).first()[0]
    tops, root = _tree(subroots.select(F.lit("").alias("grp"), F.lit(k).alias("n"), "pos", F.col("root").alias("digest"),
                                       F.col("grp").alias("source")), k, "source")
    top = (tops.select("n", "l0", "l1", "path", F.posexplode("items").alias("_at", "_i"))
           .select(F.col("_i.source").alias("_source"), F.expr(f"substring(l0, _at * {DIGEST} + 1, {DIGEST})").alias("subroot"),
                   F.expr(f"concat({_path('l0', 'l1', 'n', '_at')}, path)").alias("_above"))
           .crossJoin(F.broadcast(root.select("root"))))     # one row
    top = stored(top, "subroots")
    blocks = blocks.join(top, F.expr("grp <=> _source")).withColumn("path", F.concat("path", "_above")).drop("_source", "_above")
    sources = top.join(counts, F.expr("_source <=> _s")).select(F.col("_source").alias("source"), "n", "subroot", "root")
    return Manifest(blocks, sources)


def proofs(m: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, bad, subroot, root, path (sibling segments from the leaf's run to the root)."""
    rows = m.blocks.select("n", "l0", "l1", "path", "subroot", "root", F.posexplode("items").alias("_at", "_i"))
    return rows.select("_i.doc_id", F.expr(f"substring(l0, _at * {DIGEST} + 1, {DIGEST})").alias("leaf"), "_i.bad",
                       "subroot", "root", F.expr(f"concat({_path('l0', 'l1', 'n', '_at')}, path)").alias("path"))


def fold(digest: str) -> Column:
    """Root recomputed from column ``digest`` and the sibling segments of ``path``."""
    return F.expr(f"aggregate(path, {digest}, (d, s) -> sha2(concat(s.left, d, s.right), 256))")


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: rows whose
    crc32(doc_id) is a multiple of 5 are checked with the A-Z of their text in lower case
    (null ids are never touched)."""
    p = proofs(build(docs)).withColumn("_d", F.coalesce("bad", "leaf"))
    return p.select("doc_id", "leaf", "subroot", "root",
                    F.expr("sha2(array_join(flatten(transform(path, s -> array(s.left, s.right))), ''), 256)").alias("proof_sha256"),
                    fold("_d").alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
