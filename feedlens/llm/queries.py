"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import (curve_packing, fingerprints, hilbert, huffman, itq, licenses, merkle, minhash_bbit, mixing, packing,
                          suffix_dedup, toxicity, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file (the operators take any path)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("tkey")


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(_table(spark, sf_dir, "documents"))


def op4_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "tkey", "first_slot")


def op5_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    s = toxicity.score(docs, toxicity.fit(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return s.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bbit.near_groups(_table(spark, sf_dir, "documents"), words=3, num=85, den=100).drop("tkey")


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_merkle_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op12_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = curve_packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_minhash_fingerprints, op3_hilbert_shards, op4_low_discrepancy_mix, op5_itq_near_dedup,
    op6_best_fit_packing, op7_compression_toxicity, op8_huffman_ids, op9_bbit_minhash, op10_license_sentences,
    op11_merkle_levels, op12_cholesky_whitening, op13_curve_packing, pipeline)}


def _license_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"{q(s)}: {q(i)}" for i, s in licenses.SENTENCES.items())

    def read(text: str) -> str:
        return f"""list_filter(list_transform(
    string_split(regexp_replace({text}, '[.!?:;]+(\\s|$)', chr(10), 'g'), chr(10)),
    lambda s: map_extract_value(MAP {{{known}}}, trim(regexp_replace(s, '[^a-z0-9.+-]+', ' ', 'g')))),
    lambda x: x IS NOT NULL)"""

    held: list[tuple[str, str]] = []
    rules, lics = [], []
    for name, lic, ids in licenses.RULES:
        ok = f"contains(' ' || sentence_ids || ' ', ' {ids} ')"
        for longer, match in held:
            if f" {ids} " in f" {longer} ":
                ok += f" AND NOT ({match})"
        held.append((ids, ok))
        rules.append(f"CASE WHEN {ok} THEN '{name}' END")
        lics.append(f"CASE WHEN {ok} THEN '{lic}' END")
    return f"""
WITH parts AS (
  SELECT doc_id, {read("lower(coalesce(text, ''))")} AS by_line,
    {read("regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')")} AS wrapped FROM documents),
chosen AS (SELECT doc_id, CASE WHEN len(wrapped) > len(by_line) THEN wrapped ELSE by_line END AS ids FROM parts),
found AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ' ') AS sentence_ids FROM chosen),
named AS (SELECT *, list_filter([{', '.join(rules)}], lambda x: x IS NOT NULL) AS r,
  list_filter([{', '.join(lics)}], lambda x: x IS NOT NULL) AS l FROM found)
SELECT doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(r, ','), '') AS rules,
  coalesce(array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(l, lambda v: [v])),
    lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ','), '') AS licenses
FROM named"""


# crc32 of a decimal number bit by bit: a byte is xored in, eight shifts follow.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in (
        "CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(parts)})"


_MERKLE = f"""
WITH RECURSIVE rows_ AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM rows_),
nodes AS (
  SELECT 0 AS lvl, source, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT lvl, source, run, digest, count(*) OVER (PARTITION BY source) FROM (
    SELECT lvl + 1 AS lvl, source, pos // 16 AS run, sha256(string_agg(digest, '' ORDER BY pos)) AS digest
    FROM nodes WHERE n > 1 GROUP BY lvl, source, pos // 16)),
kept AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT source, lvl AS height, digest AS subroot,
    row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM kept WHERE n = 1),
upper_ AS (
  SELECT 0 AS lvl, place AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl, run, digest, count(*) OVER () FROM (
    SELECT lvl + 1 AS lvl, pos // 16 AS run, sha256(string_agg(digest, '' ORDER BY pos)) AS digest
    FROM upper_ WHERE n > 1 GROUP BY lvl, pos // 16)),
tops AS MATERIALIZED (SELECT * FROM upper_),
steps AS (
  SELECT l.source, l.pos AS leaf_pos, k.lvl AS step,
    coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos < l.pos // pow(16, k.lvl)::BIGINT), '') AS lhs,
    coalesce(string_agg(k.digest, '' ORDER BY k.pos) FILTER (k.pos > l.pos // pow(16, k.lvl)::BIGINT), '') AS rhs
  FROM leaves l JOIN kept k ON l.source IS NOT DISTINCT FROM k.source AND k.n > 1
    AND k.pos // 16 = l.pos // pow(16, k.lvl + 1)::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.source, l.pos, s.height + t.lvl,
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.place // pow(16, t.lvl)::BIGINT), ''),
    coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.place // pow(16, t.lvl)::BIGINT), '')
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
  JOIN tops t ON t.n > 1 AND t.pos // 16 = s.place // pow(16, t.lvl + 1)::BIGINT
  GROUP BY ALL),
path AS MATERIALIZED (SELECT * FROM steps),
fold AS (
  SELECT source, pos, 0 AS step, coalesce(bad, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(p.lhs || f.digest || p.rhs) FROM fold f
  JOIN path p ON p.source IS NOT DISTINCT FROM f.source AND p.leaf_pos = f.pos AND p.step = f.step),
folded AS (SELECT source, pos, max_by(digest, step) AS folded_root FROM fold GROUP BY ALL),
proof AS (SELECT source, leaf_pos, sha256(string_agg(lhs || rhs, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
  f.folded_root = r.digest AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
JOIN folded f ON f.source IS NOT DISTINCT FROM l.source AND f.pos = l.pos
LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_pos = l.pos
CROSS JOIN (SELECT digest FROM tops WHERE n = 1) r"""

ORACLE = {"op10_license_sentences": _license_sql(), "op11_merkle_levels": _MERKLE}
