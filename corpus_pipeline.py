"""Corpus pipeline: toxicity, near-duplicates, repeated passages, source mix, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.llm import minhash_bbit, mixing, packing, suffix_dedup, toxicity
from feedlens.llm.common import prepare, stored
from feedlens.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, by exact name."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[(F.col(f"_c{names.index(c)}") if c in names else F.lit(None)).cast(
        "long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in COLUMNS])


def _key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op7: documents with a score of at least 0.7 go; null and empty texts are scored as empty."""
    prepare(spark)
    docs = _documents(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(~toxicity.rejected(model)("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op9: one document of each group of near-duplicates (five words, 0.8) stays, the smallest
    doc_id; texts without words stay; of repeated rows one stays."""
    docs = _documents(docs)
    keep = (minhash_bbit.near_groups(docs, words=5, num=80, den=100).where("kept")
            .select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).distinct())
    rows = docs.withColumn("_k", _key()).join(keep, F.expr("doc_id <=> _d and _k = _t"))
    first = Window.partitionBy("doc_id", "_k").orderBy(F.lit(1))
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op1: strings of 200 bytes that start at two places or more are cut out of every text; all
    rows stay, n_chars follows the text."""
    docs = suffix_dedup.cut_repeats(_documents(docs))
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op4: each document as the mix takes it, 0 to 3 times; the one document that its source's target cuts
    is emitted with its first words as far as they are taken (n_chars follows), so a source of one long
    document keeps its share.  Documents without words are not taken; repeated rows share what the mix
    takes of them; very long texts are cut in one task each; an empty table gives an empty result."""
    docs = _documents(docs)
    took = (mixing.mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), F.col("source").alias("_s"))
            .agg(F.sum("taken").alias("_sum"), F.first("size").alias("_size")))
    one = Window.partitionBy("doc_id", "_k", "source").orderBy(F.lit(1))
    rows = (docs.withColumn("_k", _key()).join(took, F.expr("doc_id <=> _d and _k = _t and source <=> _s"))
            .withColumn("_n", F.row_number().over(one)).where("_n = 1"))
    whole = rows.where("_sum >= _size").withColumn("_pass", F.explode(F.expr("sequence(1, _sum div _size)")))
    part = (rows.where("_sum % _size > 0").withColumn("text", mixing.first_words()("text", F.expr("_sum % _size")))
            .withColumn("n_chars", F.length("text").cast("long")))
    return whole.select(*COLUMNS).unionByName(part.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op6: pieces of at most 4096 tokens with their place in the packed sequences."""
    return packing.pack(_documents(docs), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

# Scoring, signatures and tokens have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
