"""Language identification: held-out accuracy on the driver's documents."""

import random

from pyspark.sql import functions as F

from feedlens.operators import langid as LI
from tests.conftest import SF01


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    train = docs.where(F.col("doc_id") % 2 == 0)
    test = docs.where(F.col("doc_id") % 2 == 1).select("doc_id", "text", F.col("lang").alias("true_lang"))
    pred = LI.detect(test, LI.fit(train), id_col="doc_id", out_col="lang")
    acc = pred.agg(F.avg((F.col("lang") == F.col("true_lang")).cast("double"))).first()[0]
    assert acc > 0.97


def test_min_len_and_source_filter(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = LI.fit(docs)
    posts = spark.createDataFrame([(1, "short"), (2, "The quick brown fox jumps over the lazy dog again and again"),
                                   (3, "Der schnelle braune Fuchs springt über den faulen Hund und weiter")],
                                  "seq long, text string")
    kept = sorted(r.seq for r in LI.source_language_filter(posts, model).collect())
    assert 1 in kept and 3 not in kept


def _few_words(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chien et le chat", "fr"),
            (4, "the house", None), (5, "", "en"), (6, None, None), (7, "und der", None), (8, "12 34", None)]
    return spark.createDataFrame(rows, "seq long, text string, lang string")


def test_shuffled_weights_equal_broadcast_ones(spark):
    docs = _few_words(spark)
    model = LI.fit(docs)
    plain = LI.detect(docs, model, out_col="got")
    salted = LI.detect(docs, model, out_col="got", broadcast_bytes=0)
    want = {1: "en", 2: "de", 3: "fr", 4: "en", 5: None, 6: None, 7: "de", 8: None}
    assert {r.seq: r.got for r in plain.collect()} == {r.seq: r.got for r in salted.collect()} == want
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "hashpartitioning(code" in plan(salted) and "hashpartitioning(code" not in plan(plain.select("seq", "got")).split("BroadcastExchange")[0]


def test_more_classes_than_a_block_and_none(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)), f"c{i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "seq long, text string, lang string")
    got = {r.seq: r.got for r in LI.detect(docs, LI.fit(docs), out_col="got").collect()}
    assert sum(got[i] == f"c{i}" for i in range(150)) >= 145
    nothing = LI.fit(docs.limit(0))
    assert nothing.classes == [] and LI.detect(docs, nothing, out_col="got").where("got is not null").count() == 0


def test_cross_validation_never_sees_its_rows(spark):
    rows = [(i, "the cat and the dog" if i % 4 < 2 else "der hund und die katze", "en" if i % 4 < 2 else "de") for i in range(40)]
    rows += [(41, "zzz qqq xxx", "xx")]              # the only row of its class: its own fold's model has it, the other not
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = LI.cross_validated(docs).collect()
    assert len(got) == 41 and all(r.pred == r.lang for r in got if r.doc_id < 40)
    assert [r.pred for r in got if r.doc_id == 41][0] != "xx"
