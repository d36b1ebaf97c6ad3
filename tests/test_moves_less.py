"""Texts that are not asked for are not moved, batches of texts are read a slice at a time."""

import json
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from feedlens.operators import langid as LI
from feedlens.operators import merge as MG
from feedlens.operators import phrases as PH
from feedlens.operators import stats as ST
from feedlens.sources import adapters as A
from feedlens.sources import feeds as FD


def _docs(spark, n=60):
    return spark.createDataFrame([(i, f" Text {i % 7} \n" if i % 5 else "  ", "s", "en") for i in range(n)],
                                 "doc_id long, text string, source string, lang string")


def _events(spark, n=60):
    return spark.range(n).selectExpr("id as event_id", "timestamp'2024-01-15' + make_interval(0, 0, 0, id % 3) as ts", "id % 4 as user_id",
                                     "'click' as event_type", "id % 9 / 2.0 as value", """'{"k": 3}' as props""")


def _moved(df):
    """Lines of the plan above the tables that hand on a text."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [x for x in plan if "Rel" not in x and re.search(r"[\[ ]text#\d+[,\]]", x)]


def test_text_length_is_made_before_the_join(spark, tmp_path):
    _docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    _events(spark).write.parquet(str(tmp_path / "events.parquet"))
    posts = A.doc_posts(spark, str(tmp_path))
    assert [r.text_length for r in posts.orderBy("seq").collect()] == [len(r.text) for r in posts.orderBy("seq").collect()]
    narrow = posts.select("text_length", "engagement")
    assert not _moved(narrow) and "Join" in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert ST.spearman_stat(posts).first().n == 60


def test_merge_by_keys_equals_merge_by_texts(spark, tmp_path):
    _docs(spark).write.parquet(str(tmp_path / "d"))
    docs, events = spark.read.parquet(str(tmp_path / "d")), _events(spark)
    keyed = A.docs_to_posts(MG.with_keys(docs), events, 60, MG.KEYS).withColumn("lang", F.lit("en"))
    plain = keyed.drop(*MG.KEYS)
    out = ["platform", "seq", "date", "text_length"]
    for old in (None, "2024-01-16"):
        a = MG.merge_posts(keyed, existing=old and keyed.where(F.col("date") < old)).select(*out)
        b = MG.merge_posts(plain, existing=old and plain.where(F.col("date") < old)).select(*out)
        assert sorted(a.collect()) == sorted(b.collect())
        assert not _moved(a) and _moved(b)
    assert MG.merge_stats(MG.language_flags(keyed)).collect() == MG.merge_stats(MG.language_flags(plain)).collect()


def _peak(run, batch):
    tracemalloc.start()
    out = [b for b in run(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_training_holds_few_windows():
    texts = [f" {'abc' * 600} {i % 3} " for i in range(4000)]
    out, mb = _peak(LI._count_by_class, pa.RecordBatch.from_arrays([pa.array(["a", "b"] * 2000), pa.array(texts)], names=["lang", "t"]))
    got = Counter()
    for b in out:
        for r in b.to_pylist():
            got[r["lang"], r["gram"]] += r["count"]
    want = Counter()
    for i, t in enumerate(texts[:6]):
        want.update({("ab"[i % 2], t[j:j + 3]): 0 for j in range(len(t) - 2)})
    assert set(got) == set(want) and sum(got.values()) == sum(len(t) - 2 for t in texts)
    assert got["a", "abc"] == 2000 * 600
    assert mb < 80


def test_training_flushes_wide_vocabularies(monkeypatch):
    monkeypatch.setattr(LI, "COUNT_CODES", 50)
    texts = ["".join(chr(97 + (i * j) % 26) for j in range(40)) for i in range(30)] + ["", "ab", "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], names=["lang", "t"])
    got, want = Counter(), Counter()
    for b in LI._count_by_class(iter([batch, batch])):
        for r in b.to_pylist():
            got[r["gram"]] += r["count"]
    for t in texts * 2:
        want.update(t[j:j + 3] for j in range(len(t) - 2))
    assert got == want


def test_keyword_matcher_holds_few_texts():
    texts = ["the " + "x" * 10_000] * 2000
    run = PH._matcher("few", SimpleNamespace(value=["the"]))
    out, mb = _peak(run, pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(2000))], names=["_text", "n"]))
    assert sum(b.num_rows for b in out) == 2000 and mb < 8


def test_feed_lookups_read_objects_once(spark):
    objs = [{"a": "7", "A": 3, "b": {"c": 2.5, "d": None, "x.y": 1}, "x.y": 4}, {"a": {"c": 1}, "b": "s"}, [1], "t", None,
            {"a": -1, "b": {"c": "9" * 30}}]
    df = FD.parse_items(spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objs)], "seq long, raw string"))
    keys, look, v = ["a", "A", "b", "b.c", "b.d", "a.c", "x.y", "q.r"], FD.Lookups(), F.col("v")
    asked = [(k, t) for k in keys for t in ("bigint", "string", "double")]
    new = [FD.vget(look, k, t, ["x.y"]).alias(f"{k} {t}") for k, t in asked]
    got = df.select("seq", *look.read(v)).select("seq", *new).orderBy("seq").collect()
    assert got == df.select("seq", *[FD.vget(v, k, t, ["x.y"]).alias(f"{k} {t}") for k, t in asked]).orderBy("seq").collect()
    plan = FD.normalize_feed(df, "linkedin", as_of="2024-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") < 40
