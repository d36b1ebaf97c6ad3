"""No caps, size switches or file-layout effects: deep trees, late rows, lexicon sizes, globs, scan order."""

import json

import pytest
from pyspark.sql import functions as F

from feedlens.operators import sentiment as SE
from feedlens.operators import stats as ST
from feedlens.operators import text as TX
from feedlens.sources import feeds as FD
from feedlens.sources import raw as R
from feedlens.streaming import incremental as ZS


def _tree(depth):
    node = ""
    for i in range(depth, 0, -1):
        replies = {"kind": "Listing", "data": {"children": [node]}} if node else ""
        node = {"kind": "t1", "data": {"id": f"c{i}", "body": f"body {i}", "score": i, "replies": replies}}
    return node


def test_deep_trees_and_comment_roots(spark):
    roots = [(1, json.dumps({"kind": "Listing", "data": {"children": [_tree(150), _tree(2)]}})), (2, json.dumps(_tree(3))),
             (3, json.dumps({"kind": "Listing", "data": {"children": []}})), (4, None)]
    trees = spark.createDataFrame(roots, "seq long, j string").select(
        "seq", F.try_parse_json("j").alias("v"), F.lit("/p").alias("parent_permalink"))
    got = FD.flatten_comments(spark, trees).groupBy("seq").count().collect()
    assert {r.seq: r["count"] for r in got} == {1: 152, 2: 3}


def test_html_references(spark):
    df = spark.createDataFrame([("caf&eacute; &#8217;s &hellip; &amp;lt; &#x27;a&#x27;",), (None,)], "t string")
    assert [r[0] for r in df.select(FD.html_unescape("t")).collect()] == ["café ’s … &lt; 'a'", None]


def test_one_lexicon_same_scores_at_any_size(spark):
    posts = spark.createDataFrame([(1, "This is a Good day, not bad at all"), (2, "GOOD good!"), (3, "plain text here")],
                                  "seq long, text string")
    small = [("Good", 2.0), ("bad", -2.0)]
    frames = [spark.createDataFrame(x, "token string, valence double")
              for x in (small, small + [(f"filler{i}", 1.0) for i in range(3000)])]
    scores = [sorted((r.seq, r.sentiment_score) for r in SE.lexicon_sentiment(posts, lex).collect())
              for lex in (*frames, dict(small))]
    assert scores[0] == scores[1] == scores[2] and scores[0][1][1] > 0
    twice = spark.createDataFrame([*small, ("GOOD", -3.0)], "token string, valence double")
    assert SE.lexicon_sentiment(posts, twice).where("seq = 2").first().sentiment_score < 0


def test_stream_of_files_in_any_order_equals_batch(spark, tmp_path):
    rows = [(f"2024-0{m}-{d:02d}", m * d) for m in (1, 2, 3) for d in range(1, 29)]
    src = str(tmp_path / "src")
    for k in (2, 0, 1):       # the latest days arrive first
        part = spark.createDataFrame(rows[k * 28:(k + 1) * 28], "d string, engagement long").select(
            F.to_timestamp("d").alias("ts"), "engagement")
        part.coalesce(1).write.mode("append").parquet(src)
    stream = (spark.readStream.schema("ts timestamp, engagement long").option("maxFilesPerTrigger", 1).parquet(src))
    out = str(tmp_path / "out")
    ZS.running_counts(stream, "ts", out, str(tmp_path / "ck")).awaitTermination()
    got = {r.period: (r.rows, r.total_engagement) for r in ZS.read_period_table(spark, out).collect()}
    assert got == {d: (1, e) for d, e in rows}


def test_globs_and_scan_order(spark, tmp_path):
    head = "platform,text,likes,comments,views,date,engagement,content_type,url\n"
    for name, n in (("a.csv", 2), ("b.csv", 3000)):
        (tmp_path / name).write_text(head + "".join(f"x,{name} {i},1,1,1,2024-01-01,2,post,u\n" for i in range(n)))
    df = R.load_platform(spark, "x", f"{tmp_path}/*.csv")
    texts = [r.text for r in df.orderBy("seq").collect()]
    assert len(texts) == 3002 and texts[:3] == ["a.csv 0", "a.csv 1", "b.csv 0"] and texts[-1] == "b.csv 2999"
    assert R.load_platform(spark, "x", f"{tmp_path}/none*.csv").count() == 0


def test_chi_square_without_a_grid(spark):
    cells = {("a", "x"): 12, ("a", "y"): 5, ("b", "x"): 7, ("b", "z"): 9, ("c", "y"): 4, ("c", "z"): 6}
    rows = [k for k, n in cells.items() for _ in range(n)]
    got = ST.chi2_stat(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    r = {k: sum(n for (a, _), n in cells.items() if a == k) for k in "abc"}
    c = {k: sum(n for (_, b), n in cells.items() if b == k) for k in "xyz"}
    total = sum(cells.values())
    want = sum((cells.get((a, b), 0) - r[a] * c[b] / total) ** 2 / (r[a] * c[b] / total) for a in r for b in c)
    assert abs(got.statistic - want) < 1e-9 and got.dof == 4 and got.n == total
    two = [("a", "x")] * 8 + [("a", "y")] * 3 + [("b", "x")] * 2
    got = ST.chi2_stat(spark.createDataFrame(two, "r string, c string"), "r", "c").first()
    e = {("a", "x"): 11 * 10 / 13, ("a", "y"): 11 * 3 / 13, ("b", "x"): 2 * 10 / 13, ("b", "y"): 2 * 3 / 13}
    d = abs(8 - e["a", "x"])
    assert abs(got.statistic - sum((d - min(0.5, d)) ** 2 / v for v in e.values())) < 1e-9 and got.dof == 1


def test_wide_table_never_loses_platforms(spark, monkeypatch):
    monkeypatch.setattr(TX, "small_values", lambda *a, **k: None)
    with pytest.raises(ValueError):
        TX.narrative_pivot(spark.createDataFrame([("n", "p", 1.0)], "narrative string, platform string, avg_engagement double"))
