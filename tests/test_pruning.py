"""What is read and moved: months of the dashboard's range, keep-first without texts, alerts of all kinds."""

import datetime as dt
import re

from pyspark.sql import functions as F

from feedlens import sinks as SK
from feedlens.operators import alerts as AL
from feedlens.operators import dashboard as DB
from feedlens.operators import merge as MG


def _posts(spark):
    rows = [(i, dt.datetime(2023, 1 + i % 12, 1 + i % 28, 23, 59) if i % 5 else None, i, f"p{i % 3}") for i in range(400)]
    return spark.createDataFrame(rows, "seq long, parsed_date timestamp, engagement long, platform string")


def test_date_filter_prunes_months(spark, tmp_path):
    path = str(tmp_path / "m")
    SK.write_posts_by_month(_posts(spark), path)
    posts = SK.read_posts_by_month(spark, path)
    for start, end in (("2023-03-05", "2023-05-10"), (None, "2023-02-01"), ("2023-12-28", None), (None, None)):
        got = DB.date_filter(posts, start, end)
        want = DB.date_filter(_posts(spark), start, end)
        assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())
    got = DB.date_filter(posts, "2023-03-05", "2023-05-10")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "2023-03" in re.search(r"PartitionFilters: \[[^\]]*\]", plan)[0] and "undated" in plan
    read = {f.split("post_month=")[1].split("/")[0] for f in got.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {"undated", "2023-03", "2023-04", "2023-05"}


def test_keep_first_moves_no_text(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.lit("p").alias("platform"), F.col("id").alias("seq"), F.concat(F.lit(" Some Text "), F.col("id") % 7).alias("text"),
                            F.col("id").alias("engagement")).write.parquet(path)
    got = MG.deduplicate(spark.read.parquet(path)).select("seq", "engagement")
    assert sorted(r.seq for r in got.collect()) == list(range(7))
    formatted = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) (?:Shuffle)?Exchange\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    assert moved and all("text#" not in cols for cols in moved)


def test_run_with_every_kind_of_alert(spark):
    rows = [("a", 10 + d % 3, "old words", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), d) for d in range(20)]
    rows += [("a", 10, "old words", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 50 + d) for d in range(0, 20, 2)]
    rows += [("a", 900 + i, "the new phrase", dt.datetime(2024, 1, 21), 100 + i) for i in range(12)]
    rows += [("a", 50_000, "the new phrase, viral", dt.datetime(2024, 1, 22), 999)]
    posts = spark.createDataFrame(rows, "platform string, engagement long, text string, parsed_date timestamp, seq long")
    got = AL.run_alerts(posts, ["new phrase", "words"]).collect()
    assert {r.type for r in got} == {"engagement_spike", "mention_spike", "keyword_new", "viral_post"}
    assert [r.alert_order for r in got] == list(range(1, len(got) + 1))
