"""Dedup / merge (U2, J7, A20, SRC1)."""

import os
import tempfile

from pyspark.sql import functions as F

from feedlens.operators import merge as MG
from feedlens.sources import raw as R


def test_deduplicate_reference_case(spark):
    df = spark.createDataFrame([("reddit", "Hello world", 0), ("youtube", "hello world", 1),
                                ("reddit", "Different text", 2)], "platform string, text string, seq long")
    out = MG.deduplicate(df).orderBy("seq").collect()
    assert [r.text for r in out] == ["Hello world", "Different text"]


def test_dedup_prefix_200_code_points(spark):
    base = "😀" * 200
    df = spark.createDataFrame([("reddit", base + "A", 0), ("twitter", base + "B", 1)],
                               "platform string, text string, seq long")
    assert MG.deduplicate(df).count() == 1


def test_first_platform_wins(spark):
    df = spark.createDataFrame([("twitter", "same text", 0), ("reddit", "Same text", 5)],
                               "platform string, text string, seq long")
    assert MG.deduplicate(df).first().platform == "reddit"


def test_dedup_partition_independent(spark):
    from tests.conftest import SF01
    from feedlens.sources.adapters import doc_posts
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(r.seq for r in MG.deduplicate(doc_posts(spark, SF01)).select("seq").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    b = sorted(r.seq for r in MG.deduplicate(doc_posts(spark, SF01)).select("seq").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b and len(a) == 910


def test_load_platform_csv_and_merge(spark):
    d = tempfile.mkdtemp(prefix="feedlens-csv-")
    p1 = os.path.join(d, "reddit.csv")
    with open(p1, "w", encoding="utf-8-sig") as f:
        f.write('platform,text,likes,comments,views,date,engagement,content_type,url\n')
        f.write('reddit,"Hello  world\nsecond line",1234,5,,3/5/2024,0,,https://x \n')
        f.write('reddit,"",1,1,1,2024-01-01,1,,\n')
        f.write('reddit,"hello  world\nsecond line",1,1,1,2024-01-01,9,,\n')
    p2 = os.path.join(d, "youtube.csv")
    with open(p2, "w", encoding="utf-8") as f:
        f.write('platform,text,likes,comments,views,date,engagement,content_type,url\n')
        f.write('youtube,"A video title",10,2,100,2024-03-15T10:30:00Z,abc,,\n')
    raw = R.collect_raw(spark, {"reddit": p1, "youtube": p2, "tiktok": os.path.join(d, "missing.csv")})
    cleaned = R.clean_raw(raw).withColumn("lang", F.lit("en"))
    merged, stats = MG.merge_posts(cleaned, with_stats=True)
    got = merged.orderBy("platform").collect()
    assert len(got) == 2
    r = got[0]
    assert (r.platform, r.text, r.likes, r.engagement, r.date, r.content_type, r.url) == \
        ("reddit", "Hello world\nsecond line", 1234, 1239, "2024-03-05", "post", "https://x")
    y = got[1]
    assert (y.engagement, y.date, y.content_type) == (12, "2024-03-15", "video")
    st = {s.platform: (s.loaded, s.deduped, s.skipped_lang) for s in stats.collect()}
    assert st["reddit"] == (2, 1, 0)


def test_append_existing_wins(spark):
    existing = spark.createDataFrame([("youtube", "Old text", 1, 0, 0, "", 5, "video", "", 8, 0)],
                                     "platform string, text string, likes long, comments long, views long, "
                                     "date string, engagement long, content_type string, url string, "
                                     "text_length int, seq long")
    incoming = spark.createDataFrame([("reddit", "old text", 9, 0, 0, "", 9, "post", "", 8, 0, "en"),
                                      ("reddit", "new text", 1, 0, 0, "", 1, "post", "", 8, 1, "en")],
                                     "platform string, text string, likes long, comments long, views long, "
                                     "date string, engagement long, content_type string, url string, "
                                     "text_length int, seq long, lang string")
    out = MG.merge_posts(incoming, existing=existing).collect()
    assert sorted((r.platform, r.text) for r in out) == [("reddit", "new text"), ("youtube", "Old text")]
