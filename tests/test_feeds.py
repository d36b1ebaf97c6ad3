"""Collector feeds, listings and comment trees (N*, X6, U3-U6)."""

import json

from pyspark.sql import functions as F

from feedlens.sources import feeds as FD


def _items(spark, objs):
    return FD.parse_items(spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objs)], "seq long, raw string"))


def test_first_positive_int_and_stats_fallback(spark):
    df = _items(spark, [{"desc": "a video text", "diggCount": 0, "likes": "7", "stats": {"commentCount": 3},
                         "createTime": 1700000000123, "webVideoUrl": "https://t/v"}])
    r = FD.normalize_feed(df, "tiktok", as_of="2024-01-01").first()
    assert (r.likes, r.comments, r.date, r.url, r.content_type) == (7, 3, "2023-11-14", "https://t/v", "video")


def test_twitter_nested_and_date_format(spark):
    df = _items(spark, [{"tweet": {"full_text": "nested tweet text\nsecond", "favorite_count": 2,
                                   "created_at": "Mon Jan 01 10:00:00 +0000 2024", "id_str": "5"},
                         "username": "ann", "bookmarks": 1},
                        {"text": "too short"}])
    rows = FD.normalize_feed(df, "twitter", as_of="2024-06-01").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.text, r.likes, r.engagement, r.date, r.url) == \
        ("nested tweet text second", 2, 3, "2024-01-01", "https://x.com/ann/status/5")


def test_instagram_types_and_literal_keys(spark):
    df = _items(spark, [{"caption": "a reel caption", "isVideo": True, "edge_media_to_comment.count": 4},
                        {"caption": "album caption", "type": "Sidecar", "edge_media_preview_like": {"count": 9}}])
    rows = {r.text: r for r in FD.normalize_feed(df, "instagram", as_of="2024-01-01").collect()}
    assert rows["a reel caption"].content_type == "reel" and rows["a reel caption"].comments == 4
    assert rows["album caption"].content_type == "carousel_album" and rows["album caption"].likes == 0


def test_linkedin_paths_and_article(spark):
    df = _items(spark, [{"commentary": {"text": "  professional update text  "},
                         "socialDetail": {"totalSocialActivityCounts": {"numLikes": 12, "numShares": 2}},
                         "postedTimestamp": 1700000000, "articleUrl": "https://a"}])
    r = FD.normalize_feed(df, "linkedin", as_of="2024-01-01").first()
    assert (r.text, r.likes, r.engagement, r.date, r.content_type) == \
        ("professional update text", 12, 14, "2023-11-14", "article")


def test_listing_posts(spark):
    listing = {"kind": "Listing", "data": {"children": [
        {"kind": "t3", "data": {"id": "a", "title": "Claude &amp; me", "selftext": "[removed]", "score": 5,
                                "num_comments": 2, "created_utc": 1700000000, "permalink": "/r/x/a"}},
        {"kind": "t3", "data": {"id": "b", "title": "[deleted]", "selftext": "x", "score": 1}},
        {"kind": "t3", "data": {"id": "a", "title": "Claude again", "score": 9}},
        {"kind": "t3", "data": {"id": "c", "title": "Unrelated", "selftext": "nothing", "score": 1}}]}}
    df = FD.parse_items(spark.createDataFrame([(0, json.dumps(listing))], "seq long, raw string"))
    rows = FD.listing_posts(df, FD.LISTING_TERMS).collect()
    assert [(r.text, r.engagement, r.url, r.date) for r in rows] == \
        [("Claude & me", 7, "https://reddit.com/r/x/a", "2023-11-14 22:13:20")]


def test_comment_tree_three_levels(spark):
    leaf = {"kind": "t1", "data": {"id": "c3", "body": "deep reply", "score": 1, "replies": ""}}
    mid = {"kind": "t1", "data": {"id": "c2", "body": "[removed]", "score": 2,
                                  "replies": {"kind": "Listing", "data": {"children": [leaf]}}}}
    top = {"kind": "t1", "data": {"id": "c1", "body": "top &lt;3", "score": 3, "permalink": "/r/x/a/c1",
                                  "replies": {"kind": "Listing", "data": {"children": [mid]}}}}
    empty = {"kind": "t1", "data": {"id": "c4", "body": "  ", "score": 4}}
    tree = {"kind": "Listing", "data": {"children": [top, empty]}}
    df = FD.parse_items(spark.createDataFrame([(0, json.dumps(tree))], "seq long, raw string")) \
        .withColumn("parent_permalink", F.lit("/r/x/a"))
    rows = sorted((r.text, r.engagement, r.url) for r in FD.flatten_comments(spark, df).collect())
    assert rows == [("deep reply", 1, "https://reddit.com/r/x/a?comment=c3"),
                    ("top <3", 3, "https://reddit.com/r/x/a/c1?comment=c1")]


def test_source_dedup_and_cap(spark):
    df = spark.createDataFrame([("t", "Same Text", 0, 5), ("t", "same text", 1, 9), ("t", "Other", 2, 1)],
                               "platform string, text string, seq long, engagement long")
    assert FD.dedup_source(df, "lower_text").count() == 2
    assert FD.dedup_source(df, "prefix80").count() == 3
    capped = FD.cap_per_source(df, 2, [F.desc("engagement")]).collect()
    assert sorted(r.seq for r in capped) == [0, 1]
