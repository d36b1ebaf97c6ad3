"""Page extraction."""

from pyspark.sql import functions as F

from feedlens.sources import pages as PG

VIDEO = ('<html><head><title>Ignored - YouTube</title></head><script>var ytInitialPlayerResponse = '
         '{"videoDetails":{"title":"My video","shortDescription":"About it","viewCount":"1234"}};</script>'
         '<script>var ytInitialData = {"x":{"label":"1,024 likes"},"commentCount":{"simpleText":"56"},'
         '"videoId":"abcdefghijk","y":{"videoId":"abcdefghijk"},"z":{"videoId":"ABCDEFGHIJK"}};</script>'
         '"publishDate":"2024-03-05"</html>')
TITLE_ONLY = "<html><title>Only a title - YouTube </title></html>"
NO_TITLE = "<html><body>nothing</body></html>"


def test_page_metrics(spark):
    df = spark.createDataFrame([(1, VIDEO), (2, TITLE_ONLY), (3, NO_TITLE)], "page_id long, html string")
    got = {r.page_id: r for r in PG.page_metrics(df).collect()}
    assert set(got) == {1, 2}
    v = got[1]
    assert (v.title, v.description, v.views, v.likes, v.comments, v.published) == \
        ("My video", "About it", 1234, 1024, 56, "2024-03-05")
    assert got[2].title == "Only a title"
    ids = df.where("page_id = 1").select(PG.blob_video_ids("html")).first()[0]
    assert ids == ["abcdefghijk", "ABCDEFGHIJK"]


def test_video_id(spark):
    urls = ["https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "https://youtu.be/dQw4w9WgXcQ",
            "https://www.youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ", "https://example.com"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(PG.video_id("u")).collect()] == ["dQw4w9WgXcQ"] * 4 + [None]


def test_result_links_and_redirects(spark):
    html = ('<div class="result"><a class="x" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2Fp%3Fq%3D1%2B2&amp;rut=z">'
            'A <b>title</b></a></div><a href="/url?q=https://b.com/x&sa=U">B</a>'
            '<a href="https://a.com/p?q=1+2">dup</a><a href="/relative">rel</a><a href="mailto:x@y">m</a>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r.link, r.title) for r in PG.result_links(df).orderBy("pos").collect()]
    assert got == [("https://a.com/p?q=1+2", "A title"), ("https://b.com/x", "B")]


def test_fallback_results(spark):
    rows = [("q1", 0, 0, "l1"), ("q1", 1, 0, "l1"), ("q1", 1, 1, "l2"), ("q1", 2, 0, "l3"),
            ("q2", 0, 0, "a"), ("q2", 0, 1, "b"), ("q2", 0, 2, "c"), ("q2", 1, 0, "d")]
    df = spark.createDataFrame(rows, "query string, priority int, pos int, link string")
    got = {(r.query, r.link) for r in PG.fallback_results(df).collect()}
    assert got == {("q1", "l1"), ("q1", "l2"), ("q1", "l3"), ("q2", "a"), ("q2", "b"), ("q2", "c")}


def test_clean_long_text_and_dates(spark):
    raw = ("Check https://x.y/z and www.site.com mail a@b.co #AI 😀 at 12:34 ---- Subscribe now\nline "
           + "word " * 120)
    df = spark.createDataFrame([(raw,)], "t string")
    out = df.select(PG.clean_long_text("t")).first()[0]
    assert out.startswith("Check and mail AI at now line word")
    assert out.endswith("...") and len(out) <= 503
    d = spark.createDataFrame([("2024-03-15T10:30:00Z",), ("2024-03-15",), ("Mar 5, 2024",), ("junk",),
                               ("",), ("20240315XYZ",)], "d string")
    assert [r[0] for r in d.select(PG.format_date("d")).collect()] == \
        ["2024-03-15", "2024-03-15", "2024-03-05", "", "", "20240315XY"]
    c = spark.createDataFrame([("1.2K",), ("3M",), ("1,234",), ("none",)], "c string")
    assert [r[0] for r in c.select(PG.parse_count("c")).collect()] == [1200, 3000000, 1234, 0]


def test_video_rows(spark):
    df = spark.createDataFrame([(1, VIDEO), (2, "<title>short</title>")], "page_id long, html string")
    rows = PG.video_rows(PG.page_metrics(df)).collect()
    assert len(rows) == 1 and rows[0].text == "My video. About it" and rows[0].engagement == 1080
