"""Result blocks of the three page layouts: quoting, nesting, redirects, missing parts."""

from feedlens.sources import pages as PG
from feedlens.sources import results as RS

FIRST = """<html><body><div class="serp"><div class="result results_links web-result"><div><h2 class="result__title">
  <a rel="nofollow" class="result__a" href="//r.example/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1%2B2&amp;rut=9"> The <b>first</b> hit </a></h2>
  <a class='result__snippet' href="#">About <b>it</b> &amp; more</a></div></div>
<div class=result><h2 class=result__title><a href=https://b.example/>Second</a></h2></div>
<div class="result"><h2 class="result__title">No link</h2></div>
<div class="result"><h2 class="result__title"><a href="/relative">Relative</a></h2></div>
<div class="result"><h2 class="result__title"><a href="https://b.example/">Again</a></h2><p class="result__snippet">p</div>
<div class="results">not one</div></div>"""
SECOND = """<ol id=b_results><li class='b_algo'><h2><a href='https://c.example/'>C <strong>strong</strong></a></h2>
<div class='b_caption x'><div><p>Caption one<p>two</div></div><li class="b_algo b_vtl"><a>no link</a><a href="https://d.example/?q='1'">D</a>
<li class="b_algo"><a href="https://c.example/">same link</a></li><li class="b_ad"><a href="https://ad.example">ad</a></li></ol>
<div class="b_algo"><a href="https://no.example">not a list item</a></div>"""
THIRD = """<div class="g"><div><a href="/url?sa=t&q=https://e.example/p%3Fz&ved=1"><br><h3>E title</h3></a></div><script>var x = "<p>";</script>
<span>Text after <em>E</em></span></div><div class="g"><a href="https://f.example">no heading</a></div>
<div class="gg"><a href="https://x.example"><h3>x</h3></a></div>
<div class="g"><h3>Before</h3><a href="https://g.example">g</a><img src=a.png alt=">"> tail</div><div class="g"><h3>H</h3><a href="#">h</a></div>"""


def test_three_layouts():
    assert list(RS.hits(FIRST)) == [("result", 0, "https://a.example/x?y=1+2", "Thefirsthit", "Aboutit& more"),
                                    ("result", 1, "https://b.example/", "Second", ""),
                                    ("result", 2, "https://b.example/", "Again", "p")]
    assert list(RS.hits(SECOND)) == [("b_algo", 0, "https://c.example/", "Cstrong", "Caption one"),
                                     ("b_algo", 1, "https://d.example/?q='1'", "D", "")]
    assert list(RS.hits(THIRD)) == [("g", 0, "https://e.example/p?z", "E title", "Text after E"),
                                    ("g", 1, "https://g.example", "Before", "g tail")]


def test_odd_pages():
    for page in (None, "", "<", "<div class=g", "</div></div>", "<div class='g'>" * 3000, "a < b & c <!-- x"):
        assert list(RS.hits(page)) == []
    deep = "<div>" * 20_000 + "<li class=b_algo><a href=http://x>t</a>"
    assert list(RS.hits(deep)) == [("b_algo", 0, "http://x", "t", "")]


def test_blocks_into_the_fallback_chain(spark):
    pages = spark.createDataFrame([("q", FIRST + SECOND + THIRD), ("r", SECOND), (None, None)], "query string, html string")
    got = PG.result_blocks(pages, id_col="query").collect()
    assert len(got) == 9 and {r.query for r in got} == {"q", "r"}
    found = spark.createDataFrame([("q", 0, 0, "a"), ("q", 0, 1, "a"), ("q", 1, 0, "a"), ("q", 1, 1, "b"), ("q", 1, 2, "b"),
                                   ("q", 2, 0, "c"), ("w", 1, 0, "z"), ("w", 2, 0, "z"), ("w", 2, 1, "y")],
                                  "query string, priority int, pos int, link string")
    out = [tuple(r) for r in PG.fallback_results(found).orderBy("query", "rank").collect()]
    assert out == [("q", 0, 0, "a", 1), ("q", 0, 1, "a", 2), ("q", 1, 1, "b", 3), ("w", 1, 0, "z", 1), ("w", 2, 1, "y", 2)]
