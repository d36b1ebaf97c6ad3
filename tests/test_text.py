"""Text operators against brute-force Python on small fixtures."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from feedlens import schema
from feedlens.functions import text as TX
from feedlens.operators import text as TXT

TEXTS = [
    "The GPT-4 model vs Claude: better than expected, saves hours!",
    "Coding with the API is faster; developers switched from chatgpt to it.",
    "Ça coûte cher — café crème, naïve résumé; trust but verify.",
    "time time TIME saved; Time-saving ROI, cost_center, code2 review",
    "Nothing relevant here at all, just words words words and more words.",
    "Left my old tool for this one. Moved from a rival, compared to others it is safe.",
] * 3


def py_tokens(t):
    t = re.sub(r"\s+", " ", str(t).strip().lower())
    return [w for w in re.findall(r"\b[a-zA-Z]{3,}\b", t) if w not in set(schema.STOPWORDS)]


def _df(spark):
    return spark.createDataFrame([(i, t, 10 * (i + 1), f"2024-01-{1 + i:02d}") for i, t in enumerate(TEXTS)],
                                 "seq long, text string, engagement long, date string") \
        .withColumn("parsed_date", F.to_timestamp("date")).withColumn("platform", F.lit("p"))


def test_tokens_match_python(spark):
    got = [r[0] for r in _df(spark).orderBy("seq").select(TX.tokens("text", schema.STOPWORDS)).collect()]
    assert got == [py_tokens(t) for t in TEXTS]


def test_keyword_hits_match_python(spark):
    kws = ["gpt", "api", "time", "code", "trust", "saved", "review", "switched"]
    got = [sorted(r[0]) for r in _df(spark).orderBy("seq").select(TX.keyword_hits("text", kws)).collect()]
    exp = [sorted(k for k in kws if re.search(rf"\b{re.escape(k)}\b", t, re.I)) for t in TEXTS]
    assert got == exp


def test_narrative_patterns_match_python(spark):
    got = [sorted(r[0]) for r in _df(spark).orderBy("seq").select(TX.pattern_hits("text", schema.NARRATIVE_BUCKETS)).collect()]
    exp = [sorted(b for b, p in schema.NARRATIVE_BUCKETS.items() if re.search(p, t, re.I)) for t in TEXTS]
    assert got == exp


def test_word_frequency(spark):
    got = [(r.word, r["count"]) for r in TXT.word_frequency(_df(spark), n=5).collect()]
    c = Counter(w for t in TEXTS for w in py_tokens(t))
    exp = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert got == exp


def test_tfidf_against_formula(spark):
    docs = [t for t in TEXTS if len(t) >= 20]
    n = len(docs)
    toks = [py_tokens(t) for t in docs]
    df = Counter(w for ts in toks for w in set(ts))
    cf = Counter(w for ts in toks for w in ts)
    vocab = [w for w in sorted(cf, key=lambda w: (-cf[w], w)) if 3 <= df[w] <= 0.8 * n][:200]
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocab}
    score = Counter()
    for ts in toks:
        tf = Counter(w for w in ts if w in idf)
        vec = {w: c * idf[w] for w, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in vec.values()))
        for w, v in vec.items():
            score[w] += v / norm / n
    exp = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:50]
    got = [(r.term, r.tfidf_score) for r in TXT.tfidf_top_terms(_df(spark), digits=9).collect()]
    assert [g[0] for g in got] == [e[0] for e in exp]
    assert all(abs(a[1] - b[1]) < 1e-8 for a, b in zip(got, exp))


def test_emerging_terms_against_python(spark):
    d = _df(spark)
    rows = sorted(((r.parsed_date, r.seq, r.text) for r in d.collect()))
    cut = len(rows) // 2
    old = Counter(w for _, _, t in rows[:cut] for w in py_tokens(t))
    new = Counter(w for _, _, t in rows[cut:] for w in py_tokens(t))
    ot, nt = max(sum(old.values()), 1), max(sum(new.values()), 1)
    exp = []
    for w, c in sorted(new.items(), key=lambda x: (-x[1], x[0]))[:500]:
        orate, nrate = old.get(w, 0) / ot, c / nt
        if c >= 5 and (orate == 0 or nrate / orate >= 1.5):
            exp.append((w, old.get(w, 0), c))
    got = [(r.term, r.old_count, r.new_count) for r in TXT.emerging_terms(d, min_rows=10).collect()]
    assert sorted(got) == sorted(exp)


def test_keyword_analysis_zero_hits_kept(spark):
    out = {r.keyword: r for r in TXT.keyword_analysis(_df(spark), ["gpt", "zzzz"]).collect()}
    assert out["zzzz"].rows == 0 and out["zzzz"].avg_engagement == 0.0
    assert out["gpt"].rows == 3


def test_phrase_and_punctuated_keywords(spark):
    """Phrases and punctuated keywords match as Python's word boundaries do, from a list and from a table."""
    texts = ["Time saved by GPT-4!", "overtime saved", "time  saved", "c++ code, a.b", "xc++y c++", "a!b", "!", "", None, "gpt-45"]
    kws = ["time saved", "gpt-4", "c++", "a.b", "!", "code", "gpt"]
    want = sorted((i, k) for i, t in enumerate(texts) for k in kws
                  if t and re.search(rf"\b{re.escape(k)}\b", t, re.I))
    posts = spark.createDataFrame(list(enumerate(texts)), "engagement int, text string")
    table = spark.createDataFrame([(k,) for k in kws + ["GPT"]], "keyword string")
    for given in (kws, table):
        got = sorted((r.engagement, r.keyword) for r in TXT.tag_keywords(posts, given).collect())
        assert got == want


def test_ten_thousand_phrases_in_one_pass(spark):
    """A large table equals the patterns, phrase by phrase; also in blocks, where the table exceeds one automaton."""
    import random

    from feedlens.operators import phrases
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "c++", "x-ray", "über", "a.b", "42", "_id", "ß"]
    kws = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(30_000)}
    assert len(kws) > 10_000
    kws |= {"+", "++", "-", " "}
    texts = [None, "", " "] + ["".join(rng.choice([" ", " ", " ", "-", ", ", "", ".", "_"]) + (w.upper() if rng.random() < 0.2 else w)
                               for w in rng.choices(words, k=rng.randint(1, 25))) for _ in range(40)]
    posts = spark.createDataFrame(list(enumerate(texts)), "engagement int, text string")
    table = spark.createDataFrame([(k,) for k in kws] + [(None,), ("",), ("ALPHA",)], "keyword string").repartition(4)
    boundary = lambda k: rf"\b{re.escape(k)}\b"
    want = sorted((i, k) for i, t in enumerate(texts) if t for k in kws if k in t.lower() and re.search(boundary(k), t.lower()))
    one = TXT.tag_keywords(posts, table)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, one.collect())) == want and len(want) > 100
    assert sorted(map(tuple, phrases.tag(posts, table, ["engagement"], block_chars=100_000).collect())) == want
    assert phrases.tag(posts, [], ["engagement"]).collect() == [] and TXT.tag_keywords(posts.limit(0), table).collect() == []
