"""The pipeline's stages on a small corpus with nulls, repeated rows and planted cases."""

import random
from collections import Counter

import pytest

import corpus_pipeline as C
from feedlens.llm import mixing
from feedlens.llm.common import stored


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(200):
        w = _words(rng, 120).split(" ")
        toxic = i % 4 == 0
        for _ in range(5 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["grumblewort", "snarkfiend"])
        rows.append([i, " ".join(w), "en", f"s{i % 3}", 0])
        if i < 150:
            labels.append((i, 0, int(toxic)))
    passage = _words(rng, 90)
    rows[1][1] += " " + passage
    rows[2][1] = passage + " " + rows[2][1]
    rows[3][1] = rows[5][1] + " tail"
    rows += [[900, None, None, None, None], [901, "", "en", "s0", 0], rows[6], rows[6]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, passage


def test_stages(spark, folder):
    path, rows, passage = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, path), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == C.COLUMNS
    kept = Counter(r.doc_id for r in seen["toxicity"])
    toxic, clean = range(0, 200, 4), [i for i in range(200) if i % 4]
    assert sum(kept[i] > 0 for i in toxic) <= 5 and all(kept[i] for i in clean) and kept[900] and kept[901]
    kept = Counter(r.doc_id for r in seen["near_dedup"])
    assert kept[5] == 0 and kept[3] == 1 and kept[6] == 1 and all(kept[i] for i in clean if i != 5) and kept[900] and kept[901]
    text = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    assert len(text) == len(seen["near_dedup"]) and passage not in text[1] and passage not in text[2]
    assert text[7] == rows[7][1] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen["suffix_dedup"])
    assert 0 < len(seen["source_mix"]) <= 3 * len(text) and {r.doc_id for r in seen["source_mix"]} <= set(text)
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["source_mix"]}
    assert len(C.run(spark, path).collect()) == len(seen["packing"])


def test_mix_keeps_every_source(spark):
    """A source of one long document, cut by its target, keeps the words it is due."""
    text = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    rows = [(1, text("a", 9000) + " tail\t\n", "en", "a", 1)] + [(10 + i, f" {text('b', 300)}", "en", "b", 1) for i in range(10)]
    rows += [(100 + i, text("c", 300), "en", "c", 1) for i in range(20)] + [(100, text("c", 300), "en", "c", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = C.mix_sources(spark, docs, "").collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    took = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert set(words) == {"a", "b", "c"} and all(abs(words[s] - t) <= 1 for s, t in took.items())
    a = [r for r in out if r.source == "a"]
    assert len(a) == 1 and rows[0][1].startswith(a[0].text) and a[0].n_chars == len(a[0].text) < len(rows[0][1])


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.collect() == []
