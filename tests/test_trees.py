"""Comment trees in one pass: depth, order, odd nodes, storage in proportion to the input."""

import json
import random

import pytest
from pyspark.sql import functions as F

from feedlens.sources import feeds as FD
from feedlens.sources import trees as TR


def _node(i, kids=(), **data):
    replies = {"kind": "Listing", "data": {"children": list(kids)}} if kids else ""
    return {"kind": "t1", "data": {"id": f"c{i}", "body": f"body {i}", "score": i, "replies": replies, **data}}


def _chain(depth):
    text = ""
    for i in range(depth, 0, -1):
        replies = f'{{"kind": "Listing", "data": {{"children": [{text}]}}}}' if text else '""'
        text = f'{{"kind": "t1", "data": {{"id": "c{i}", "body": "body {i} \\"q\\" \\u00e9", "score": {i}, "replies": {replies}}}}}'
    return f'{{"kind": "Listing", "data": {{"children": [{text}, {{"kind": "more"}}]}}}}'


def _preorder(node, depth=0):
    if node["kind"] != "t1":
        return
    yield depth, node["data"]["id"]
    for k in (node["data"]["replies"] or {"data": {"children": []}})["data"]["children"]:
        yield from _preorder(k, depth + 1)


def _random(rng, budget):
    n = [0]

    def make(depth):
        n[0] += 1
        i = n[0]
        kids = []
        while n[0] < budget and rng.random() < 0.6 and depth < 12:
            kids.append({"kind": "more", "data": {"id": "m"}} if rng.random() < 0.1 else make(depth + 1))
        return _node(i, kids)
    return make(0)


def test_preorder_of_random_trees(spark):
    rng = random.Random(4)
    roots = [{"kind": "Listing", "data": {"children": [_random(rng, 60) for _ in range(3)]}} for _ in range(8)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(roots)], "seq long, raw string").withColumn(
        "parent_permalink", F.lit("/p"))
    got = {}
    for r in FD.flatten_comments(spark, df).orderBy("seq", "pos").collect():
        got.setdefault(r.seq, []).append((r.depth, r.url.split("=")[1]))
    assert got == {i: [x for k in r["data"]["children"] for x in _preorder(k)] for i, r in enumerate(roots)}


@pytest.mark.parametrize("depth", [500, 20_000])
def test_deep_chains_cost_their_comments_only(spark, depth, tmp_path):
    text = _chain(depth)
    df = spark.createDataFrame([(7, text, "/p")], "seq long, raw string, parent_permalink string")
    spark.sparkContext.setJobGroup(f"tree-{depth}", "no job while the query is built")
    got = FD.flatten_comments(spark, df)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"tree-{depth}")) == 0
    spark.sparkContext.setJobGroup("rest", "")
    path = str(tmp_path / "out")
    got.write.option("compression", "none").parquet(path)
    import os
    stored = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    assert stored < 2 * len(text) + 20_000
    back = spark.read.parquet(path)
    assert back.count() == depth and back.agg(F.max("depth"), F.max("pos"), F.sum("engagement")).first() == (
        depth - 1, depth - 1, depth * (depth + 1) // 2)
    assert back.where("text not like '%\"q\" é'").count() == 0


def test_odd_nodes(spark):
    odd = ['{"kind": "t1", "data": null}', '{"kind": "t1"}', "[1, 2]", '"t1"', "null", "{broken", None, "",
           '{"kind": "Listing", "data": {"children": {"a": 1}}}', '{"kind": "Listing", "data": {"children": [null, 5, "x", {"kind": "t1", '
           '"data": {"body": 12, "id": 3, "score": "41", "created_utc": "1700000000", "replies": []}}]}}',
           '{"kind": "t1", "data": {"body": {"no": 1}, "score": 1e30}}', '{"kind": "t1", "data": {"body": "&lt;b&gt;", "score": 2.9}}']
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)], "seq long, raw string, parent_permalink string")
    got = sorted((r.seq, r.text, r.likes, r.date, r.url) for r in FD.flatten_comments(spark, df).collect())
    assert got == [(9, "12", 41, "2023-11-14 22:13:20", ""), (11, "<b>", 2, "", "")]


def test_parser_of_any_depth_equals_the_standard_one():
    rng = random.Random(6)
    for _ in range(20):
        value = _random(rng, 40)
        value["x"] = [1, -2.5e3, True, False, None, "a\\\"]}[{,:\n é😀", {}, [], {"": []}]
        for indent in (None, 2):
            assert TR.parse_nested(json.dumps(value, indent=indent)) == value
    for bad in ("", "[", "]", "[1] 2", '{"a" 1', "nope"):
        with pytest.raises(ValueError):
            TR.parse_nested(bad)
    deep = "[" * 50_000 + "]" * 50_000
    assert TR.parse(deep) is not None and TR.parse(deep[:-1]) is None
