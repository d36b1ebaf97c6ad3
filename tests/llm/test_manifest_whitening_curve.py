"""Merkle manifest, whitening and curve packing against brute force on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import curve_packing, merkle, tokens, whitening
from feedlens.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, leaf string"
VECTORS = "vec_id long, embedding array<float>, label int, Embedding string, component int"


def _frame(spark, rows, schema):
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(rows, schema)
    df.count()
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


def _documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcDEFß") for _ in range(rng.randint(1, 6)))
    rows = []
    for source, n in (("a", 1), ("b", 16), ("B", 17), (None, 40), ("é", 257), ("hot", 700), ("", 2)):
        for _ in range(n):
            i = len(rows)
            text = rng.choice([None, "", "same Text", "no capitals", " ".join(word() for _ in range(rng.randint(1, 30)))])
            rows.append((i * 7 % 1033, text, rng.choice(["en", None, ""]), source, rng.choice([None, i]), "clash", "x"))
    rows += [rows[5], rows[5], (None, "Null Id", "en", "hot", 1, None, None), (None, None, None, None, None, None, None),
             (5, "W" + "ord long " * 30_000, "en", "é", 7, None, None)]
    rng.shuffle(rows)
    return rows


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _steps(levels, at):
    for level in levels[:-1]:
        run = at // 16 * 16
        yield "".join(level[run:at]), "".join(level[at + 1:run + 16])
        at //= 16


def _audit(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1])))
        trees[s] = _levels([_leaf(r, r[1]) for r in by[s]])
    top = _levels([trees[s][-1][0] for s in names])
    lower = {ord(a): a.lower() for a in merkle.UPPER}
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            steps = [*_steps(trees[s], at), *_steps(top, k)]
            bad = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            d = _leaf(r, r[1].translate(lower)) if bad else trees[s][0][at]
            for left, right in steps:
                d = _h(left, d, right)
            yield (r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], _h(*[a + b for a, b in steps]), d, d == top[-1][0])


def test_op11_merkle(spark):
    rows = _documents()
    got = merkle.audit(_frame(spark, rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = list(_audit(rows))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert 0 < sum(not w[-1] for w in want) < len(want) / 5


def test_op11_manifest(spark):
    rows = _documents()
    m = merkle.build(spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    sizes = Counter(r[3] for r in rows)
    assert {r.source: r.n for r in m.sources.collect()} == dict(sizes)
    assert m.blocks.count() == sum(-(-n // merkle.BLOCK) for n in sizes.values())
    one = spark.createDataFrame([(1, "T", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.audit(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == _h() and r.verified
    assert merkle.audit(one.limit(0)).collect() == []
    assert merkle.audit(one.select(F.lit(3).alias("doc_id"))).first().leaf == _h("1:3----")


def test_op11_three_rounds(spark):
    """More nodes than two rounds of blocks hold (65,536): a third round recurses."""
    n = merkle.BLOCK ** 2 + 300
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    leaves = [_h(f"{len(str(i))}:{i}", "1:s", "---") for i in range(n)]
    levels = _levels(leaves)
    m = merkle.build(df)
    assert m.sources.first().root == levels[-1][0]
    some = {r.doc_id: r for r in merkle.proofs(m).where("doc_id % 9973 = 0 or doc_id > 65790").collect()}
    for i, r in some.items():
        assert r.leaf == leaves[i] and [tuple(s) for s in r.path] == list(_steps(levels, i))


def _whiten(x, k):
    n, s = len(x), x.sum(0)
    dev = (n * x.astype(object) - s.astype(object))
    a = dev.astype(float) / n
    _, sv, w = np.linalg.svd(a, full_matrices=False)
    return [int(v) for v in (dev * dev).sum(1)], a @ w[:k].T / sv[:k] * np.sqrt(n), sv[:k] ** 2 / (sv ** 2).sum()


def test_op12_whitening(spark):
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) + 5) @ rng.standard_normal((12, 12))
    wide = rng.standard_normal((40, 3)).astype(np.float32) * 1e4
    rows = [(i, [float(np.float32(c)) for c in v], 1, "clash", 9) for i, v in enumerate(base)]
    rows += [(1000 + i, [float(c) for c in v], None, None, None) for i, v in enumerate(wide)]
    rows += [(2000, None, 1, "", 1), (2001, [], 1, "", 1), (2002, [1.0] * 11 + [None], 1, "", 1),
             (2003, [float("nan")] * 12, 1, "", 1), (2004, [float("inf")] + [0.0] * 11, 1, "", 1), (2005, [3e38] * 12, 1, "", 1),
             (None, [0.5] * 12, 1, "", 1), (7, rows[7][1], 1, "", 1), (7, rows[7][1], 1, "", 1)]
    got = whitening.whiten(_frame(spark, rows, VECTORS))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    for d, k in ((12, 8), (3, 3)):
        kept = [r for r in rows if r[1] and len(r[1]) == d and r[0] not in (2002, 2003, 2004, 2005)]
        x = np.floor(1024 * np.array([np.float32(r[1]) for r in kept], float)).astype(np.int64) + 100_000
        dev, white, share = _whiten(x, k)
        out = [r for r in got if r.n == len(kept)]
        assert Counter((r.vec_id, r.component, r.deviation) for r in out) == Counter(
            (r[0], c, v) for r, v in zip(kept, dev) for c in range(1, k + 1))
        for c in range(k):
            mine = sorted((-1 if r.vec_id is None else r.vec_id, r.whitened) for r in out if r.component == c + 1)
            want = sorted((-1 if r[0] is None else r[0], v) for r, v in zip(kept, white[:, c]))
            a, b = np.array([v for _, v in mine]), np.array([v for _, v in want])
            assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
            assert all(abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-10 for r in out if r.component == c + 1)
    assert len(got) == 303 * 8 + 40 * 3


def test_op12_nearly_dependent_columns(spark):
    """Columns that differ by one unit in few rows, constant columns, one row, one value."""
    rng = np.random.default_rng(6)
    a = rng.integers(-2000, 2000, (500, 4)).astype(float)
    x = np.column_stack([a, a[:, 0] + a[:, 1], a[:, 2] + (np.arange(500) % 250 == 0), np.full(500, 7.0), 100 * a[:, 3]]) / 1024
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, 2.0]), (901, [3.0] * 3), (902, [3.0] * 3)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    dev, white, share = _whiten(np.floor(1024 * x).astype(np.int64) + 100_000, 5)
    for c in range(5):
        mine = np.array([r.whitened for r in sorted(got) if r.vec_id < 500 and r.component == c + 1])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-6
    last = [r for r in got if r.vec_id < 500 and r.component > 6]
    assert all(r.whitened is None and r.explained == 0 and r.identity_error < 1e-8 for r in last) and len(last) == 1000
    flat = [r for r in got if r.vec_id >= 900]
    assert len(flat) == 2 + 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in flat)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert whitening.whiten(empty).collect() == [] and whitening.fit(empty.select("embedding")) == {}


def test_op12_sums_beyond_a_long(spark):
    v = [4e15, -4e15, 1.0]
    rows = [(0, v), (1, [-c for c in v]), (2, [0.0, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in got if r.vec_id < 2) and len(got) == 9
    x = [[int(np.floor(1024 * c)) + 100_000 for c in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x)]
    assert {r.deviation for r in got if r.vec_id == 2} == {sum((3 * a - b) ** 2 for a, b in zip(x[2], s))}


def _texts():
    rng = random.Random(9)
    topic = lambda k, n: " ".join(rng.choice([f"topic{k}word{j}" for j in range(30)]) for _ in range(n))
    rows = [(i, topic(i % 3, rng.randint(1, 60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "é€😀 <|endoftext|>"), (204, topic(1, 40_000)), (None, "no id"), rows[4], rows[4], (300, rows[4][1])]
    return [(i, t, "en", "s", 1, "clash", "x") for i, t in rows]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_op13_curve_packing(spark, capacity):
    rows = _texts()
    path = vocabulary("word_bpe_49k.json")
    tok = tokens.encoder(path).tok
    want = Counter()
    for r in rows:
        want[(r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]))] += 1
    got = curve_packing.pack(_frame(spark, rows, SCHEMA), path, capacity).collect()
    parts, bins = {}, {}
    size = {}
    for (i, ids), n in want.items():
        size.setdefault(i, []).append(len(ids))
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and r.doc_tokens in size[r.doc_id]
        parts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids)))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    back = Counter()
    for (i, n), p in parts.items():
        times = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        ids = [None] * n
        seen = Counter()
        for start, part in p:
            for k, v in enumerate(part):
                seen[start + k] += 1
                assert ids[start + k] in (None, v)
                ids[start + k] = v
        assert all(seen[k] == times for k in range(n))
        back[(i, tuple(ids))] += times
    assert back == want
    short = 0
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
        short += at < capacity
    assert short <= capacity.bit_length()


def test_op13_neighbours_share_sequences(spark):
    """Documents of one topic lie together: far fewer topics a sequence than in id order."""
    rng = random.Random(12)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for _ in range(3)]
    rows = [(i, f"t{i % 3}", " ".join(rng.choice(words[i % 3]) for _ in range(rng.randint(20, 80)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    path = vocabulary("word_bpe_49k.json")
    got = curve_packing.along_curve(df, path).select("doc_id", "before").collect()
    order = [r.doc_id % 3 for r in sorted(got, key=lambda r: r.before)]
    changes = sum(a != b for a, b in zip(order, order[1:]))
    assert changes < 40                     # 119 in id order, about 79 at random
    assert curve_packing.pack(df.limit(0), path).collect() == []


def test_op13_cut_points():
    for total in (0, 1, 5, 64, 65, 200, 255):
        at, seqs = 0, Counter()
        for n in (3, 50, 1, 70, 40, 91):
            n = min(n, total - at)
            for seq, offset, part in curve_packing.cut_points(at, n, total, 64):
                assert seqs[seq] == offset
                seqs[seq] += part
            at += n
        assert sum(seqs.values()) == total and all(v & (v - 1) == 0 for v in seqs.values())
        assert len(seqs) == total // 64 + bin(total % 64).count("1")
