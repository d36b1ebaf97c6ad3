"""Corpus operators against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import (fingerprints, hilbert, huffman, itq, licenses, minhash_bbit, mixing, packing,
                          suffix_dedup, tokens, toxicity, words)
from feedlens.llm.common import components, numbered
from feedlens.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _text(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = [_text(rng, n) for n in (300, 60, 7, 2, 1, 400, 90)]
    passage = _text(rng, 80)
    near = base[0].split(" ")
    near[150] = "changed"
    far = base[0].split(" ")
    for i in range(0, 300, 30):
        far[i] = "edited"
    texts = [*base, None, "", " \t\n", base[0], " ".join(near), " ".join(far), base[0].upper(), base[1] + " tail",
             _text(rng, 40) + passage, passage + _text(rng, 30), _text(rng, 30) + "\n" + passage + "é", "Ünïcode €😀 " * 40,
             "x" * 700, _text(rng, 9000), "Licensed under the Apache License, Version 2.0. More."]
    rows = [(i, t, None if i == 4 else "en", [None, "a", "b", "ß"][i % 4], None, "clash", 9) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], rows[7]]     # repeated rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.count()
    spark.conf.set("spark.sql.caseSensitive", "false")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def _sets(texts, k):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def _groups(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_op1_removes_every_repeated_string(docs, empty):
    for length in (200, 64):
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                      for r in suffix_dedup.remove_repeats(docs, length).collect())
        raws = [(r[0], (r[1] or "").encode()) for r in ROWS]
        seen = Counter(b[j:j + length] for _, b in raws for j in range(len(b) - length + 1))
        want = Counter()
        for i, b in raws:
            mark = bytearray(len(b))
            for j in range(len(b) - length + 1):
                if seen[b[j:j + length]] > 1:
                    mark[j:j + length] = b"\1" * length
            left = bytes(c for c, m in zip(b, mark) if not m)
            spans = len(re.findall(b"\1+", bytes(mark)))
            want[(i, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest())] += 1
        assert got == want
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_op1_backward_extension_equals_counting():
    rng = np.random.default_rng(3)
    for symbols, length in ((1, 200), (2, 40), (26, 200)):
        a = rng.integers(97, 97 + symbols, 1500).astype(np.uint8)
        t = np.concatenate([a, [255], a[100:700], [255], a[::-1], a[5:300]]).astype(np.uint8)
        n = len(t) - length + 1
        seen = Counter(t[i:i + length].tobytes() for i in range(n))
        assert [seen[t[i:i + length].tobytes()] > 1 for i in range(n)] == suffix_dedup.repeated(t, length)[:n].tolist()


def test_op1_hot_anchor_is_dealt_again(spark, monkeypatch):
    """A line in very many contexts, some of them repeated further: equal to brute force at every depth, and the
    blocks hold only what is left of the line's group."""
    rng = random.Random(12)
    line = _text(rng, 20)[:60]
    tails = [_text(rng, 60) for _ in range(6)]
    texts = [_text(rng, 45) + line + (tails[i % 6][:rng.randint(20, 200)] if i % 5 == 0 else "") + _text(rng, 45)
             for i in range(150)]
    texts += [texts[3][30:] + "x", texts[3], "é" + texts[7], "ab" * 400, "ba" * 390]
    n, seen = 200, Counter()
    raws = [t.encode() for t in texts]
    for r in raws:
        seen.update(r[i:i + n] for i in range(len(r) - n + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, r in enumerate(raws):
        gone = set()
        for j in range(len(r) - n + 1):
            if seen[r[j:j + n]] > 1:
                gone.update(range(j, j + n))
        want[i] = hashlib.sha256(bytes(b for j, b in enumerate(r) if j not in gone)).hexdigest()
    for limit in (1 << 20, 5000, 0):
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
        assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(df).collect()} == want


def test_op1_hot_anchors_read_no_document_again(spark, monkeypatch):
    """Texts are read for the anchors and for the blocks; hot anchors, at any depth, take theirs from there."""
    rng = random.Random(4)
    line = _text(rng, 20)[:60]
    rows = [(i, _text(rng, 45) + line + _text(rng, 45)) for i in range(100)]
    for limit in (1 << 20, 5000, 0):
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
        read = spark.sparkContext.accumulator(0)

        def seen(row, read=read):
            read.add(1)
            return row

        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), "doc_id long, text string")
        d = df.withColumn("tkey", F.xxhash64("text"))
        suffix_dedup.repeated_ranges(d).collect()
        assert read.value == 2 * len(rows)


def test_op1_cut_keeps_other_columns(docs):
    cut = suffix_dedup.cut_repeats(docs)
    out = {r[0]: r for r in cut.collect()}
    assert cut.columns == docs.columns
    assert out[7][1] is None and out[2][1] == ROWS[2][1] and out[0][1] == "" and out[0][5:] == ("clash", 9)


def test_op2_fingerprints(docs, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(ROWS) and fingerprints.edited_fingerprints(empty).collect() == []
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    order = sorted(range(len(ROWS)), key=lambda i: ROWS[i][0])
    following = {order[k]: ROWS[order[(k + 1) % len(order)]] for k in range(len(order))}
    edits = Counter((ROWS[i][0], hashlib.sha256(fingerprints.edit(ROWS[i][1] or "", following[i][1] or "").encode()).hexdigest())
                    for i in range(len(ROWS)))
    assert edits == Counter((r.doc_id, r.edited_sha256) for r in got)
    assert by_id[0][0].fingerprint == by_id[10][0].fingerprint != by_id[5][0].fingerprint
    for i in (0, 5, 20):
        r = by_id[i][-1]
        if ROWS[i][0] == 5:
            continue
        a, b = _plain_sets([ROWS[i][1], fingerprints.edit(ROWS[i][1], following[i][1] or "")], 5)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.15
    near = {r.doc_id: r.component_id for r in fingerprints.near_classes(docs).collect()}
    assert near[10] == near[11] == 0 and near[5] == 5


def _plain_sets(texts, k):
    return [{tuple(w[j:j + k]) for j in range(len(w) - k + 1)} for w in (WORD.findall(t) for t in texts)]


def test_op3_rows_law(docs, empty):
    for n in (16, 3, 100):
        got = hilbert.shards(docs, n).collect()
        assert len(got) == len(ROWS)
        per = {}
        for r in got:
            per.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in per.values())
        counts = [len(per.get(s, [])) for s in range(n)]
        assert max(counts) - min(counts) <= 1
    r = {x.doc_id: x for x in got}
    assert r[7].size == 1 and r[18].text_crc32 == zlib.crc32(ROWS[18][1].encode()) and r[18].size == len(ROWS[18][1].encode()) + 1
    assert hilbert.shards(empty).collect() == []


def test_op3_curve_steps_by_one_cell():
    c = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = hilbert.hilbert_index([c[:, 0], c[:, 1], c[:, 2]], 3)
    assert sorted(h) == list(range(512)) and np.abs(np.diff(c[np.argsort(h)], axis=0)).sum(axis=1).max() == 1


def test_op4_targets_and_taken(docs, empty):
    got = mixing.mix(docs, block=16).collect()
    again = mixing.mix(docs.repartition(3), block=16).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(ROWS)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((x[0], len(WORD.findall(x[1] or ""))) for x in ROWS)
    sizes = Counter()
    for x in ROWS:
        sizes[x[3]] += len(WORD.findall(x[1] or ""))
    names = sorted(n for n in sizes if n is not None) + [None]
    w = {n: 1 + i % 3 for i, n in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = total - sum(3 * sizes[n] for n in capped)
        level = free / max(1, sum(w[n] for n in names if n not in capped))
        new = {n for n in names if n not in capped and w[n] * level > 3 * sizes[n]}
        if not new:
            break
        capped |= new
    target = {n: 3 * sizes[n] if n in capped else w[n] * level for n in names}
    source = {x[0]: x[3] for x in ROWS}
    assert all((r.taken > 0) == (r.first_slot is not None) for r in got)
    taken = Counter()
    for r in got:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 * total and r.source_size == sizes[source[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[n] - target[n]) <= 1 for n in names)
    assert mixing.mix(empty).collect() == []


def test_op4_takes_only_scheduled_blocks(spark, docs, monkeypatch):
    """Every source has exactly its blocks' slots, spread evenly; without a schedule nothing is taken."""
    goals = spark.createDataFrame([("big", 40_000), ("mid", 9_000), ("tiny", 3), (None, 700), ("none", 0)], "source string, goal long")
    got = sorted((r.slot, r.source, r.rank) for r in mixing.schedule(goals, 16).collect())
    need = {"big": 2500, "mid": 563, "tiny": 1, None: 44}
    assert Counter(s for _, s, _ in got) == need and len({i for i, _, _ in got}) == len(got)
    for s, n in need.items():
        assert [r for _, x, r in got if x == s] == list(range(n))
    head = [s for _, s, _ in got[:1000]]
    assert all(abs(head.count(s) - 1000 * n / 3108) <= 8 for s, n in need.items())
    assert {r.slot for r in mixing.schedule(goals, 16, factor=1).collect()} == {i for i, _, _ in got}
    nothing = spark.createDataFrame([], "source string, rank long, slot long")
    monkeypatch.setattr(mixing, "schedule", lambda *a: nothing)
    assert all(r.taken == 0 and r.first_slot is None for r in mixing.mix(docs, block=16).collect())


def test_op5_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(v) for v in centre[i % 6] + rng.normal(size=16) * (0.02 if i % 2 else 0.6)], i % 3) for i in range(240)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(240 + i, v, 1) for i, v in enumerate(odd)] + [(300, rows[1][1], None)]
    rows += [(400 + i, rows[1][1], rows[1][2]) for i in range(40)] + [rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect())
    fine = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    linked, n = [], Counter()
    for x, a in enumerate(fine):
        for b in fine[:x]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
                    linked.append((a[0], b[0]))
                    n[a[0]] += 1
                    n[b[0]] += 1
    n[rows[3][0]] //= 2         # its row is there twice; the pair of the two was counted for both
    low = _groups([r[0] for r in rows], linked)
    found = {g[0]: g for g in got}
    links = sum(g[1] * c for g, c in got.items())
    assert all(found[i][2] == low[i] for i in low) and all(g[3] == (g[0] == g[2]) for g in got)
    assert links == 2 * len(linked)
    assert itq.near_duplicates(df.limit(0)).collect() == []


def test_op5_plans_each_length(spark):
    """One short vector in the sample leaves the plan of the long ones as it is."""
    rng = np.random.default_rng(9)
    long = rng.normal(size=(200, 32)).tolist()
    alone, beside = itq.plans(long, 16_000_000, 0.98), itq.plans([*long, [1.0, 2.0]], 16_000_000, 0.98)
    assert alone[32][0] == beside[32][0] > 2 and len(alone[32][1]) == len(beside[32][1]) and list(beside) == [32]
    rows = [(i, v, "a") for i, v in enumerate(long)] + [(300, [1.0, 2.0], "a"), (301, [2.0, 4.0], "a"), (302, [0.5] * 90, "a")]
    got = {r.vec_id: r.component_id for r in itq.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {i: 300 if i == 301 else i for i, _, _ in rows}


def test_op5_finds_pairs_beside_a_long_mean(spark):
    """Vectors around a common direction (mean of length 0.95): pairs planted just above the threshold."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2500, 32))
    x = itq.unit(0.95 * itq.unit(rng.normal(size=(1, 32))) + math.sqrt(1 - 0.95 ** 2) * itq.unit(x))
    step = rng.normal(size=(500, 32))
    step = itq.unit(step - (step * x[:500]).sum(axis=1, keepdims=True) * x[:500])
    x = np.concatenate([x, 0.9805 * x[:500] + math.sqrt(1 - 0.9805 ** 2) * step])
    want = np.triu(itq.unit(x) @ itq.unit(x).T >= 0.98, 1).sum()
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    assert want >= 500 and itq.near_duplicates(df).agg(F.sum("n_links")).first()[0] >= 2 * 0.99 * want


def test_op6_packing(docs, empty):
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(docs, path, capacity=64).collect()
    tok = tokens.encoder(path).tok
    want = Counter()
    for i, t, *_ in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            p = ids[at:at + 64]
            want[(i, k, at, len(p), zlib.crc32(p.tobytes()))] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 3
    assert packing.pack(empty, path).collect() == []


def test_op6_full_bins_close_first():
    f = packing.BestFit(10, 2)
    assert [f.put(s) for s in (6, 7, 9, 4, 1, 10)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 9), (3, 0)]
    assert f.open == 0 and f.bits == 0


def test_tokens_equal_library():
    odd = ["", " a  b\n\n c  d  ", "<|endoftext|> x", "é́ é  　 x 's 't", "e ́x    y", "tab\t\ttab \n \n",
           "don't  stop's", "x" * 50 + " " * 30, "a\x85b\x1cc d"]
    texts = [r[1] for r in ROWS] + odd + [" ".join((r[1] or "") for r in ROWS) * 40]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.encoder(vocabulary(name))
        assert [x.tolist() for x in e.encode(texts)] == [
            x.ids for x in e.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_op7_toxicity(spark, docs, empty):
    rng = random.Random(1)
    bad = ["grumblewort", "snarkfiend", "vilebeast"]
    rows, labels = [], []
    for i in range(360):
        w = _text(rng, 150).split(" ")
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(5000, 0, None), (None, 0, 1), (5001, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = [got[i] >= 0.7 for i in held if i % 4 == 0]
    miss = [got[i] >= 0.7 for i in held if i % 4]
    assert sum(hit) >= 0.9 * len(hit) and sum(miss) <= 0.05 * len(miss)
    r = toxicity.score(docs, model).collect()
    assert len(r) == len(ROWS) and all(0 <= x.score <= 1 for x in r)
    assert toxicity.score(empty, model).collect() == [] and d.where(toxicity.rejected(model)("text")).count() >= 80
    assert toxicity.fit(empty, lab).weights == toxicity.fit(d, lab.limit(0)).weights


def test_op7_long_texts(spark):
    """Long clean texts stay, and toxic passages behind 20,000 code points are learned."""
    rng = random.Random(8)
    bad = ["grumblewort", "snarkfiend", "vilebeast"]
    near = ["grumblebee", "snarkless", "vilemost"]        # ordinary words that share a part with toxic ones
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        w = _text(rng, 150).split(" ")
        for _ in range(4):
            if toxic or rng.random() < 0.03:
                w[rng.randrange(len(w))] = rng.choice(bad if toxic else near)
        rows.append((i, (_text(rng, 5200) + " " if toxic else "") + " ".join(w * (8 if toxic else 1))))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert min(len(t) for i, t in rows if i % 3 == 0) > 20_000 and b"grumblewort" in model.toxic
    clean = [t for i, t in rows if i % 3]
    long = [(i, " ".join(rng.sample(clean, 150))) for i in range(6)]
    assert spark.createDataFrame(long, "doc_id long, text string").where(toxicity.rejected(model)("text")).count() == 0


def test_op8_round_trip(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    got = sorted(huffman.round_trip(docs, path).collect(), key=lambda r: r.start)
    tok = tokens.encoder(path).tok
    ids = [(r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in ROWS]
    assert Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    at = 0
    for a, b in zip(got, [*got[1:], None]):
        assert a.start == at and (b is None or a.doc_id <= b.doc_id)
        at += a.n_tokens
    assert huffman.round_trip(empty, path).collect() == []


def test_op8_codes():
    rng = np.random.default_rng(0)
    counts = np.zeros(3000, np.int64)
    counts[rng.choice(3000, 2500, replace=False)] = (1e9 / np.arange(1, 2501) ** 3).astype(np.int64) + 1
    size = huffman.code_lengths(counts)
    assert size.max() <= 16 and abs((2.0 ** -size[size > 0].astype(float)).sum() - 1) < 1e-12 and ((size > 0) == (counts > 0)).all()
    ids = np.concatenate([rng.choice(3000, 5000, p=counts / counts.sum()), np.flatnonzero(counts)])
    raw, marks = huffman.encode_block(ids, size, huffman.canonical(size))
    assert (huffman.decode_block(raw, marks, len(ids), *huffman.lookup(size)) == ids).all()
    assert huffman.code_lengths(np.array([5, 9, 0, 12, 13, 16, 45])).tolist() == [4, 4, 0, 3, 3, 3, 1]
    assert huffman.code_lengths(np.array([0, 3])).tolist() == [0, 1]


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_op9_groups(docs, empty, k, num):
    got = minhash_bbit.near_groups(docs, k, num, 100).collect()
    sets = _sets([r[1] for r in ROWS], k)
    linked = [(ROWS[a][0], ROWS[b][0]) for a in range(len(ROWS)) for b in range(a)
              if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    low = _groups([r[0] for r in ROWS], linked)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(
        (r[0], len(s), low[r[0]], low[r[0]] == r[0]) for r, s in zip(ROWS, sets))
    if k == 3:
        assert minhash_bbit.near_groups(empty, k, num, 100).collect() == []


def test_op9_chains_without_a_hub(spark):
    """Texts edited step by step: neighbours link, the ends don't, the hub of a bucket links with few."""
    rng = random.Random(2)
    w = _text(rng, 200).split(" ")
    texts = []
    for i in range(60):
        texts.append(" ".join(w))
        w[(i * 7) % 200] = f"new{i}"
        w[(i * 7 + 1) % 200] = f"word{i}"
    df = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = _sets(texts, 3)
    linked = [(1000 - a, 1000 - b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    low = _groups([1000 - i for i in range(60)], linked)
    assert {r.doc_id: r.component_id for r in minhash_bbit.near_groups(df, 3, 85, 100).collect()} == low


def test_op10_licenses(spark, docs, empty):
    apache = ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance '
              "with the License.\nYou may obtain a copy of the License at:\n x.\nUnless required by applicable law or agreed to in "
              'writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR '
              "CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions "
              "and\nlimitations under the License.")
    rows = [(1, apache), (2, "Text.\nReleased under the MIT License.\nAll rights reserved."), (3, None), (4, "License? none")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].sentence_ids, got[1].rules, got[1].licenses) == ("A2 A3 A4 A5 A6", "apache-header", "Apache-2.0")
    assert (got[2].rules, got[2].licenses, got[2].n_sentences) == ("mit-line,reserved", "MIT,Proprietary", 2)
    assert all(got[i].sentence_ids == got[i].rules == got[i].licenses == "" for i in (3, 4))
    r = licenses.scan(docs).collect()
    assert len(r) == len(ROWS) and [x.rules for x in r if x.n_sentences] == ["apache-line"]
    assert licenses.scan(empty).collect() == []


APACHE = """Copyright 2024 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """Copyright (C) 2024  The Authors

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MIT = """MIT License

Copyright (c) 2024 The Authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
BSD = """BSD 2-Clause License

Copyright (c) 2024, The Authors

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_op10_verbatim_notices(spark):
    want = [(APACHE, "A2 A3 A4 A5 A6", "apache-header", "Apache-2.0"), (GPL, "G2 G3 G5 G6 G4", "gpl-header", "GPL-3.0-or-later"),
            (MIT, "M2 M3 M4", "mit-text", "MIT"), (BSD, "B1 B2", "bsd-text", "BSD")]
    rows, expect = [], {}
    for sign in ("", "# ", " * ", "// "):
        for text, *out in want:
            expect[len(rows)] = out
            rows.append((len(rows), "\n".join(sign + line for line in text.split("\n"))))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [r.sentence_ids, r.rules, r.licenses] for r in got} == expect
    one = licenses.scan(spark.createDataFrame([(1, "This program is free software.")], "doc_id long, text string")).first()
    assert one.sentence_ids == "G2" and all(any(h in s for h in licenses.HINTS) for s in licenses.SENTENCES.values())


def test_components_and_numbers(spark):
    chain = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (7, 7), (60, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 50}
    df = spark.createDataFrame([(None, 4), (3, 1), (1, 2), (2, None)], "k long, v long")
    assert sorted(map(tuple, numbered(df, ["k"], {"b": "v"}, "p").select("p", "b").collect())) == [(0, 0), (1, 4), (2, 6), (3, 6)]


def test_word_hashes_tell_words_apart():
    raw = b" ".join(bytes([97 + i // 26, 97 + i % 26]) for i in range(600)) * 2
    got, want = words.word_hashes(raw).tolist(), re.findall(rb"[^\x20\x09-\x0D]+", raw)
    assert len(got) == len(want) and len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))
