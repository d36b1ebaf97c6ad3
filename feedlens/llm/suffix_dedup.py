"""op1: exact substring dedup over a Burrows-Wheeler transform.

Which ``length``-byte strings of the corpus start at more than one place?

1. Content-defined anchors deal the work: every window of ``length`` bytes takes the
   smallest hash among its 32-byte grams as its anchor; equal windows have equal anchors.
   Neighbouring windows with one anchor form a segment.  Anchors seen once are done.
2. Equal segments under one anchor are collapsed (their windows all repeat); one copy of
   each distinct segment goes on.
3. Blocks of whole anchor groups: suffix array (prefix doubling) and BWT, then interval
   expansion: breadth first, the intervals of all strings w of length l are extended
   backward to cw; the right end of a new interval is a position with common prefix l,
   and is queued once.  Values come out by increasing size and the search stops at
   ``length``: positions not reached by then have a common prefix of at least that.
   An anchor with more than ``HOT_BYTES`` of distinct segments (a line in very many contexts)
   is dealt again first: its windows by their ``m`` smallest gram hashes, which equal windows
   share, for growing ``DEPTHS`` until every group fits; step 2 applies to the parts as well,
   so most of them, seen once, drop out before any text is gathered.  The texts of these anchors
   come from the one pass over the documents that feeds the blocks, deeper ones from the level above.
4. The windows found are carried back to every place of their segment and merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import pick, prepare, stored
from feedlens.llm.words import _BYTE, mix

LENGTH, GRAM = 200, 32
CHUNK = 1 << 19          # window starts handled together
BLOCK_BYTES = 1 << 21    # text of a BWT block (closed at the next anchor beyond it)
HOT_BYTES = 1 << 20      # text of an anchor group that is dealt again
DEPTHS = (2, 8, 32, LENGTH)     # smallest gram hashes by which windows are dealt (the last: all of them)
SEPARATOR = 0xFF         # occurs in no UTF-8 text


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every position (GRAM a power of two)."""
    with np.errstate(over="ignore"):
        h, size, p = _BYTE[buf], 1, np.uint64(0x9E3779B97F4A7C15)
        while size < GRAM:
            h = h[:-size] * p + h[size:]
            p, size = p * p, size * 2
    return mix(h)


def segments(raw: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window start, number of windows, anchor hash) of each segment, chunk by chunk."""
    wide = length - GRAM + 1
    for c in range(0, len(raw) - length + 1, CHUNK):
        buf = np.frombuffer(raw, np.uint8, offset=c, count=min(CHUNK + length - 1, len(raw) - c))
        g = gram_hashes(buf)
        low = (g & ~np.uint64(0xFFFFF)) | np.arange(len(g), dtype=np.uint64)   # ties: the leftmost
        size = 1
        while size * 2 <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[:len(low) - (wide - size)], low[wide - size:])
        at = (low & np.uint64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield first + c, np.diff(np.r_[first, len(at)]), g[at[first]]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[] for _ in range(6)]
            rows = 0

            def flush() -> pa.RecordBatch:
                kinds = [pa.int64()] * 6
                return pa.RecordBatch.from_arrays(
                    [pa.array(out[0], kinds[0]), *[pa.array(np.concatenate(x)) for x in out[1:5]],
                     pa.array(np.array(out[5], np.uint64).view(np.int64))],
                    names=["doc_id", "tkey", "lo", "cnt", "key", "seg"])

            for i, t, text in zip(ids, keys, batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8", "replace")
                if len(raw) < length:
                    continue
                for lo, cnt, key in segments(raw, length):
                    ends = lo + cnt + (length - 1)
                    out[5] += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), ends.tolist())]
                    out[0] += [i] * len(lo)
                    out[1].append(np.full(len(lo), t, np.int64))
                    out[2].append(lo.astype(np.int64))
                    out[3].append(cnt.astype(np.int64))
                    out[4].append(key.view(np.int64))
                    rows += len(lo)
                if rows > 50_000:
                    yield flush()
                    out, rows = [[] for _ in range(6)], 0
            if rows:
                yield flush()
    return run


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` or more bytes, by prefix doubling from 8-byte
    words, and the index at which each group of equal 8-byte prefixes begins."""
    n = len(text)
    word = np.zeros(n + 8, np.uint64)
    word[:n] = text
    for size in (1, 2, 4):
        word = (word << np.uint64(8 * size)) | np.append(word[size:], np.zeros(size, np.uint64))
    word = word[:n]
    sa = np.argsort(word)                        # the order of equal keys is of no matter
    w = word[sa]
    head = np.ones(n + 1, bool)                  # rows at which a group of equal prefixes begins
    np.not_equal(w[1:], w[:-1], out=head[1:n])
    start = np.flatnonzero(head[:n])
    rank = np.empty(n + 1, np.int64)
    rank[sa] = np.repeat(start, np.diff(np.r_[start, n]))
    rank[n] = -1
    h = 8
    while h < depth:
        at = np.flatnonzero(~(head[:-1] & head[1:]))   # groups still to be told apart
        if not len(at):
            break
        sub = sa[at]
        key = rank[sub] * (n + 2) + rank[np.minimum(sub + h, n)] + 1
        o = np.argsort(key)
        sub, key = sub[o], key[o]
        sa[at] = sub
        new = np.r_[True, key[1:] != key[:-1]]
        rank[sub] = at[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]
        head[at[new]] = True
        h *= 2
    return sa, start


def repeated(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each position: does the string of ``length`` bytes there start at another position too?

    Backward extension over the BWT: an interval is the rows of the suffix order that begin
    with a string w; for each symbol c that precedes it, the rows that precede those suffixes
    are the interval of cw.  ``reached[i]``: rows i-1 and i differ within the lengths seen."""
    n = len(text)
    if n < length:
        return np.zeros(n, bool)
    sa, start = suffix_order(text, length)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = place[sa - 1]               # row of the suffix one position earlier
    bwt = text[sa - 1].astype(np.int64)
    whole = sa > 0
    reached = np.zeros(n + 1, bool)
    reached[start] = reached[n] = True
    lo, size = start, np.diff(np.r_[start, n])
    for _ in range(8, length):
        if not len(lo):
            break
        own = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        keep = whole[rows]
        rows, own = rows[keep], own[keep]
        to = before[rows]
        o = np.argsort(to)
        to, name = to[o], (own * 256 + bwt[rows])[o]
        head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(to) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(to)])
        lo, size = to[head], count
        fresh = ~reached[lo + size]
        lo, size = lo[fresh], size[fresh]
        reached[lo + size] = True
    twin = ~reached
    out = np.zeros(n, bool)
    out[sa] = twin[:-1] | twin[1:]
    return out


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[c] for p in parts], pa.int64()) for c in ("key", "seg", "n")]
                    + [pa.array([raw[p["lo"]:p["lo"] + p["cnt"] + length - 1] for p in parts], pa.binary()),
                       pa.array([p["hot"] for p in parts], pa.bool_())],
                    names=["key", "seg", "n", "raw", "hot"])
    return run


_SOLVED = ["key", "seg", "off", "len", "n", "raw"]


def _blocks(length: int):
    """Repeated windows of the segments (key, seg, off, len); those of a hot anchor pass as they are (key, seg, n, raw)."""
    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        sep = bytes([SEPARATOR])
        dup = repeated(np.frombuffer(sep.join(r[3] for r in rows) + sep, np.uint8), length)
        out, at = [], 0
        for key, seg, n, raw in rows:
            if n == 1:
                hit = np.r_[False, dup[at:at + len(raw) - length + 1], False]
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                out += [(key, seg, int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2])]
            at += len(raw) + 1
        return pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                           pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.binary())], names=_SOLVED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            hot = batch.filter(batch.column(4))
            if hot.num_rows:
                none = pa.nulls(hot.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([hot.column(0), hot.column(1), none, none, hot.column(2), hot.column(3)],
                                                 names=_SOLVED)
            batch = batch.filter(pc.invert(batch.column(4)))
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if size > BLOCK_BYTES and row[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield solve(rows)
    return run


def deal(raw: bytes, m: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key) of the runs of neighbouring windows of ``raw`` that share
    their ``m`` smallest gram hashes."""
    near = np.lib.stride_tricks.sliding_window_view(gram_hashes(np.frombuffer(raw, np.uint8)), length - GRAM + 1)
    m = min(m, near.shape[1])
    low = np.sort(np.partition(near, m - 1, axis=1)[:, :m] if m < near.shape[1] else near, axis=1)
    key = np.full(len(low), m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            key = mix((key ^ low[:, j]) * np.uint64(0x9E3779B97F4A7C15))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return first, np.diff(np.r_[first, len(key)]), key[first]


def _deal_again(length: int, m: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]],
                                           *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[5:]]], names=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, seg, n, raw in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                for off, cnt, sub in zip(*[x.tolist() for x in deal(raw, m, length)]):
                    out.append((key, seg, n, off, cnt, sub, xxhash.xxh3_64_intdigest(raw[off:off + cnt + length - 1])))
                if len(out) > 50_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
    return run


_DEALT = ["key", "seg", "n", "off", "cnt", "sub", "part"]


def _held(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, parts): every text of ``texts`` (a, b, text) with the segments of ``chosen`` that are read from it."""
    todo = chosen.groupBy("a", "b").agg(F.collect_list(F.struct("lo", "cnt", "key", "seg", "n", "hot")).alias("parts"))
    one = texts.select(F.col("a").alias("d"), F.col("b").alias("t"), "text")
    return todo.join(one, F.expr("a <=> d and b = t")).select("text", "parts")


def repeated_windows(distinct: DataFrame, texts: DataFrame, length: int, depths: tuple = DEPTHS) -> DataFrame:
    """(key, seg, off, len): the windows of the segments ``distinct`` (key, seg, n, at) that repeat, all of
    them where n > 1; ``distinct`` is a stored table, its ``at`` (a, b, lo, cnt) a place in ``texts`` (a, b, text)."""
    sizes = stored(distinct.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.col("at.cnt") + length - 1).alias("size"))
                   .where("k > 1").select("key", (F.col("size") > HOT_BYTES if depths else F.lit(False)).alias("hot")), "mixed-keys")
    held = _held(distinct.select("key", "seg", "n", "at.*").join(sizes, "key"), texts).mapInArrow(
        _cut_out(length), "key long, seg long, n long, raw binary, hot boolean")
    # a hot anchor's segments are dealt on their own: they need not meet here
    out = (held.repartition("key", F.when(F.col("hot"), F.col("seg"))).sortWithinPartitions("key", "seg")
           .mapInArrow(_blocks(length), "key long, seg long, off long, len long, n long, raw binary"))
    whole = distinct.where("n > 1").select("key", "seg", F.lit(0).cast("long").alias("off"), F.col("at.cnt").alias("len"))
    if sizes.where("hot").isEmpty():
        return out.select("key", "seg", "off", "len").union(whole)
    out = stored(out, "blocks")
    hot = out.where("raw is not null")
    n_tasks = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))    # by rows: few bytes are much work here
    parts = stored(hot.select("key", "seg", "n", "raw").repartition(n_tasks, "key", "seg").mapInArrow(
        _deal_again(length, depths[0]), ", ".join(f"{c} long" for c in _DEALT)), "parts")
    again = stored(parts.groupBy(F.col("sub").alias("key"), F.col("part").alias("seg")).agg(
        F.sum("n").alias("n"), F.min(F.struct(F.col("key").alias("a"), F.col("seg").alias("b"), F.col("off").alias("lo"), "cnt")).alias("at")),
        "segments")
    found = repeated_windows(again, hot.select(F.col("key").alias("a"), F.col("seg").alias("b"), F.col("raw").alias("text")),
                             length, depths[1:]).select(
        F.col("key").alias("sub"), F.col("seg").alias("part"), F.col("off").alias("o"), "len")
    inner = parts.where("n = 1").join(found, ["sub", "part"]).select("key", "seg", (F.col("off") + F.col("o")).alias("off"), "len")
    return out.where("raw is null").select("key", "seg", "off", "len").union(whole).union(inner)


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tkey, ranges): ranges of window starts [s, e) whose ``length`` bytes also start
    elsewhere, for rows that have any; ``docs`` has doc_id, tkey, text."""
    anchors = stored(docs.select("doc_id", "tkey", "text").mapInArrow(
        _anchors(length), "doc_id long, tkey long, lo long, cnt long, key long, seg long"), "anchors")
    # stored, so that the join's two exchanges stand alone and a hot anchor's partition can be split
    twice = stored(anchors.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "repeated-keys")
    found = stored(anchors.join(twice, "key"), "repeated-anchors")
    distinct = stored(found.groupBy("key", "seg").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").alias("a"), F.col("tkey").alias("b"), "lo", "cnt")).alias("at")),
        "segments")
    texts = docs.select(F.col("doc_id").alias("a"), F.col("tkey").alias("b"), "text")
    where = stored(repeated_windows(distinct, texts, length), "windows")
    spans = found.join(where, ["key", "seg"]).select(
        "doc_id", "tkey", F.struct((F.col("lo") + F.col("off")).alias("s"),
                                   (F.col("lo") + F.col("off") + F.col("len")).alias("e")).alias("r"))
    return spans.groupBy("doc_id", "tkey").agg(F.collect_set("r").alias("ranges"))


def removed_runs(ranges: list, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by the windows that start in ``ranges``."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length - 1)
        else:
            out.append([s, e + length - 1])
    return [(a, b) for a, b in out]


def _finish(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, text, ranges in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                raw = (text or "").encode("utf-8", "replace")
                runs = removed_runs([(r["s"], r["e"]) for r in ranges or []], length)
                left = b"".join(raw[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(raw)]))
                rows.append((i, t, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(),
                             (left.decode("utf-8", "ignore") if runs else text) if with_text else None))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6 + with_text)],
                                             names=["doc_id", "tkey", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                                                    "kept_text"][:6 + with_text])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, tkey (text hash), n_bytes, n_removed, n_spans, kept_sha256 and,
    on request, kept_text (the remaining bytes; a character cut in two is left out).

    Removes every byte covered by a ``length``-byte string that starts anywhere else too, all
    occurrences, judged on the input.  Null text counts as empty (kept_text stays null); shorter
    texts keep all; equal rows repeat each other and lose all from ``length`` bytes on; an empty
    table gives an empty result; extra columns are ignored."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string").withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranges = repeated_ranges(d, length).select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "ranges")
    rows = d.join(ranges, F.expr("doc_id <=> d and tkey = t"), "left").select("doc_id", "tkey", "text", "ranges")
    return rows.mapInArrow(_finish(length, with_text), "doc_id long, tkey long, n_bytes long, n_removed long, "
                           "n_spans long, kept_sha256 string" + ", kept_text string" * with_text)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with every repeated string cut out of ``text``; rows
    without one, and null texts, stay as they are."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string").withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    r = repeated_ranges(d, length).select(
        F.col("doc_id").alias("_d"), F.col("tkey").alias("_t"), F.transform("ranges", lambda x: x["s"]).alias("_s"),
        F.transform("ranges", lambda x: x["e"]).alias("_e"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, s, e in zip(texts, starts, ends):
            if s is not None:
                raw = text.encode("utf-8", "replace")
                runs = removed_runs(list(zip(s.tolist(), e.tolist())), length)
                text = b"".join(raw[a:b] for a, b in zip([0, *[x[1] for x in runs]], [*[x[0] for x in runs], len(raw)])
                                ).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out)

    names = docs.columns          # by position: other columns may clash with any name used here
    c = [f"_c{i}" for i in range(len(names))]
    doc_id, text = c[names.index("doc_id")], c[names.index("text")]
    rows = docs.toDF(*c).withColumn("_k", F.xxhash64(F.coalesce(text, F.lit("")))).join(
        r, F.expr(f"{doc_id} <=> _d and _k = _t"), "left")
    return rows.withColumn(text, rest(text, "_s", "_e")).select(*c).toDF(*names)
