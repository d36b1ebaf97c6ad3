"""op13: packing in the order of a space-filling curve.

A document's token counts are hashed into a signed feature vector and projected to DIMS
numbers; their index on a fine Hilbert curve is the document's key.  The documents are
range-sorted by that key and laid end to end along the curve: token p of the whole line
stands in sequence p // capacity, so documents that share words share sequences and only
a sequence's end cuts a document.  What is left behind the last full sequence is cut into
powers of two, which need no padding.

Token ids travel with their documents, in chunks of bounded length and two bytes an id
where they fit; the only value that passes the driver is the line's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import _running, pick, prepare, stored
from feedlens.llm.hilbert import hilbert_index
from feedlens.llm.tokens import encoder
from feedlens.llm.words import mix

SEQUENCE, END_ID = 4096, 2
DIMS, BITS, REACH = 4, 15, 4.0      # coordinates from -REACH to REACH (about normal) on a grid of 2**BITS
FEATURES = 1 << 14
CHUNK = 1 << 16                     # ids a row carries
SLICE = 256                         # documents handled together
_CHUNKS = "doc_id long, start long, length long, doc_tokens long, ids_hash long, cell long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def directions(seed: int = 13) -> np.ndarray:
    """Random projection of the hashed features to DIMS numbers."""
    return np.random.default_rng(seed).standard_normal((FEATURES, DIMS))


def cells(docs: list[np.ndarray], axes: np.ndarray) -> np.ndarray:
    """Hilbert index of each document: 1 + log count per id, hashed to a feature and a sign, scaled to
    length 1, projected, put on the grid.  A document without ids lies at the origin."""
    v = np.zeros((len(docs), DIMS))
    size = np.array([len(d) for d in docs])
    if size.sum():
        pair, counts = np.unique(np.repeat(np.arange(len(docs), dtype=np.uint64) << np.uint64(32), size)
                                 | np.concatenate(docs).astype(np.uint64), return_counts=True)
        h = mix(pair & np.uint64(0xFFFFFFFF))
        w = (1 + np.log(counts)) * np.where(h >> np.uint64(63), -1.0, 1.0)
        doc = (pair >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        norm = np.sqrt(np.add.reduceat(w * w, first))
        v[doc[first]] = np.add.reduceat(w[:, None] * axes[(h % np.uint64(FEATURES)).astype(np.int64)], first) / norm[:, None]
    grid = np.clip((v + REACH) * ((1 << BITS) / (2 * REACH)), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(list(grid.T), BITS)


def _chunks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, axes = encoder(path), directions()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield _rows(part.column(0).to_pylist(), list(enc.encode(part.column(1).to_pylist())), axes, end_id)
    return run


def _rows(doc_ids: list, docs: list[np.ndarray], axes: np.ndarray, end_id: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for i, ids, cell in zip(doc_ids, docs, cells(docs, axes).tolist()):
        ids = np.append(ids, end_id)
        ids = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
        mark = zlib.crc32(ids.tobytes())
        for s in range(0, len(ids), CHUNK):
            part = ids[s:s + CHUNK]
            for c, v in zip(cols, (i, s, len(part), len(ids), mark, cell, part.tobytes())):
                c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 6 + [pa.binary()])],
                                      names=[f.split(" ")[0] for f in _CHUNKS.split(", ")])


def along_curve(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Chunks of all documents with ``cell`` (Hilbert index), ``ids`` (two or four bytes each) and ``before``
    (tokens ahead of the chunk on the line).

    Order: cell, ids_hash (equal texts stay together), doc_id (null first), start, then the lengths."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string")
    c = stored(d.mapInArrow(_chunks(tokenizer, end_id), _CHUNKS), "chunks")
    order = [F.col(k).asc_nulls_first() for k in ("cell", "ids_hash", "doc_id", "start", "length", "doc_tokens")]
    ranged = c.repartitionByRange(*order).sortWithinPartitions(*order)
    line = stored(ranged.mapInArrow(_running(len(c.columns), [c.columns.index("length")]),
                                    f"{_CHUNKS}, _pid int, _r0 long, _r1 long"), "line")
    totals = line.groupBy("_pid").agg(F.sum("length").alias("_t"))
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)       # one row per partition
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_o"))
    return line.join(F.broadcast(offsets), "_pid").select(*c.columns, (F.col("_r0") + F.col("_o")).alias("before"))


def cut_points(at: int, length: int, total: int, capacity: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of the parts of [at, at + length) on a line of ``total`` tokens: full sequences,
    then one sequence for every power of two in what is left (pieces up to ``capacity``)."""
    full, out, end = total // capacity, [], at + length
    while at < end:
        if at < full * capacity:
            seq, offset, room = at // capacity, at % capacity, capacity - at % capacity
        else:
            seq, first, left = full, full * capacity, total - full * capacity
            size = 1 << (left.bit_length() - 1)
            while at >= first + size:
                seq, first, left = seq + 1, first + size, left - size
                size = 1 << (left.bit_length() - 1)
            offset, room = at - first, first + size - at
        n = min(room, end - at)
        out.append((seq, offset, n))
        at += n
    return out


def _cut(total: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield _parts(batch.slice(at, SLICE), total, capacity)
    return run


def _parts(batch: pa.RecordBatch, total: int, capacity: int) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for doc, start, length, tokens, ids, before in zip(*[batch.column(c).to_pylist() for c in (
            "doc_id", "start", "length", "doc_tokens", "ids", "before")]):
        ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4")
        done = 0
        for seq, offset, n in cut_points(before, length, total, capacity):
            for c, v in zip(cols, (doc, start + done, n, ids[done:done + n].tobytes(), tokens, seq, offset)):
                c.append(v)
            done += n
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3)],
                                      names=[f.split(" ")[0] for f in _PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every sequence is full or a power of two long, so none needs padding.  Null and empty texts
    are one token (the end id); very long texts travel in chunks of CHUNK ids; repeated rows are
    packed each; an empty table gives an empty result; extra columns are ignored.  Reruns agree."""
    line = along_curve(docs, tokenizer, end_id)
    total = line.agg(F.sum("length")).first()[0] or 0
    return line.mapInArrow(_cut(total, capacity), _PIECES)
