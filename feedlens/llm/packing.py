"""op6: bounded-space online best-fit packing of token sequences.

Each text is tokenised, ended with an end id and, only if longer than a sequence, cut
into full pieces and a rest.  Pieces are dealt in hash order over partitions of about
``PART`` sequences; each partition packs online: a fixed number of open bins, a bitset
keyed by free space (bit f set: an open bin has f free), a piece goes to the lowest set
bit that fits, and when all bins are open and none fits, the fullest closes first.
Only lengths travel; ids stay where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import pick, prepare, stored
from feedlens.llm.tokens import encoder

SEQUENCE, OPEN_BINS, PART, END_ID = 4096, 1024, 8192, 1


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins of ``capacity``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits, self.open, self.bins = 0, 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece of ``size`` <= capacity."""
        fit = self.bits >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = self._take(room)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)   # the fullest closes
            room, b = self.capacity, self.bins
            self.bins += 1
        if room > size:
            self.free[room - size].append(b)
            self.bits |= 1 << (room - size)
            self.open += 1
        return b, self.capacity - room

    def _take(self, room: int) -> int:
        b = self.free[room].pop()
        if not self.free[room]:
            self.bits &= ~(1 << room)
        self.open -= 1
        return b


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def _pack(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [fit.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, open_bins: int = OPEN_BINS,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token; repeated rows are packed each; pieces
    of one doc_id on several rows are told apart by their place only; an empty table gives
    an empty result; extra columns are ignored.  The order is by hash of (doc_id, piece),
    ties by the values, so reruns agree."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string")
    p = stored(d.mapInArrow(_pieces(tokenizer, capacity, end_id),
                            "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    total = p.agg(F.sum("length")).first()[0] or 0
    n = max(1, -(-total // (capacity * PART)))
    key = F.xxhash64("doc_id", "piece")
    dealt = p.withColumn("k", key).repartition(int(n), "k").sortWithinPartitions(
        "k", "doc_id", "piece", "length", "ids_crc32").drop("k")
    return dealt.mapInArrow(_pack(capacity, open_bins), "doc_id long, piece int, start long, length long, "
                            "ids_crc32 long, sequence_id long, offset long")
