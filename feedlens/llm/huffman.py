"""op8: token ids as canonical length-limited Huffman codes.

File format, a folder with two Parquet tables:
  ``code``    (id, length): code length of every id that occurs, at most 16 bits;
              canonical codes follow from the lengths (shorter first, then by id).
  ``blocks``  one row per independent block of whole documents, in ascending doc_id:
              file, block, start (ids before it in the file), doc_ids, sizes, checkpoints
              (bit offset of every 256th id, little-endian u64) and the coded bits.
Global counts are summed per task before the shuffle; the lengths come from
package-merge over at most a vocabulary of counts.  A block is decoded by one table
lookup per id, all stretches between checkpoints side by side.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.llm.common import pick, prepare, stored
from feedlens.llm.tokens import encoder
from feedlens.session import ensure_checkpoint_dir

MAX_BITS, STRETCH, BLOCK_IDS, END_ID = 16, 256, 1 << 18, 2


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.float64)
    rows, packed = [], np.zeros(0)
    for _ in range(limit):             # each level: symbols merged with the pairs of the level below
        both = np.concatenate([w, packed])
        sort = np.argsort(both, kind="stable")
        rows.append(sort < len(w))
        m = both[sort]
        packed = m[0:len(m) // 2 * 2:2] + m[1::2][:len(m) // 2]
    take, size = 2 * len(w) - 2, np.zeros(len(w), np.int64)
    for is_symbol in reversed(rows):   # symbols among the first ``take`` of a level are one bit longer
        chosen = is_symbol[:take]
        n = int(chosen.sum())
        size[:n] += 1
        take = 2 * (len(chosen) - n)
    out[order] = size
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes from lengths: ascending by (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    for n in range(1, MAX_BITS + 1):
        at = order[lengths[order] == n]
        code <<= n - last
        last = n
        codes[at] = code + np.arange(len(at), dtype=np.uint32)
        code += len(at)
    return codes


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded bits and the bit offset of every STRETCH-th id."""
    n = lengths[ids].astype(np.int64)
    stop = np.cumsum(n)
    at = stop - n
    out = np.zeros((int(stop[-1]) if len(stop) else 0) // 8 + 4, np.uint8)
    word = codes[ids].astype(np.int64) << (24 - n - (at & 7))
    for k in range(3):                 # bits of different ids never overlap: sums are ors
        part = np.bincount((at >> 3) + k, ((word >> (16 - 8 * k)) & 255).astype(np.float64), minlength=len(out))
        out |= part[:len(out)].astype(np.uint8)
    return out.tobytes(), at[::STRETCH]


def decode_block(raw: bytes, marks: np.ndarray, n: int, symbol: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block: one lookup per id, one lane per checkpoint."""
    if not n:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    b = np.concatenate([b, np.zeros(3, np.uint32)])
    view = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    at = marks.astype(np.int64).copy()
    out = np.zeros((len(at), STRETCH), np.int32)
    left = n - (len(at) - 1) * STRETCH
    lanes = len(at)
    for step in range(STRETCH):
        if step == left:
            lanes -= 1
            if not lanes:
                break
        p = at[:lanes]
        window = (view[p >> 3] >> (np.uint32(8) - (p & 7).astype(np.uint32))) & np.uint32(0xFFFF)
        out[:lanes, step] = symbol[window]
        at[:lanes] = p + bits[window]
    return out.reshape(-1)[:n]


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every 16-bit window: canonical codes fill the table in order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbol, bits = np.zeros(1 << MAX_BITS, np.int32), np.ones(1 << MAX_BITS, np.int64)
    symbol[:span.sum()] = np.repeat(order, span)
    bits[:span.sum()] = np.repeat(lengths[order], span)
    return symbol, bits


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [np.append(x, end_id).astype("<u4") for x in enc.encode(batch.column(1).to_pylist())]
            small = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"W" + x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["doc_id", "ids"])
    return run


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) & 1 else np.frombuffer(raw, "<u2")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            c = np.bincount(_ids(raw))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[:len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


def _encode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, file = canonical(lengths), TaskContext.get().partitionId()
        docs, parts, size, start, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            bits, marks = encode_block(np.concatenate(parts), lengths, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
                 pa.array([marks.astype("<u8").tobytes()], pa.binary()), pa.array([bits], pa.binary())],
                names=["file", "block", "start", "doc_ids", "sizes", "checkpoints", "bits"])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _ids(raw)
                if parts and size + len(ids) > BLOCK_IDS:
                    yield flush()
                    docs, parts, start, size, block = [], [], start + size, 0, block + 1
                docs.append(i)
                parts.append(ids)
                size += len(ids)
        if parts:
            yield flush()
    return run


def _decode(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, bits = lookup(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                file, start, docs, sizes, marks, raw = [batch.column(k)[row].as_py() for k in range(6)]
                n = sum(sizes)
                ids = decode_block(raw, np.frombuffer(marks, "<u8"), n, symbol, bits).astype("<u4")
                cuts = np.cumsum([0, *sizes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(start + cuts[:-1]),
                     pa.array(sizes, pa.int64()),
                     pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])], pa.int64())],
                    names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Tokenise all texts and write them to ``path`` in the format above, ascending by doc_id
    (nulls first, ties by content)."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string")
    tokens = stored(d.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, ids binary"), "ids")
    counts = tokens.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([r["id"] for r in counts], default=-1) + 1, np.int64)   # one row per id of the vocabulary
    for r in counts:
        total[r["id"]] = r["n"]
    lengths = code_lengths(total)
    spark = docs.sparkSession
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(
        1).write.parquet(f"{path}/code")
    run = tokens.withColumn("h", F.xxhash64("ids"))
    run = run.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "ids")
    run.mapInArrow(_encode(lengths), "file int, block int, start long, doc_ids array<long>, sizes array<long>, "
                   "checkpoints binary, bits binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files; start counts the ids of all documents before."""
    prepare(spark)
    code = spark.read.parquet(f"{path}/code").collect()      # at most one row per id of the vocabulary
    lengths = np.zeros(max([r["id"] for r in code], default=-1) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    files = blocks.select("file", (F.col("start") + size).alias("n")).groupBy("file").agg(F.max("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)      # one row per file
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = blocks.select("file", "start", "doc_ids", "sizes", "checkpoints", "bits").mapInArrow(
        _decode(lengths), "file int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(files, "file").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all ids to a new folder of the shared area and read them back.

    Null and empty texts hold the end id alone; repeated rows are written each, equal ids
    next to each other; an empty table gives empty files and result; extra columns are ignored."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/feedlens-llm/huffman-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, path)
    return read_ids(spark, path)
