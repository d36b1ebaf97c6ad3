"""op2: MinHash document fingerprints.

A fingerprint holds, for each of 192 universal hash functions over the 5-word shingles
of a whole text (computed in numpy per batch), 8 bits of the minimum, as hex.  The
share of equal bytes, corrected for chance, estimates the Jaccard similarity.
``near_classes`` joins signature bands in Spark and verifies the Jaccard on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import pick, prepare, stored
from feedlens.llm.minhash_bbit import near_groups
from feedlens.llm.words import minima, permutations, shingles, word_hashes

WORDS, MINIMA, SEED = 5, 192, 2


def fingerprint_bytes(texts: list[str], words: int = WORDS) -> np.ndarray:
    """(len(texts), MINIMA) uint8; a text without words has 255 throughout."""
    a, b = permutations(MINIMA, SEED)
    sets = [shingles(word_hashes(t.encode("utf-8", "replace")), words) for t in texts]
    return (minima(sets, a, b) >> np.uint64(36)).astype(np.uint8)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity per row, 0 to 1 (1 for equal fingerprints)."""
    same = (x == y).mean(axis=1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for at in range(0, len(texts), 256):
            fp = fingerprint_bytes(texts[at:at + 256])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(fp)), pa.array([len(t) for t in texts[at:at + 256]], pa.int64()),
                 pa.array([r.tobytes().hex() for r in fp])], names=["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) per row; null text counts as empty, extra columns are ignored."""
    prepare(docs.sparkSession)
    return pick(docs, doc_id="long", text="string").mapInArrow(
        _plain, "doc_id long, n_chars long, fingerprint string")


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept): bands of the minima joined between class
    representatives, Jaccard >= 0.8 over 5-word shingles verified on the full sets."""
    return near_groups(docs, WORDS, 80, 100)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``."""
    m = len(text) // 2
    return text[:len(text) - m] + following[:m]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(ids: list, texts: list[str], nexts: list[str]) -> list[tuple]:
    """Result rows of some documents and their followers."""
    edited = [edit(t, u) for t, u in zip(texts, nexts)]
    chain = all(texts[i + 1] is nexts[i] for i in range(len(texts) - 1))
    if chain:
        own = fingerprint_bytes([*texts, nexts[-1]])
        fp, nx = own[:-1], own[1:]
    else:
        fp, nx = fingerprint_bytes(texts), fingerprint_bytes(nexts)
    ed = fingerprint_bytes(edited)
    return list(zip(ids, [len(t) for t in texts],
                    [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
                    [r.tobytes().hex() for r in fp], [r.tobytes().hex() for r in ed],
                    likeness(fp, ed).tolist(), likeness(fp, nx).tolist()))


def _batch(rows: list[tuple], pid: int, kind: int, texts: list | None = None) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([pid] * len(rows), pa.int32()),
         pa.array(texts or [None] * len(rows), pa.string()), *cols],
        names=["kind", "pid", "text", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A run of documents in ascending doc_id: results of all but the last, and the first and last texts."""
    pid, ids, texts = TaskContext.get().partitionId(), [], []
    blank = (None,) * 6
    seen = False
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = t or ""
            if not seen:
                seen = True
                yield _batch([(i, *blank)], pid, 1, [t])
            ids.append(i)
            texts.append(t)
            if len(ids) > 128:
                yield _batch(_compare(ids[:-1], texts[:-1], texts[1:]), pid, 0)
                ids, texts = ids[-1:], texts[-1:]
    if len(ids) > 1:
        yield _batch(_compare(ids[:-1], texts[:-1], texts[1:]), pid, 0)
    if ids:
        yield _batch([(ids[-1], *blank)], pid, 2, texts[-1:])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, t, u in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            yield _batch(_compare([i], [t], [u]), 0, 0).select(
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness to each other and to the next text.

    Order: ascending doc_id, nulls first, ties by text hash; repeated rows follow each other.
    The document after the last is the first; a single document is its own follower.  Null
    texts count as empty; two texts without words have likeness 1.  An empty table gives an
    empty result; extra columns are ignored.  Documents are range-partitioned by doc_id; only
    the first and last text of each partition meet in a second, small step."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string")
    d = d.withColumn("tkey", F.xxhash64("text"))
    run = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tkey").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tkey").select("doc_id", "text")
    parts = stored(run.mapInArrow(_walk, f"kind int, pid int, text string, {RESULT}"), "fingerprints")
    order = Window.orderBy("pid")  # one row per partition
    heads = parts.where("kind = 1").select("pid")
    after = (heads.withColumn("then", F.lead("pid").over(order))
             .withColumn("then", F.coalesce("then", F.min("pid").over(Window.partitionBy()))))
    last = (parts.where("kind = 2").select("pid", "doc_id", "text").join(after, "pid")
            .join(parts.where("kind = 1").select(F.col("pid").alias("then"), F.col("text").alias("following")), "then")
            .select("doc_id", "text", "following").mapInArrow(_tails, RESULT))
    return parts.where("kind = 0").drop("kind", "pid", "text").union(last)
