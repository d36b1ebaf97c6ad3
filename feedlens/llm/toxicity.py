"""op7: toxicity by compression distance.

Two dictionaries are trained by zstandard on windows of labelled texts, one of ordinary and
one of toxic text.  Windows of toxic texts that ordinary texts share are removed before, so
the toxic dictionary is trained on what is left; it stands in front of the ordinary one, so a
window's two compressed lengths differ only where toxic content helps.  Whole texts are cut
into overlapping windows; the saving of the toxic dictionary over the ordinary one, against
the shares of ordinary windows that save as much, gives the features of a logistic score: how
unlikely the counted windows are in an ordinary text of that length, so long texts are not
toxic for their length.

Training uses whole texts of a bounded sample of labelled rows (``SAMPLE`` per class, by id
hash), read in Spark tasks; scoring covers every byte of every text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import pick, prepare, stored
from feedlens.llm.words import minima, permutations, shingles, word_hashes

SAMPLE = {1: 1000, 0: 3000}     # texts per class (toxic, ordinary) used to fit
CUTS = 60_000                   # windows the ordinary dictionary is trained on, spread over its texts
LEVELS = 12                     # savings told apart, in bytes
TOGETHER = (10, 100)            # calibration texts read as one, so that long texts are calibrated too
WINDOW, STRIDE = 64, 48
SHARED = 7                      # bytes of the windows that are looked up in the other class
KEYS, LEFT = 200_000, 250_000   # such windows kept as toxic, the clearest first; windows the toxic dictionary is trained on
DICT_BYTES, TOXIC_BYTES = 16_384, 4_096
SEGMENT = dict(k=32, d=6, split_point=1.0)      # zstandard's segment and match lengths for the toxic dictionary
# a full search with equal tables for both dictionaries: equal content then gives equal lengths
SEARCH = dict(window_log=17, hash_log=17, chain_log=17, search_log=7, min_match=4, target_length=64,
              strategy=zstandard.STRATEGY_BTLAZY2)
REJECT = 0.7


@dataclass(frozen=True)
class Model:
    """Dictionary contents and the calibrated logistic."""
    ordinary: bytes
    toxic: bytes
    least: int              # saving in bytes from which a window counts
    weights: tuple          # bias, surprise at the most telling saving, log of that at counted windows
    rates: tuple = (1.0,) * LEVELS      # share of ordinary windows with a saving of at least 1, 2, ...

    def compressors(self):
        params = zstandard.ZstdCompressionParameters(
            write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        return out


def windows(text: str | None) -> list[bytes]:
    """Overlapping byte windows over a whole text, A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "replace").lower()
    return [raw[i:i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STRIDE)), STRIDE)]


def savings(text: str | None, comp: list) -> np.ndarray:
    """Per window: compressed length under the ordinary dictionary less that under the toxic one."""
    plain, toxic = comp
    return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text)])


def _short_windows(raw: bytes) -> np.ndarray:
    """The SHARED bytes at every place, as a number."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - SHARED + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(SHARED if n > 0 else 0):
        h = (h << np.uint64(8)) | b[j:n + j]
    return h


def _unshared(raw: bytes, keys: np.ndarray) -> list[bytes]:
    """What is left of a text when every place not covered by the windows ``keys`` (sorted) is removed, in windows."""
    if not len(keys) or len(raw) < SHARED:
        return []
    g = _short_windows(raw)
    hit = np.r_[False, keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g, False]
    edge = np.flatnonzero(hit[1:] != hit[:-1])
    return [raw[i:min(i + WINDOW, e + SHARED - 1)] for s, e in zip(edge[::2], edge[1::2])
            for i in range(s, e + SHARED - 1, WINDOW)]


def _each(rows: DataFrame, schema: str, make: Callable) -> DataFrame:
    """Rows of ``schema``: the columns make(doc_ids, raws, roles) of each batch of (doc_id, text, role)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, roles = (batch.column(i).to_pylist() for i in range(3))
            out = make(ids, [t.encode("utf-8", "replace").lower() for t in texts], roles)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[f"c{i}" for i in range(len(out))])
    return rows.mapInArrow(run, schema)


def _window_counts(ids: list, raws: list[bytes], roles: list):
    """Per short window: texts that hold it and places, of toxic and of ordinary texts."""
    none, out = np.zeros(0, np.uint64), []
    for at, role in ((1, 1), (3, 0)):
        each = [np.unique(_short_windows(r), return_counts=True) for r, y in zip(raws, roles) if y == role]
        key, where = np.unique(np.concatenate([none, *[k for k, _ in each]]), return_inverse=True)
        row = np.zeros((5, len(key)), np.int64)
        row[0], row[at] = key.view(np.int64), np.bincount(where, minlength=len(key))
        row[at + 1] = np.bincount(where, np.concatenate([none, *[n for _, n in each]]), len(key))
        out.append(row)
    return tuple(np.concatenate(out, axis=1))


def contrasted(rows: DataFrame, n_toxic: int, n_ordinary: int) -> list[bytes]:
    """At most LEFT windows of the toxic texts, without what ordinary texts share: a short window counts as
    shared unless clearly more toxic texts hold it (z above 5) and it is over 8 times as frequent in them,
    by bytes, so windows of long toxic texts don't count for their length.  The counting, the comparison
    and the removal run in Spark; the driver gets the KEYS clearest short windows."""
    size = dict(rows.groupBy("role").agg(F.sum(F.octet_length("text"))).collect())
    n = _each(rows, ", ".join(f"c{i} long" for i in range(5)), _window_counts).groupBy("c0").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(1, 5)])
    pt, po = F.col("c1") / n_toxic, F.col("c3") / n_ordinary
    p = (F.col("c1") + F.col("c3") + 1) / (n_toxic + n_ordinary + 2)
    z = (pt - po) / F.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_ordinary))
    often = F.col("c2") / max(1, size.get(1, 0)) > 8 * (F.col("c4") + 1) / max(1, size.get(0, 0))
    found = n.where((z > 5) & often).orderBy(z.desc(), "c0").limit(KEYS).select("c0").collect()
    keys = np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))

    def make(ids: list, raws: list[bytes], roles: list):
        left = [(i, k, w) for i, raw in zip(ids, raws) for k, w in enumerate(_unshared(raw, keys))]
        return tuple(pa.array([x[c] for x in left], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary())))

    left = _each(rows.where("role = 1"), "c0 long, c1 long, c2 binary", make)
    chosen = left.orderBy(F.xxhash64("c0", "c1"), "c0", "c1").limit(LEFT).select("c2").collect()
    return [bytes(r[0]).ljust(8) for r in chosen]


def _dictionary(size: int, cuts: list[bytes], **how) -> bytes:
    """Trained by zstandard; the windows themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, cuts, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cuts)[:size]


def _marks(ids: list, raws: list[bytes], roles: list):
    a, b = permutations(8, 7)
    m = minima([shingles(word_hashes(r), 3) for r in raws], a, b)
    return pa.array(ids, pa.int64()), pa.array([[str(v) for v in row] for row in m.tolist()], pa.list_(pa.string()))


def different(marks: list[tuple]) -> list:
    """Ids of (id, minima) without near copies of earlier ones, whose shared windows would pass for toxic ones."""
    kept, seen = [], set()
    for i, row in marks:
        own = set(enumerate(row))
        if len(own & seen) < 2:
            kept.append(i)
            seen |= own
    return kept


def _spread(per: int):
    """At most ``per`` windows of each text, from its start to its end."""
    def make(ids: list, raws: list[bytes], roles: list):
        out = []
        for raw in raws:
            n = -(-len(raw) // WINDOW)
            out += [raw[i * WINDOW:(i + 1) * WINDOW] for i in (range(n) if n <= per else np.linspace(0, n - 1, per).astype(int))]
        return (pa.array(out, pa.binary()),)
    return make


def _levels(model: Model):
    def make(ids: list, raws: list[bytes], roles: list):
        comp = model.compressors()
        return pa.array(ids, pa.int64()), pa.array([counts(savings(r.decode("utf-8", "replace"), comp)).tolist() for r in raws],
                                                   pa.list_(pa.int64()))
    return make


def counts(saved: np.ndarray) -> np.ndarray:
    """Windows in all, and with savings of at least 1, 2, ... LEVELS bytes."""
    return np.array([len(saved), *[(saved >= c).sum() for c in range(1, LEVELS + 1)]], np.int64)


def surprise(n: np.ndarray, rates: tuple) -> np.ndarray:
    """Per saving: exponent (base 10) of the chance of so many windows in an ordinary text of that length (Chernoff's
    bound), 0 for no more than expected."""
    k, want = n[1:].astype(float), n[0] * np.array(rates)
    return np.where(k > want, k * np.log(np.maximum(k, 1e-9) / want) - k + want, 0.0) / math.log(10)


def _calibrate(model: Model, toxic: list[np.ndarray], plain: list[np.ndarray]) -> Model:
    whole = np.sum(plain, axis=0)
    rates = tuple(((whole[1:] + 0.5) / (whole[0] + 1.0)).tolist())
    both = [(n, y) for x, y in ((toxic, 1.0), (plain, 0.0)) for n in x]
    y = np.array([t for _, t in both])
    seen = np.array([surprise(n, rates) for n, _ in both])
    best, least = -1.0, 1
    for cut in range(1, LEVELS + 1):          # the saving that best tells the classes apart
        hit = seen[:, cut - 1] >= 1
        j = hit[y == 1].mean() - hit[y == 0].mean()
        if j > best + 1e-9:
            best, least = j, cut
    for x, t in ((toxic, 1.0), (plain, 0.0)):     # long texts: several read as one
        for g in TOGETHER:
            both += [(np.sum(x[i:i + g], axis=0), t) for i in range(0, len(x) - g + 1, g)]
    x = np.array([features(n, least, rates) for n, _ in both])
    w = _logistic(x, np.array([t for _, t in both]))
    return Model(model.ordinary, model.toxic, least, tuple(w.tolist()), rates)


def train(rows: DataFrame) -> Model:
    """Fit on stored (doc_id, toxic, text) rows, a doc_id once (of repeated ids the label 1 and the least text).  Two thirds make the dictionaries, the rest
    calibrates.  Texts stay in Spark tasks; the driver gets minima, chosen windows and counts.
    Without rows of both classes every text gets the share of toxic rows (0 if none)."""
    rows = rows.select("doc_id", "text", F.col("toxic").alias("role"))
    order = [r[0] for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    classes = dict(rows.select("doc_id", "role").collect())
    share = sum(classes.values()) / max(1, len(classes))
    flat = Model(b"\0" * 16, b"\0" * 16, 1, (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0))
    marks = dict(_each(rows, "c0 long, c1 array<string>", _marks).collect())
    tox, plain = (different([(i, marks[i]) for i in order if classes[i] == t]) for t in (1, 0))
    if len(tox) < 3 or len(plain) < 3:
        return flat
    fit = {i for x in (tox, plain) for k, i in enumerate(x) if k % 3 != 2}
    rest = [i for x in (tox, plain) for k, i in enumerate(x) if k % 3 == 2]
    n_tox, n_plain = (len(fit & set(x)) for x in (tox, plain))
    used = rows.where(F.col("doc_id").isin(*fit))
    cuts = [bytes(r[0]) for r in _each(used.where("role = 0"), "c0 binary", _spread(max(1, CUTS // n_plain)))
            .orderBy(F.xxhash64("c0"), "c0").collect()]
    base = _dictionary(DICT_BYTES, cuts).rjust(16, b"\0")
    own = _dictionary(TOXIC_BYTES, contrasted(used, n_tox, n_plain), **SEGMENT)
    model = Model(base, own + base, 1, (0.0, 0.0, 0.0))
    seen = dict(_each(rows.where(F.col("doc_id").isin(*rest)), "c0 long, c1 array<long>", _levels(model)).collect())
    return _calibrate(model, *[[np.array(seen[i]) for i in rest if classes[i] == t] for t in (1, 0)])


def features(n: np.ndarray, least: int, rates: tuple) -> tuple[float, float, float]:
    s = surprise(n, rates)
    return 1.0, float(min(s[least - 1:].max(), 8)), math.log1p(s[least - 1])


def evidence(text: str | None, comp: list, model: Model) -> float:
    """Log odds of a whole text."""
    return float(np.dot(model.weights, features(counts(savings(text, comp)), model.least, model.rates)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):               # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE[1] toxic and SAMPLE[0] ordinary labelled texts outside the held-out third, chosen by
    id hash: (doc_id, toxic, text), whole texts, stored."""
    lab = (pick(labels, doc_id="long", toxic="int").where("toxic in (0, 1) and doc_id is not null")
           .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [lab.where(F.col("toxic") == t).orderBy(*order).limit(SAMPLE[t]) for t in (1, 0)]
    few = chosen[0].union(chosen[1])
    d = pick(docs, doc_id="long", text="string").where("text is not null")
    rows = d.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return stored(rows.repartition(32, "doc_id"), "training")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    prepare(docs.sparkSession)
    return train(training_rows(docs, labels))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = model.compressors()
        for batch in batches:
            z = np.array([evidence(t, comp, model) for t in batch.column(1).to_pylist()], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(p)],
                                             names=[*[n for n in batch.schema.names if n != "text"], "score"])
    return run


def score(docs: DataFrame, model: Model, with_key: bool = False) -> DataFrame:
    """(doc_id, score) per row, with ``tkey`` (text hash) on request; no shuffle.

    The score depends on the text alone, whole however long (a very long one is cut into windows in one
    task).  Null counts as empty; repeated rows get equal
    scores; an empty table gives an empty result; extra columns are ignored."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string")
    if with_key:
        d = d.withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    return d.mapInArrow(_score(model), "doc_id long, " + "tkey long, " * with_key + "score double")


def rejected(model: Model, limit: float = REJECT):
    """Column function: is a text's score at least ``limit``?  (null counts as empty)"""
    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        comp = model.compressors()
        return pd.Series([evidence(t, comp, model) for t in texts], dtype=float).map(
            lambda z: 1 / (1 + math.exp(-min(max(z, -30), 30))) >= limit)
    return test
