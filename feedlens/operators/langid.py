"""Language identification (L1, used by S4 / N13).

A multinomial naive-Bayes model over character trigrams of the whole text:

* text normalisation (JVM): lower case, every run of non-letters -> one space,
  padded with a space at both ends; grams = all 3-code-point windows, packed
  into one long each and counted per text or class in numpy (Arrow batches);
* training = counts per (lang, gram) over labelled texts, Laplace smoothing
  over the joint gram vocabulary, document priors;
* the model is one row per gram with an array of class weights; a text's
  distinct grams are looked up and summed class by class.  They lie in one
  task, so the partial aggregate leaves one row per text to shuffle.  Beyond
  the broadcast limit they are joined on (gram, salt), so a gram of every
  text is dealt over many tasks.

No profile truncation: grams absent from a class get that class's smoothed
"unseen" log-probability, which is exact for the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators.phrases import SLICE_ROWS, texts_of
from feedlens.session import ship_package, stored_table

BROADCAST_BYTES = 64 << 20      # estimated size of the weights up to which they are broadcast
SALTS = 16
COUNT_CODES = 1 << 20           # trigrams of texts counted together
OUT_ROWS = 1 << 16              # rows of one output batch
CLASS_BLOCK = 64                # classes of one array; more classes are scored block by block


@dataclass
class Model:
    """``profile`` (lang, code, gram, count) as a stored table; ``classes``: (lang, prior, unseen); ``grams``: vocabulary size."""
    profile: DataFrame
    classes: list[tuple[str, float, float]]
    grams: int

    def weights(self, classes: list[str]) -> DataFrame:
        """(code, w): log P(gram|lang) - unseen(lang) for each of ``classes``, 0 where a class has no such gram."""
        return self.profile.groupBy("code").agg(F.array(*[
            F.coalesce(F.max(F.when(F.col("lang") == c, F.log1p(F.col("count")))), F.lit(0.0)) for c in classes]).alias("w"))


def normalized(text) -> Column:
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    t = F.regexp_replace(t, r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.regexp_replace(t, r"^ +| +$", ""), F.lit(" "))


def gram_codes(text: str) -> np.ndarray:
    """All 3-character windows of a normalised text, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


def _count_by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, held as the distinct grams of each class and at most ``COUNT_CODES`` more windows."""
    counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    fresh: dict[str, list[np.ndarray]] = {}

    def count() -> None:
        for lang, parts in fresh.items():
            new = np.unique(np.concatenate(parts), return_counts=True)
            counted[lang] = _merged([counted[lang], new]) if lang in counted else new
        fresh.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in counted.items():
            for i in range(0, len(codes), OUT_ROWS):
                c = codes[i:i + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c)), pa.array(c), pa.array([_gram(x) for x in c.tolist()]), pa.array(counts[i:i + OUT_ROWS])],
                    names=["lang", "code", "gram", "count"])
        counted.clear()

    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            for lang, text in zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]):
                codes = gram_codes(text)
                fresh.setdefault(lang, []).append(codes)
                held += len(codes)
                if held > COUNT_CODES:
                    count()
                    held = 0
                    if sum(len(c) for c, _ in counted.values()) > COUNT_CODES:
                        yield from out()
    count()
    yield from out()


def _count_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, codes, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0

        def out() -> pa.RecordBatch:
            rows = np.repeat(np.array([i for i, _ in at], np.int64), np.array([n for _, n in at], np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(rows)), pa.array(np.concatenate(codes)), pa.array(np.concatenate(counts))],
                names=[batch.schema.names[1], "code", "cnt"])

        for i, text in enumerate(texts_of(batch)):
            u, n = np.unique(gram_codes(text), return_counts=True)
            at.append((i, len(u)))
            codes.append(u)
            counts.append(n)
            held += len(u)
            if held > 1 << 18:
                yield out()
                at, codes, counts, held = [], [], [], 0
        if at:
            yield out()


def train_profile(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, gram, count) over the labelled texts: counted per batch, summed over all tasks."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), normalized(text_col).alias("t"))
    return (rows.mapInArrow(_count_by_class, "lang string, code long, gram string, count long")
            .groupBy("lang", "code", "gram").agg(F.sum("count").alias("count")))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the rows of ``docs`` with a label.  The driver sees one row per class."""
    profile = stored_table(train_profile(docs, text_col, lang_col), "lang-profile")
    vocab = profile.select(F.count_distinct("code")).first()[0]
    n_docs = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("d"))
    total = n_docs.select(F.sum("d")).scalar()
    classes = (profile.groupBy("lang").agg(F.sum("count").alias("n")).join(n_docs, "lang")
               .select("lang", F.log(F.col("d") / total).alias("prior"), (-F.log(F.col("n") + vocab)).alias("unseen")))
    return Model(profile, sorted((r.lang, r.prior, r.unseen) for r in classes.collect()), vocab)


def _scores(posts: DataFrame, model: Model, classes: list[tuple[str, float, float]], text_col: str, id_col: str,
            limit: int) -> DataFrame:
    """(id, best): the best (score, lang) among ``classes`` of every text with a trigram."""
    w = model.weights([c for c, _, _ in classes])
    kind = posts.schema[id_col].dataType.simpleString()
    counted = posts.select(normalized(text_col).alias("t"), id_col).mapInArrow(_count_by_text, f"`{id_col}` {kind}, code long, cnt long")
    if model.grams * (8 * len(classes) + 48) <= limit:
        rows = counted.join(F.broadcast(w), "code", "left")
    else:
        counted = counted.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        w = w.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        rows = counted.join(w, ["code", "salt"], "left")
    times = F.col("cnt")
    sums = rows.groupBy(id_col).agg(F.sum(times).alias("n"), *[
        F.coalesce(F.sum(times * F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(len(classes))])
    found = [F.struct((F.col(f"s{i}") + F.col("n") * unseen + prior).alias("score"), F.lit(c).alias("lang"))
             for i, (c, prior, unseen) in enumerate(classes)]
    return sums.select(id_col, (F.greatest(*found) if len(found) > 1 else found[0]).alias("best"))


def detect(posts: DataFrame, model: Model, text_col: str = "text", id_col: str = "seq",
           out_col: str = "lang", min_len: int = 0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``out_col`` = most probable class; null for texts shorter than
    ``min_len`` or without any trigram (caller decides: keep or drop) and where the
    model has no class.  Any number of classes and grams."""
    blocks = [model.classes[i:i + CLASS_BLOCK] for i in range(0, len(model.classes), CLASS_BLOCK)]
    if not blocks:
        return posts.withColumn(out_col, F.lit(None).cast("string"))
    best = _scores(posts, model, blocks[0], text_col, id_col, broadcast_bytes)
    for b in blocks[1:]:
        best = best.unionByName(_scores(posts, model, b, text_col, id_col, broadcast_bytes))
    if len(blocks) > 1:
        best = best.groupBy(id_col).agg(F.max("best").alias("best"))
    out = posts.join(best.select(id_col, F.col("best.lang").alias(out_col)), id_col, "left")
    if min_len:
        out = out.withColumn(out_col, F.when(F.length(text_col) < min_len, F.lit(None)).otherwise(F.col(out_col)))
    return out


def cross_validated(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                    out_col: str = "pred", folds: int = 2) -> DataFrame:
    """Every row scored by a model that has not seen its fold (id modulo ``folds``; a null id is fold 0)."""
    fold = F.coalesce(F.pmod(F.col(id_col), F.lit(folds)), F.lit(0))
    parts = [detect(docs.where(fold == k), fit(docs.where(fold != k), text_col, lang_col), text_col, id_col, out_col)
             for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accuracy(pred: DataFrame, truth_col: str = "content_type", pred_col: str = "lang") -> DataFrame:
    """Per true class: documents, correctly predicted, accuracy."""
    return (pred.groupBy(F.col(truth_col).alias("true_lang"))
            .agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col(truth_col) == F.col(pred_col)).alias("correct"))
            .withColumn("accuracy", F.col("correct") / F.col("docs")))


def source_language_filter(posts: DataFrame, model, language: str = "en", min_len: int = 21,
                           text_col: str = "text", id_col: str = "seq") -> DataFrame:
    """Collector-side filter: only texts of at least ``min_len`` characters are
    checked; a text the model cannot classify is kept (opposite of the merge rule)."""
    d = detect(posts, model, text_col, id_col, out_col="_lang")
    keep = (F.length(text_col) < min_len) | F.col("_lang").isNull() | (F.col("_lang") == language)
    return d.where(keep).drop("_lang")
