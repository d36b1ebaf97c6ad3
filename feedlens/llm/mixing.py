"""op4: a low-discrepancy mix of sources at target weights.

Golden-ratio points u_i = frac(i * 0.618...) mapped through the cumulative targets name
the source of slot i; slots are ranked per source; each source's documents, shuffled by
id hash and laid end to end, are cut into blocks of equal token counts; slot k of a
source takes its block k, starting over after the last (up to three passes).  The block
that reaches the target is cut short, so each source takes its target to the token;
blocks without a slot are not taken.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import numbered, pick, prepare, stored

BLOCK = 4096            # tokens per slot
GOLDEN = 0.6180339887498949
CHUNK = 1 << 16         # slots ranked together
CELLS = 4096            # parts of [0, 1) by which points meet the bands of the sources
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): weights repeat in code-point
    order of the names (null last), targets share the whole size, none above ``most`` times its
    source's size; what is above is shared again by weight.

    Works on one row per source.  With caps sorted by cap/weight the capped sources are a
    prefix; the level of the others is (total - caps before) / (weights from here on)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rest = (F.sum("source_size").over(whole)
            - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    level = rest / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))  # the first that is not capped
    s = s.withColumn("level", F.min(fits).over(whole)["level"])
    return s.select("source", "source_size", "weight",
                    F.least("cap", F.col("weight") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def schedule(goals: DataFrame, block: int = BLOCK, factor: int = 4) -> DataFrame:
    """(source, rank, slot): point ``slot`` of the sequence gives its source the block of that rank; every
    source gets exactly the blocks its goal needs.  ``goals`` has one row per source (source, goal).

    The sources' bands of [0, 1) are their shares of the blocks, so the first as many points as
    blocks serve nearly all of them; the few left are served by further points (a band of a
    share p is met again within some 2.6 / p points, hence ``factor``; doubled if ever too few)."""
    live = goals.where("goal > 0").select("source", F.ceil(F.col("goal") / block).alias("need"))
    by = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.sum("need").over(by) / F.sum("need").over(Window.partitionBy())
    bands = stored(live.select("source", "need", share.alias("hi")).select(
        "source", "need", F.lag("hi", 1, 0.0).over(by).alias("lo"),
        F.when(F.lead("hi").over(by).isNull(), 2.0).otherwise(F.col("hi")).alias("hi")), "bands")
    n = bands.agg(F.sum("need")).first()[0] or 0
    cells = bands.withColumn("cell", F.explode(F.expr(f"sequence(cast(lo * {CELLS} as int), cast(least(hi, 1D) * {CELLS} as int))")))
    while True:
        u = (F.col("id") * F.lit(GOLDEN)) % 1.0
        ids = goals.sparkSession.range(1, int(n) * factor + 1).select(F.col("id").alias("slot"), u.alias("u"),
                                                                      (u * CELLS).cast("int").alias("cell"))
        named = ids.join(cells, "cell").where("lo <= u and u < hi").select(
            "slot", "source", "need", (F.col("slot") / CHUNK).cast("long").alias("chunk"))
        named = stored(named, "slots")
        per = named.groupBy("source", "need", "chunk").agg(F.count("*").alias("n"))
        met = per.groupBy("source", "need").agg(F.sum("n").alias("n")).where("n >= need").agg(F.sum("need")).first()[0] or 0
        if met == n:
            break
        factor *= 2
    before = per.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    here = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = named.withColumn("r", here).join(before, F.expr("source <=> s2 and chunk = c2"))
    return ranked.where("r + o < need").select("source", (F.col("r") + F.col("o")).alias("rank"), "slot")


def first_words():
    """UDF (text, n): the text up to the end of its n-th word."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, counts):
            last = next(islice(re.finditer(WORD, t), int(n) - 1, None), None)
            out.append(t if last is None else t[:last.end()])
        return pd.Series(out, dtype=object)
    return cut


def mix(docs: DataFrame, block: int = BLOCK, passes: int = 3) -> DataFrame:
    """One row per input row: doc_id, source, tkey, size (words), source_size, target, taken, first_slot.

    A block is taken only where a slot of the schedule names it: ``taken`` counts the words that the
    mix takes of the row through its slots, repeats included (at most ``passes`` times its size);
    ``first_slot`` is the first slot that takes it, null if none does; in slot order the rows are mixed.
    A row that the goal cuts gives its first words.  Null text has size 0; null source is a source of its own, last; repeated rows have their
    own place; an empty table gives an empty result; extra columns are ignored.  Shuffling
    is by id hash, so reruns agree."""
    prepare(docs.sparkSession)
    d = pick(docs, doc_id="long", text="string", source="string")
    d = d.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"),
                 F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = d.withColumn("mixed", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")))
    laid = stored(numbered(d, ["source", "mixed", "doc_id", "tkey"], {"before": "size"}, "row"), "laid")
    per = laid.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("first"))
    goals = stored(targets(per.select("source", "source_size"), most=passes)
                   .withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * passes)), "goals")
    slots = schedule(goals.select("source", "goal"), block)
    src = goals.join(per.select(F.col("source").alias("s2"), "first"), F.expr("source <=> s2")).drop("s2").withColumnRenamed(
        "source", "s1")
    at = laid.join(src, F.expr("source <=> s1")).drop("s1")
    # every stay of a document in a block, in each pass that the goal reaches
    begin = F.col("before") - F.col("first")
    runs = (at.where("size > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
            .withColumn("a", begin + F.col("p") * F.col("source_size"))
            .withColumn("z", F.least(F.col("a") + F.col("size"), F.col("goal"))).where("z > a")
            .withColumn("rank", F.explode(F.expr(f"sequence(a div {block}, (z - 1) div {block})")))
            .withColumn("words", F.expr(f"least(z, (rank + 1) * {block}) - greatest(a, rank * {block})")))
    s = slots.withColumnRenamed("source", "s2").withColumnRenamed("rank", "r2")
    took = (runs.select("row", "source", "rank", "words").join(s, F.expr("source <=> s2 and rank = r2"))
            .groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot")))
    return (at.join(took, "row", "left")
            .select("doc_id", "source", "tkey", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"))
