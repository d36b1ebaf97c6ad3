"""Keyword tables of any size against texts in one pass (J3): an Aho-Corasick automaton over Arrow batches.

The automaton of a block of keywords is built once per worker; every text is read once and each
hit is checked for word boundaries where it lies, so a text is never copied per keyword, shuffled
or searched by pattern.  Tables beyond a block's size are dealt into blocks by hash, one pass each.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.session import ship_package

BLOCK_CHARS = 2 << 20       # characters of the keywords of one automaton (about 100 bytes each)
FLUSH = 50_000              # hits of one output batch
SLICE_ROWS = 64             # texts of a batch that are Python strings at a time
_automata: dict[str, object] = {}


@lru_cache(1 << 16)
def _word(ch: str) -> bool:
    """Python's and the patterns' word characters: letters, numbers, underscore."""
    return ch == "_" or unicodedata.category(ch)[0] in "LN"


def automaton(name: str, block):
    """The automaton of a broadcast block of keywords, kept per worker."""
    if name not in _automata:
        import ahocorasick
        a = ahocorasick.Automaton()
        for i, k in enumerate(block.value):
            a.add_word(k, (i, len(k), _word(k[0]), _word(k[-1])))
        a.make_automaton()
        _automata.clear()
        _automata[name] = a
    return _automata[name]


def hits(a, text: str) -> set[int]:
    """Numbers of the keywords that occur in ``text`` between word boundaries (``\\b`` at a non-word character
    asks for a word character beyond it)."""
    found: set[int] = set()
    last = len(text) - 1
    for end, (i, size, starts, ends) in a.iter(text):
        if i not in found:
            before = end >= size and _word(text[end - size])
            after = end < last and _word(text[end + 1])
            if before != starts and after != ends:
                found.add(i)
    return found


def texts_of(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of the first column, a slice at a time."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield from batch.column(0).slice(at, SLICE_ROWS).to_pylist()


def _matcher(name: str, block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(name, block)
        for batch in batches:
            at, words = [], []

            def out() -> pa.RecordBatch:
                kept = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(1, batch.num_columns)]
                return pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.string())], names=[*batch.schema.names[1:], "keyword"])

            for i, text in enumerate(texts_of(batch)):
                for k in hits(a, text) if text and len(a) else ():
                    at.append(i)
                    words.append(block.value[k])
                if len(at) >= FLUSH:
                    yield out()
                    at, words = [], []
            yield out()
    return run


def _blocks(posts: DataFrame, keywords, size: int) -> Iterator[list[str]]:
    if not isinstance(keywords, DataFrame):
        keywords = posts.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string")
    kw = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    n = max(1, -(-(kw.agg(F.sum(F.length("keyword"))).first()[0] or 0) // size))
    for b in range(n):
        yield [r[0] for r in kw.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == b).collect()]


def tag(posts: DataFrame, keywords, cols: list[str], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (``cols``, keyword) per post and distinct keyword in it; ``keywords``: a list or a table (keyword).

    Keywords are compared in lower case; null and empty ones match nothing, repeated ones count once."""
    ship_package(posts.sparkSession)
    low = posts.select(F.lower("text").alias("_text"), *cols)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in low.schema.fields[1:]] + ["keyword string"])
    out = None
    for words in _blocks(posts, keywords, block_chars):
        part = low.mapInArrow(_matcher(uuid.uuid4().hex, posts.sparkSession.sparkContext.broadcast(words)), schema)
        out = part if out is None else out.unionByName(part)
    return out
