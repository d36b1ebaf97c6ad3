"""One-pass walk of comment trees (X6): JSON text of a Listing or a t1 node -> one row per comment.

Every tree is parsed once and walked in preorder with an explicit stack inside an Arrow batch
function; a comment is handed on without its replies, so what is stored or shuffled afterwards
grows with the comments, not with their nesting.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa

ROW = "pos long, depth long, id string, body string, permalink string, score long, created double"
_TOKEN = re.compile(r'[\s,:]*(?:([\[{\]}])|("(?:[^"\\]|\\.)*")|([^\s,:\[\]{}"]+))', re.S)
FLUSH = 10_000      # comments of one output batch


def parse_nested(text: str):
    """JSON of any nesting depth (the standard parser stops at some thousand levels): containers on a stack.
    Separators are not checked; unbalanced text is an error."""
    root: list = []
    stack, keys, at = [root], [None], 0
    while m := _TOKEN.match(text, at):
        at = m.end()
        mark, string, plain = m.groups()
        if mark in ("]", "}"):
            stack.pop()
            keys.pop()
            if not stack:
                raise ValueError("unbalanced")
            continue
        top = stack[-1]
        if isinstance(top, dict) and keys[-1] is None:
            keys[-1] = json.loads(string or "")
            continue
        value = {} if mark == "{" else [] if mark == "[" else json.loads(string or plain)
        if isinstance(top, dict):
            top[keys[-1]] = value
            keys[-1] = None
        else:
            top.append(value)
        if mark:
            stack.append(value)
            keys.append(None)
    if len(stack) != 1 or len(root) != 1 or text[at:].strip():
        raise ValueError("not one JSON value")
    return root[0]


def parse(text: str | None):
    """The JSON value, or None where the text is none."""
    try:
        return json.loads(text or "null")
    except RecursionError:
        try:
            return parse_nested(text)
        except ValueError:
            return None
    except ValueError:
        return None


def _get(node, *keys):
    for k in keys:
        node = node.get(k) if isinstance(node, dict) else None
    return node


def _text(x) -> str:
    return x if isinstance(x, str) else "" if x is None or isinstance(x, (dict, list)) else json.dumps(x)


def _whole(x) -> int:
    if isinstance(x, str) and re.fullmatch(r"\s*[+-]?\d{1,18}\s*", x):
        return int(x)
    if isinstance(x, float) and abs(x) < 2 ** 63 or isinstance(x, int) and -2 ** 63 <= x < 2 ** 63:
        return int(x)
    return 0


def _number(x) -> float | None:
    try:
        return float(x) if isinstance(x, (int, float, str)) else None
    except (ValueError, OverflowError):
        return None


def comments(tree) -> Iterator[tuple]:
    """(depth, data) of the t1 nodes in preorder; children of other kinds are passed over with what is below them."""
    kids = [tree] if _get(tree, "kind") == "t1" else _get(tree, "data", "children") if _get(tree, "kind") == "Listing" else None
    stack = [(0, k) for k in reversed(kids)] if isinstance(kids, list) else []
    while stack:
        depth, node = stack.pop()
        if _get(node, "kind") != "t1":
            continue
        yield depth, node.get("data")
        below = _get(node, "data", "replies", "data", "children")
        if isinstance(below, list):
            stack.extend((depth + 1, k) for k in reversed(below))


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (JSON text, carried columns) -> carried columns of the tree and ROW of each comment."""
    for batch in batches:
        rows, at = [], []

        def out() -> pa.RecordBatch:
            carried = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(1, batch.num_columns)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            return pa.RecordBatch.from_arrays(carried + made, names=batch.schema.names[1:] + [
                f.split(" ")[0] for f in ROW.split(", ")])

        for i, text in enumerate(batch.column(0).to_pylist()):
            for pos, (depth, d) in enumerate(comments(parse(text))):
                rows.append((pos, depth, _text(_get(d, "id")), html.unescape(_text(_get(d, "body"))), _text(_get(d, "permalink")),
                             _whole(_get(d, "score")), _number(_get(d, "created_utc"))))
                at.append(i)
                if len(rows) >= FLUSH:
                    yield out()
                    rows, at = [], []
        yield out()
