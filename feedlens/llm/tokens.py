"""Token ids by the ``tokenizers`` library, with a bounded memo of the pieces of texts.

Texts are cut where no tokenizer rule can reach across: before a space or newline that
follows a visible character.  Each distinct piece is encoded by the library once per
worker; a text's ids are the ids of its pieces in order.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from feedlens.llm.words import PIECE, span_hashes

MEMO = 2_500_000        # pieces kept per worker (about 120 MB); the memo starts anew beyond
BATCH = PIECE           # bytes of text handled together
_CUT = re.compile(rb"[!-~][ \n]")
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True   # their strings in a text are ordinary text
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.len = np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        size, new = np.zeros(len(pieces), np.int64), []
        for lo in range(0, len(pieces), 2000):
            ids = [e.ids for e in self.tok.encode_batch_fast(pieces[lo:lo + 2000], add_special_tokens=False)]
            size[lo:lo + len(ids)] = np.fromiter(map(len, ids), np.int64, len(ids))
            new.append(np.fromiter(chain.from_iterable(ids), np.int32))
        at = self.used + np.cumsum(size) - size
        stop = self.used + int(size.sum())
        if stop > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), stop - len(self.pool)), np.int32)])
        self.pool[self.used:stop] = np.concatenate(new)
        self.used = stop
        place = np.searchsorted(self.keys, keys)      # both ascending
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.len = np.insert(self.len, place, size)

    def _encode_buffer(self, raw: bytes, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a buffer and the ids before each of its ``heads`` (starts of texts, ascending)."""
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(heads), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        seen = _VISIBLE[buf]
        seen[1:] |= (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5)   # second byte of a two-byte letter
        head = np.zeros(len(buf), bool)
        np.logical_and(seen[:-1], _GAP[buf[1:]], out=head[1:])
        head[heads[heads < len(buf)]] = head[0] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(buf))
        h = span_hashes(buf, starts, ends)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > MEMO:
            self._clear()
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        if not known.all():
            todo = first[~known]
            self._learn(uniq[~known], [raw[starts[j]:ends[j]].decode("utf-8", "replace") for j in todo])
            at = np.searchsorted(self.keys, uniq)
        size = self.len[at][inverse].astype(np.int64)
        stop = np.cumsum(size)
        begin = stop - size
        ids = self.pool[np.repeat(self.at[at][inverse] - begin, size) + np.arange(stop[-1])]
        before = np.append(begin, stop[-1])[np.searchsorted(starts, heads)]
        return ids, before

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; texts are handled together up to BATCH bytes, longer ones in pieces."""
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        lo = 0
        while lo < len(raws):
            hi, size = lo, 0
            while hi < len(raws) and (hi == lo or size + len(raws[hi]) <= BATCH):
                size += len(raws[hi])
                hi += 1
            if hi == lo + 1 and size > BATCH:
                yield self._encode_long(raws[lo])
            else:
                heads = np.cumsum([0] + [len(r) for r in raws[lo:hi]])
                ids, before = self._encode_buffer(b"".join(raws[lo:hi]), heads)
                for j in range(hi - lo):
                    yield ids[before[j]:before[j + 1]]
            lo = hi

    def _encode_long(self, raw: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(raw):
            m = _CUT.search(raw, at + BATCH)
            end = m.start() + 1 if m else len(raw)
            out.append(self._encode_buffer(raw[at:end], np.zeros(1, np.int64))[0])
            at = end
        return np.concatenate(out)
