"""Words and their CRCs straight from Arrow's UTF-8 buffers, many at a time.

Bytes are classified by a table of 256; words begin and end where the classes of neighbouring bytes (or of a row's ends) differ. The CRC-32
of all words of a piece advances together, a byte of each at a step, through the table of the CRC's automaton; the state that stands after a word is
carried over a space into the next one, so that runs of several words need no text of their own. Words longer than ``STEPS`` end through zlib, which has the same table.

Bounds: a piece holds whole rows of about ``PIECE`` bytes, or part of a longer row that ends between words (one longer word is held whole).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Bytes of a word that advance together with those of other words.
STEPS = 48
FULL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    """The automaton's step for each byte: eight divisions by the reflected polynomial of CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


TABLE = _table()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each row begins and ends in them; null rows are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, raw = column.buffers()
    if not len(column) or raw is None:
        none = np.zeros(len(column), np.int64)
        return np.zeros(0, np.uint8), none, none
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    begin, end = at[:-1], at[1:]
    if column.null_count:
        end = np.where(np.asarray(column.is_valid()), end, begin)
    return np.frombuffer(raw, np.uint8), begin, end


def pieces(begin: np.ndarray, end: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Rows [a, b) whose bytes come to about ``limit``; a longer row is alone."""
    a, n = 0, 0
    for i, size in enumerate((end - begin).tolist()):
        if i > a and n + size > limit:
            yield a, i
            a, n = i, 0
        n += size
    if a < len(begin):
        yield a, len(begin)


class Words(NamedTuple):
    """data: the folded bytes; at, size, row: of each word; known: how many of the first words an earlier piece had (as context of runs)."""

    data: np.ndarray
    at: np.ndarray
    size: np.ndarray
    row: np.ndarray
    known: int


class Automaton:
    """is_word: whether each byte belongs to words; fold: what each byte counts as."""

    def __init__(self, is_word: np.ndarray, fold: np.ndarray | None = None, limit: int = PIECE):
        self.is_word, self.fold, self.limit = is_word, np.arange(256, dtype=np.uint8) if fold is None else fold, limit

    def found(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, size, row) of the words of rows that lie one after the other in raw; at counts from the first row's beginning."""
        first = int(begin[0])
        on = self.is_word[raw[first : int(end[-1])]]
        starts, ends = np.zeros(len(on), bool), np.zeros(len(on), bool)
        starts[1:] = on[1:] & ~on[:-1]
        ends[:-1] = on[:-1] & ~on[1:]
        some = end > begin
        a, b = begin[some] - first, end[some] - first - 1
        starts[a], ends[b] = on[a], on[b]
        at = np.flatnonzero(starts)
        row = np.flatnonzero(some)[np.searchsorted(a, at, "right") - 1] if len(at) else at
        return at, np.flatnonzero(ends) + 1 - at, row

    def words(self, column: pa.Array, order: int = 1) -> Iterator[Words]:
        """The words of a column piece by piece; a row that is cut brings its last ``order`` - 1 words again."""
        raw, begin, end = texts(column)
        for a, b in pieces(begin, end, self.limit):
            if b > a + 1 or end[a] - begin[a] <= self.limit:
                at, size, row = self.found(raw, begin[a:b], end[a:b])
                yield Words(self.fold[raw[begin[a] : end[b - 1]]], at, size, row + a, 0)
                continue
            lo, hi, known = int(begin[a]), int(end[a]), 0
            context = lo
            while lo < hi:
                upto = min(hi, lo + self.limit)
                while upto < hi and (on := self.is_word[raw[upto : min(hi, upto + self.limit)]]).size:
                    gap = int(np.argmin(on))
                    upto += gap if not on[gap] else len(on)
                    if not on[gap]:
                        break
                at, size, row = self.found(raw, np.array([context]), np.array([upto]))
                yield Words(self.fold[raw[context:upto]], at, size, row + a, known)
                known = min(order - 1, len(at))
                context, lo = (context + int(at[-known]) if known else upto), upto

    def runs(self, column: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, rows, CRCs) of all runs of k = 1 to ``order`` words joined by one space."""
        for w in self.words(column, order):
            if not len(w.at):
                continue
            step, state = Advance(w), np.full(len(w.at), FULL)
            for k in range(1, order + 1):
                if k > 1:
                    if len(state) < k:
                        break
                    before = state[:-1]
                    state[1:] = TABLE[(before ^ np.uint32(32)) & np.uint32(255)] ^ (before >> np.uint32(8))
                state = step(state)
                last = np.arange(max(k - 1, w.known), len(w.at))
                last = last[w.row[last - (k - 1)] == w.row[last]]
                yield k, w.row[last], state[last] ^ FULL


class Advance:
    """Takes states of the CRC, one a word, through the words' bytes, the longest words first, so that those still going are always the first ones."""

    def __init__(self, w: Words):
        size = np.minimum(w.size, STEPS).astype(np.int16)
        self.by = np.argsort(-size, kind="stable")
        self.going = len(size) - np.cumsum(np.bincount(size, minlength=STEPS + 1))
        self.at = w.at[self.by]
        self.bytes = [w.data[self.at[:n] + k] for k, n in enumerate(self.going[:STEPS]) if n]
        self.data, self.size = w.data, w.size[self.by[: int((w.size > STEPS).sum())]]

    def __call__(self, state: np.ndarray) -> np.ndarray:
        c = state[self.by]
        for b in self.bytes:
            now = c[: len(b)]
            c[: len(b)] = TABLE[(now ^ b) & np.uint32(255)] ^ (now >> np.uint32(8))
        for i, n in enumerate(self.size.tolist()):
            at = int(self.at[i])
            c[i] = zlib.crc32(self.data[at + STEPS : at + n], int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out = np.empty_like(c)
        out[self.by] = c
        return out
