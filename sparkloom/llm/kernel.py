"""Vectorised text kernel: words and word hashes of whole Arrow string columns, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_PERIOD = 4096
_rng = np.random.Generator(np.random.PCG64(20240229))
_WEIGHT = _rng.integers(1, 2**63, _PERIOD, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a run of texts. ``doc[i]:doc[i+1]`` are the words of text ``i``; ``start``/``end`` are byte positions in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    text_start: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        for a, b in _slices(self.start, self.end):
            s, e = self.start[a:b], self.end[a:b]
            n = e - s
            first = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(first, n)
            at = np.repeat(s, n) + inside
            weight = _WEIGHT[inside if int(n.max()) <= _PERIOD else inside % _PERIOD]
            h = np.add.reduceat((self.data[at].astype(np.uint64) + _U(1)) * weight, first)
            out[a:b] = mix(h + n.astype(np.uint64) * _GOLD)
        return out


def _slices(start: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of words of about ``most`` bytes together."""
    a, n = 0, len(start)
    while a < n:
        b = max(a + 1, int(np.searchsorted(end, start[a] + most, "right")))
        yield a, b
        a = b


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, pa.Array]]:
    """``(first, last, slice)`` of the texts (null: empty), each run holding about ``most`` bytes or one text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b, texts.slice(a, b - a)
        a = b


def words(texts: pa.Array) -> Words:
    """Words (maximal runs without ASCII white space) of a slice that ``chunks`` made."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    solid = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, off), off[:-1])


_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbouring word hashes, across text borders too; empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _STEP[j % 64] + (_U(j) ^ _GOLD)
    return mix(out)


def text_hash(value: str) -> int:
    """The hash that ``Words.hashes`` gives for a single word."""
    (_, _, part), = chunks(pa.array([value]))
    return int(words(part).hashes()[0])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "\"'()[]{}<>.,;:!?*#&%$|"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and of Latin-1 made small."""
    out = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[at]
    at = at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    out[at] += 32
    return out


def trimmed(w: Words, times: int = 4) -> Words:
    """Words without marks at their ends; of a word that is all marks the last one stays."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(times):
        end -= _EDGE[w.data[end - 1]] & (end - start > 1)
    for _ in range(2):
        start += _EDGE[w.data[start]] & (end - start > 1)
    return Words(w.data, start, end, w.doc, w.text_start)


def capital(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a capital of ASCII or Latin-1 stands at each position."""
    first = data[at]
    second = data[np.minimum(at + 1, len(data) - 1)]
    return _UPPER[first] | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)


def text_of_word(w: Words) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))


def row_hash(*columns: Column) -> Column:
    """A hash of values that also tells which of them are null."""
    return F.xxhash64(F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns]), *columns)


def keyed(rows: DataFrame, **keys: Column) -> DataFrame:
    """The named ``keys`` and ``row``, a struct of all columns of ``rows``: helper columns cannot clash with any of these."""
    return rows.select(*[c.alias(k) for k, c in keys.items()], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
