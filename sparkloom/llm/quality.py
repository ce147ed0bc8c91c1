"""Quality by an interpolated modified Kneser-Ney trigram model of trusted text.

Words are what white space parts, with their capitals and marks; each belongs to its document's language, so contexts
never mix languages. The 2**20 most frequent words of the trusted text have codes of their own; rarer ones, and words
that it lacks, are hashed to as many other codes, where words that share a code count as one. A word that repeats the
one before it is another word as a prediction, though not as a context. Each text ends with an end mark. Three codes
make one 63-bit key, and the model counts every token.

The model is counted over all trusted documents and kept as tables, never on one machine. It is brought into back-off
form: each n-gram of the model has a weight, and a text's log-probability is the sum of the weights of the n-grams in it,
so n-grams that the model lacks need no answer. Tables by word code have 2**21 rows at most and are broadcast; the driver
keeps what they are made of packed, and unpacks a range of codes at a time. Pairs and
triples are scored by a sharded count join: blocks of documents become postings (n-gram, documents, times), packed and
dealt by the n-gram's shard; each shard meets its part of the model and sends each block's sums back. N-grams that a
hundredth of a sample of documents hold would all meet in one task, so their weights are looked up once where the model
lies and broadcast (COMMON at most); the sample decides only where they are added up, never the result. Within a shard, n-grams are told
apart by 32 bits of their hash: as a shard's part of the model is bounded, an n-gram that it lacks is taken for another
one with a chance below one in a thousand. Weights are rounded to thousandths.

Triples and pairs take far more room than the text, so none travels as a row: the model's are dealt twice, by the pair at
their end and by the context at their beginning, as packed blocks of sorted keys that a task merges for a shard of bounded
size. Scoring goes PASSES times over the documents, each time for some of the shards, whose part of the model is deleted
after it; so a later pass has room for more shards and takes them. Shuffle files are deleted as soon as a step is stored, and
broadcasts after their last use.

A document is kept if its perplexity is at most its language's threshold, a
quantile of the perplexities of trusted documents that the model has not seen: it is counted over those whose hashed id
falls in the first HELD - 1 of HELD parts, and the rest sets the thresholds. Which quantile is fitted in each language on
documents of the same part that a label calls bad: the share of trusted documents kept plus the share of bad ones
rejected is the largest, and of equals the highest quantile is taken (so without bad ones, the highest). A language
without held-out trusted text uses the threshold fitted over all.

Null texts count as empty. A document without words has no perplexity and is kept. Null languages are a language of
their own. Rows that repeat (in id, language and text, nulls included) get the same score each. Without any trusted
document everything is kept. Extra columns, of any name, are left alone. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.session import dropped, shuffles_deleted, small_batches, stored

BITS = 21
MASK, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Codes of known words are 1 to KNOWN; the codes above it but for the last are for hashed words; the last is the end mark.
KNOWN, END = 1 << (BITS - 1), (1 << BITS) - 1
#: Words whose distinct keys a task merges before it passes them on; n-grams in a block of postings; bytes of text a shard serves.
MERGED, BLOCK, BYTES_A_SHARD = 1_000_000, 600_000, 16 << 20
#: Common n-grams: looked for in a sample of about so many documents, in one of HUNDREDTH of which they are; at most COMMON.
SAMPLE, HUNDREDTH, COMMON = 4_000, 100, 200_000
#: Times that scoring reads the documents, of texts beyond SMALL bytes; below, once, which differs in the room taken, not in the result.
PASSES, SMALL = 3, 64 << 20
#: How many times the shards of the pass before it a pass has: a pass's files take about five times the room of its shards' part of the model.
LARGER = 1.2
#: Ranges of word codes whose tallies one task adds up.
RANGES = 16
#: Threshold: the one of these quantiles of the held-out trusted documents that parts them best from the held-out bad ones.
QUANTILES = [0.9, 0.95, 0.98, 0.99, 0.995]
#: One of so many parts of the trusted documents is held out from the model for the thresholds.
HELD = 5
_AGAIN = np.uint64(K.text_hash("<again>"))
#: Marks a pair among keys of triples.
_IS_PAIR = np.uint64(1 << 63)


def hashed(texts: pa.Array, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash of each word with its text's language; whether it repeats the one before it; the words of each text."""
    w = K.words(texts)
    n = len(w.start)
    sizes = np.diff(w.doc)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool), sizes
    code = {x: np.uint64(K.text_hash("lang=" + x) if x is not None else 0) for x in set(langs)}
    h = K.mix(w.hashes() ^ np.repeat(np.array([code[x] for x in langs], np.uint64), sizes))
    again = np.zeros(n, bool)
    again[1:] = h[1:] == h[:-1]
    again[w.doc[:-1][sizes > 0]] = False
    return h, again, sizes


class Places:
    """Where hashes stand in a sorted array of evenly spread hashes: their first 20 bits lead to the few that share them."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.begin = np.searchsorted(known, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)) if len(known) else None
        if len(known):
            self.begin[-1] = len(known)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it is not there."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.known) or not len(h):
            return out
        top = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.begin[top], self.begin[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.known[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def codes(h: np.ndarray, known: Places) -> np.ndarray:
    """Codes of word hashes; ``known`` are the hashes that have one of their own."""
    at = known(h)
    return np.where(at >= 0, at + 1, (h % np.uint64(KNOWN - 3)).astype(np.int64) + KNOWN + 1)


class Tokens:
    """The tokens of a run of texts, end marks included: for each its text, the codes before it, its own and the predicted one, and whether it repeats."""

    def __init__(self, texts: pa.Array, langs: list[str | None], known: Places):
        h, again, sizes = hashed(texts, langs)
        have = sizes > 0
        self.words = sizes
        longer = sizes + have
        at = np.arange(len(h)) + np.repeat(np.cumsum(have) - 1, sizes)
        self.own = np.full(int(longer.sum()), END, np.int64)
        self.own[at] = codes(h, known)
        self.met, self.again = self.own.copy(), np.zeros(len(self.own), bool)
        self.again[at] = again
        self.met[self.again] = codes(K.mix(h[again] ^ _AGAIN), known)
        self.first = (np.cumsum(longer) - longer)[have]
        self.text = np.repeat(np.arange(len(sizes)), longer)
        self.p1, p2 = np.zeros_like(self.own), np.zeros_like(self.own)
        self.p1[1:] = self.own[:-1]
        self.p1[self.first] = 0
        p2[1:] = self.p1[:-1]
        p2[self.first] = 0
        self.triple = p2 << 2 * BITS | self.p1 << BITS | self.met

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of triples and (marked) pairs, and the text of each: pairs stand for their prediction and for being the next context, so a repeated word and the beginning of a text give one more."""
        pair = lambda a, b: (a << BITS | b).astype(np.uint64) | _IS_PAIR
        r = self.again
        zero = np.zeros(len(self.first), np.int64)
        keys = np.concatenate([self.triple.astype(np.uint64), pair(self.p1, self.met), pair(self.p1[r], self.own[r]), pair(zero, zero)])
        return keys, np.concatenate([self.text, self.text, self.text[r], self.text[self.first]])

    def by_word(self, predicted: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
        """Each text's sum of what its words weigh as predictions and as contexts."""
        value = predicted[self.met] + context[self.p1]
        return np.bincount(self.text, weights=value, minlength=n)


def _planes(a: np.ndarray) -> bytes:
    """Whole numbers byte by byte of all of them; bytes that are 0 in all are left out."""
    n = a.dtype.itemsize
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, n).T)
    there = planes.any(axis=1)
    return bytes([n]) + np.packbits(there).tobytes() + len(a).to_bytes(8, "little") + zlib.compress(planes[there].tobytes(), 1)


def _unplaned(raw: pa.Buffer) -> np.ndarray:
    raw = memoryview(raw)
    n, size = raw[0], int.from_bytes(raw[2:10], "little")
    planes = np.zeros((n, size), np.uint8)
    planes[np.unpackbits(np.frombuffer(raw[1:2], np.uint8))[:n].astype(bool)] = np.frombuffer(zlib.decompress(raw[10:]), np.uint8).reshape(-1, size)
    return np.ascontiguousarray(planes.T).view(f"i{n}").ravel()


def _packed(a: np.ndarray) -> bytes:
    """An ascending array as its differences; long runs take few bytes."""
    return _planes(np.diff(a, prepend=a.dtype.type(0)))


def _unpacked(raw: pa.Buffer) -> np.ndarray:
    a = _unplaned(raw)
    return np.cumsum(a, dtype=a.dtype)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(k)
    k, n = k[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[begin], np.add.reduceat(n, begin) if len(k) else n


def _summed(parts: Iterator[tuple[np.ndarray, np.ndarray]], least: int = 1) -> Iterator[pa.RecordBatch]:
    """Keys with counts (of ``least`` or more), merged as far as memory allows, as batches ``key, n``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        k, n = _merged(held)
        k, n = k[n >= least], n[n >= least]
        for a in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])], names=["key", "n"])

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > MERGED:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > MERGED // 2:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _counted(docs: DataFrame, keys, least: int = 1) -> DataFrame:
    """``key, n``: sums over all texts of ``docs`` (``lang, text``) of the counts that ``keys(texts, langs)`` gives for a run of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                langs = batch.column(0).to_pylist()
                for a, b, part in K.chunks(batch.column(1)):
                    yield np.unique(keys(part, langs[a:b]), return_counts=True)

        yield from _summed(parts(), least)

    return docs.select("lang", F.col("text").cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def known_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the KNOWN most frequent words of ``docs``, repeated ones counted as such too: 8 MB at most."""

    def keys(texts: pa.Array, langs: list[str | None]) -> np.ndarray:
        h, again, _ = hashed(texts, langs)
        return np.concatenate([h, K.mix(h[again] ^ _AGAIN)])

    top = _counted(docs, keys).orderBy(F.col("n").desc(), "key").limit(KNOWN).select("key")
    return np.sort(top.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


_places_of: dict[int, Places] = {}


def _known(known) -> Places:
    """The lookup of a broadcast of known words, made once in a process."""
    if known is None:
        return Places(np.zeros(0, np.uint64))
    found = _places_of.get(0)
    if found is None or found.known is not known.value:
        found = _places_of[0] = Places(known.value)
    return found


def _turned(key: np.ndarray) -> np.ndarray:
    """Keys of triples with their last two codes first."""
    return (key & PAIR) << BITS | key >> 2 * BITS


def _blob(rows: pa.Table | pa.RecordBatch, column: str, i: int) -> pa.Buffer:
    return rows.column(column)[i].as_buffer()


def _dealt(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each shard with its part of the columns, whose order stays."""
    if not len(shard):
        return
    order = np.argsort(shard.astype(np.uint16) if int(shard.max()) < 1 << 16 else shard, kind="stable")
    columns = [c[order] for c in columns]
    for s, a, b in _runs(shard[order]):
        yield s, *[c[a:b] for c in columns]


_COUNTS, _COUNT_TYPES = "shard int, keys binary, counts binary", (pa.int32(), pa.binary(), pa.binary())


def _batch(rows: list[tuple], schema: str, types: Sequence[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)], names=names)


def trigram_counts(docs: DataFrame, shards: int, known=None) -> DataFrame:
    """``shard, keys, counts``: the distinct triples of all tokens of ``docs`` (``lang, text``), turned, and how often each is there; a shard is one row and has all triples of its pairs. ``known``: a broadcast of :func:`known_words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            k = np.sort(np.concatenate(held))
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            n = np.diff(np.append(begin, len(k)))
            k = k[begin]
            return _batch([(s, _packed(own), _planes(times)) for s, own, times in _dealt(_places((k >> BITS).view(np.uint64), shards)[0], k, n)], _COUNTS, _COUNT_TYPES)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, part in K.chunks(batch.column(1)):
                held.append(_turned(Tokens(part, langs[a:b], _known(known)).triple))
                size += len(held[-1])
                if size > MERGED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        k, n = _merged([(_unpacked(_blob(rows, "keys", i)), _unplaned(_blob(rows, "counts", i))) for i in range(rows.num_rows)])
        return pa.Table.from_batches([_batch([(key[0].as_py(), _packed(k), _planes(n))], _COUNTS, _COUNT_TYPES)])

    return docs.select("lang", F.col("text").cast("string")).mapInArrow(run, _COUNTS).groupBy("shard").applyInArrow(merged, _COUNTS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each row of :func:`trigram_counts`: the turned keys, their counts, the pairs, where each begins, and how many triples it has."""
    for b in batches:
        for i in range(b.num_rows):
            k, c = _unpacked(_blob(b, "keys", i)), _unplaned(_blob(b, "counts", i))
            pair = k >> BITS
            begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            yield k, c, pair[begin], begin, np.diff(np.append(begin, len(k)))


def packed_tallies(counts: DataFrame) -> tuple[list[pa.Buffer], np.ndarray]:
    """What :func:`tallies` gives, its first part packed by range of word codes, so that whoever reads it need unpack one range at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((5, 1 << BITS), np.int32), np.zeros(8, np.int64)
        for _, c, pair, _, c2 in _counts(batches):
            v = pair >> BITS
            for j, (code, n) in enumerate([(np.sort(pair & MASK), 1), (v, c2), *[(v[x], 1) for x in (c2 == 1, c2 == 2, c2 > 2)]]):
                begin = np.flatnonzero(np.diff(code, prepend=-1))
                sums[j, code[begin]] += np.add.reduceat(np.broadcast_to(n, len(code)), begin) if len(code) else 0
            seen += [int((x == j).sum()) for x in (c, c2) for j in (1, 2, 3, 4)]
        rows = [(i, _planes(x.ravel())) for i, x in enumerate(np.split(sums, RANGES, axis=1))] if seen.any() or sums.any() else []
        yield _batch([*rows, (RANGES, _planes(seen))], schema, types)

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        total = _unplaned(_blob(rows, "sums", 0)).astype(np.int64)
        for i in range(1, rows.num_rows):
            total += _unplaned(_blob(rows, "sums", i))
        return pa.Table.from_batches([_batch([(key[0].as_py(), _planes(total))], schema, types)])

    schema, types = "range int, sums binary", (pa.int32(), pa.binary())
    t = counts.mapInArrow(run, schema).groupBy("range").applyInArrow(added, schema).toArrow()
    found = {t.column("range")[i].as_py(): _blob(t, "sums", i) for i in range(t.num_rows)}
    none = pa.py_buffer(_planes(np.zeros(5 * (1 << BITS) // RANGES, np.int64)))
    return [found.get(i, none) for i in range(RANGES)], _unplaned(found[RANGES]) if RANGES in found else np.zeros(8, np.int64)


def tallies(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From :func:`trigram_counts`, by word code: the pairs it ends, the triples whose pair it begins, and the pairs it begins that have one, two and more triples. And how many triples are there once to four times, and how many pairs have one to four triples."""
    packed, seen = packed_tallies(counts)
    return np.concatenate([_unplaned(x).reshape(5, -1) for x in packed], axis=1), seen


def _gathered(ranges: Iterator[tuple[np.ndarray, ...]], *kinds: type) -> tuple[np.ndarray, ...]:
    """Whole arrays by word code from their parts by range."""
    size = (1 << BITS) // RANGES
    out = tuple(np.empty(1 << BITS, k) for k in kinds)
    for i, parts in enumerate(ranges):
        for whole, x in zip(out, parts, strict=True):
            whole[i * size : (i + 1) * size] = x
    return out


def _discounts(row) -> list[float]:
    """D1, D2 and D3+ from the numbers of types seen once to four times."""
    n = [max(0, int(x or 0)) for x in row]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [(k + 1) - (k + 2) * y * n[k + 1] / n[k] if n[k] else k + 0.5 for k in range(3)]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


class KneserNey:
    """A model in back-off form: :meth:`weights` by word code, ``base`` for a word it lacks, and ``tables``, whose rows together are the weights of pairs and triples packed for the shards, stored in a part for each turn (``ends`` as in :func:`turns`)."""

    def __init__(self, counts: DataFrame, ends: list[int], scratch: list[str]):
        spark, shards = counts.sparkSession, ends[-1]
        counts = stored(counts)
        self.packed, seen = packed_tallies(counts)
        d3, self.d2 = _discounts(seen[:4]), _discounts(seen[4:])
        d2 = self.d2
        ended = np.zeros(5, np.int64)  # words by the pairs they end: one to four, and any
        self.total = 0
        for raw in self.packed:
            c1 = _unplaned(raw).reshape(5, -1)[0]
            ended += [int(x.sum()) for x in (c1 == 1, c1 == 2, c1 == 3, c1 == 4, c1 > 0)]
            self.total += int(c1.sum())
        self.d1 = _discounts(ended[:4])
        off1 = float(np.dot([ended[0], ended[1], ended[4] - ended[0] - ended[1]], self.d1))
        self.empty = self.total == 0
        self.base = float((off1 / self.total if self.total else 1.0) / (ended[4] + 1))
        words = spark.sparkContext.broadcast(_gathered(((p1, g2, t2) for p1, g2, _, t2 in self.by_range()), np.float32, np.float32, np.float32))

        def likely(pair: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The probability of each pair, and what it would be without the pair."""
            p1, g2, t2 = words.value
            v, w = pair >> BITS, pair & MASK
            lower = g2[v] * p1[w]
            return (c2 - _off(c2, d2)) / t2[v] + lower, lower

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, pair, _, c2 in _counts(batches):
                p, lower = likely(pair, c2)
                yield _weights(pair.view(np.uint64) | _IS_PAIR, np.log(p / lower), shards)

        def by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, c, pair, _, c2 in _counts(batches):
                lp2 = np.repeat(np.rint(np.log(likely(pair, c2)[0]) * 1000).astype(np.int16), c2)
                key = (k & MASK) << 2 * BITS | k >> BITS
                order = np.argsort(key)
                key = key[order]
                dealt = _dealt(_places((key >> BITS).view(np.uint64), shards)[0], key, c[order], lp2[order])
                yield _batch([(s, _packed(own), _planes(n), _planes(lower)) for s, own, n, lower in dealt], schema, (*_COUNT_TYPES, pa.binary()))

        def triples(key: tuple, rows: pa.Table) -> pa.Table:
            k, c, lp2 = (np.concatenate([f(_blob(rows, x, i)) for i in range(rows.num_rows)]) for f, x in ((_unpacked, "keys"), (_unplaned, "counts"), (_unplaned, "lower")))
            order = np.argsort(k)
            k, c, lp2 = k[order], c[order], lp2[order]
            ctx, off = k >> BITS, _off(c, d3)
            begin = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            t3 = np.add.reduceat(c, begin)
            g3 = np.add.reduceat(off, begin) / t3
            each = np.diff(np.append(begin, len(k)))
            lower = np.repeat(g3, each) * np.exp(lp2 / 1000)
            weight = np.log(((c - off) / np.repeat(t3, each) + lower) / lower)
            keys = np.concatenate([k.view(np.uint64), ctx[begin].view(np.uint64) | _IS_PAIR])
            return pa.Table.from_batches([_weights(keys, np.concatenate([weight, np.log(g3)]), shards)])

        schema = _COUNTS + ", lower binary"
        turn = sum(((F.col("shard") >= end).cast("int") for end in ends[:-1]), F.lit(0)).alias("turn")
        found = counts.mapInArrow(pairs, _POSTED), counts.mapInArrow(by_context, schema).groupBy("shard").applyInArrow(triples, _POSTED)
        self.tables = [stored(x.select("*", turn), scratch, "turn") for x in found]
        dropped(spark, [counts])
        words.destroy()

    def by_range(self) -> Iterator[tuple[np.ndarray, ...]]:
        """For each range of word codes: a word's probability, what its context leaves to the words by themselves, the pairs it ends and the triples whose pair it begins."""
        for raw in self.packed:
            c1, t2, *few = _unplaned(raw).reshape(5, -1)
            p1 = (c1 - np.where(c1 == 0, 0.0, _off(c1, self.d1))) / max(1.0, self.total) + self.base
            left2 = sum(n * d for n, d in zip(few, self.d2, strict=True))
            yield p1, np.where(t2 > 0, left2 / np.maximum(1.0, t2), 1.0), c1, t2

    def weights(self) -> tuple[np.ndarray, ...]:
        """By word code: its weight as a prediction and as a context, and whether it can begin and end a pair of the model."""
        return _gathered(((np.log(p1), np.log(g2), t2 > 0, c1 > 0) for p1, g2, c1, t2 in self.by_range()), np.float32, np.float32, bool, bool)

    def of_turn(self, turn: int) -> DataFrame:
        """The weights of a turn's shards."""
        a, b = (x.filter(F.col("turn") == turn).drop("turn") for x in self.tables)
        return a.union(b)

    def drop_turn(self, turn: int) -> None:
        """Delete a turn's part, which nothing reads any more."""
        dropped(self.tables[0].sparkSession, [f"{x._stored_at}/turn={turn}" for x in self.tables])

    def of_keys(self, keys: np.ndarray, shards: int) -> np.ndarray:
        """What the model's rows weigh at the places of some keys, looked up where the rows lie."""
        shard, place = _places(keys, shards)
        one, which = np.unique(shard.astype(np.int64) << 32 | place, return_inverse=True)
        spark = self.tables[0].sparkSession
        asked = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    s = batch.column("shard")[i].as_py()
                    a, b = np.searchsorted(asked.value, [s << 32, (s + 1) << 32])
                    own = _unpacked(_blob(batch, "keys", i))
                    at = np.searchsorted(own, asked.value[a:b] & 0xFFFFFFFF), np.searchsorted(own, asked.value[a:b] & 0xFFFFFFFF, "right")
                    sums = np.concatenate([[0], np.cumsum(_unplaned(_blob(batch, "sizes", i)), dtype=np.int64)])
                    n = sums[at[1]] - sums[at[0]]
                    hit = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(hit + a), pa.array(n[hit])], names=["at", "n"])

        a, b = (x.select("shard", "keys", "sizes") for x in self.tables)
        got = a.union(b).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        asked.destroy()
        sums = np.zeros(len(one))
        sums[got.column(0).to_numpy()] = got.column(1).to_numpy()
        return sums[which] / 1000


def turns(shards: int, passes: int) -> list[int]:
    """The end of each pass's run of shards, which together are all; a pass has LARGER times those of the pass before."""
    return [round(shards * (LARGER ** (t + 1) - 1) / (LARGER**passes - 1)) for t in range(passes)]


def _off(c: np.ndarray, d: list[float]) -> np.ndarray:
    """What is taken off counts of one, two and more."""
    return np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))


def _places(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and 32 other bits of its hash."""
    h = K.mix(key)
    return ((h & np.uint64(0xFFFFFF)) % np.uint64(shards)).astype(np.int32), (h >> np.uint64(32)).astype(np.int64)


_POSTED = "shard int, kind int, block long, keys binary, sizes binary, at binary, times binary"
_NAMES = ["shard", "kind", "block", "keys", "sizes", "at", "times"]


def _row(shard: int, kind: int, block: int, *blobs: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (*blobs, *[b""] * (4 - len(blobs)))]], names=_NAMES)


def _weights(k: np.ndarray, x: np.ndarray, shards: int) -> pa.RecordBatch:
    """Rows of kind 0: for each shard the places of its keys and their weights in thousandths."""
    shard, place = _places(k, shards)
    order = np.argsort(shard.astype(np.int64) << 32 | place)
    shard, place, x = shard[order], place[order], np.rint(x[order].astype(np.float32) * 1000).astype(np.int16)
    rows = [(s, 0, 0, _packed(place[a:b]), _planes(x[a:b]), b"", b"") for s, a, b in _runs(shard)]
    return _batch(rows, _POSTED, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``value, first, end`` of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
    for a, b in zip(begin, [*begin[1:], len(x)], strict=True):
        yield int(x[a]), int(a), int(b)


def _posted(shard: np.ndarray, place: np.ndarray, d: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Postings (kind 1) of a block: by shard the distinct places, how many documents have each, and, place by place, which and how many times."""
    if not len(shard):
        return
    one = shard.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
    bits = int(d.max()).bit_length()
    if int(one.max()).bit_length() + bits <= 64:  # numbers are sorted many times faster than their order is found
        both = np.sort(one << np.uint64(bits) | d.astype(np.uint64))
        one, d = both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.lexsort((d, one))
        one, d = one[order], d[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (d[1:] != d[:-1])])
    begin = np.flatnonzero(new)
    one, d, times = one[begin], d[begin].astype(np.int32), np.diff(np.append(begin, len(new))).astype(np.int32)
    place = (one & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for s, a, b in _runs((one >> np.uint64(32)).astype(np.int64)):
        ps = place[a:b]
        first = np.flatnonzero(np.concatenate([[True], ps[1:] != ps[:-1]]))
        yield _row(s, 1, block, _packed(ps[first]), _planes(np.diff(np.append(first, len(ps))).astype(np.int32)), _planes(d[a:b]), _planes(times[a:b]))


def postings(docs: DataFrame, ends: list[int], known, words, common, turn: int) -> DataFrame:
    """Rows of kind 1 as in :func:`_posted`, and one of kind 2 for each block: its documents' ``row_key``, words and sums so far. ``docs`` has ``row_key, lang, text``; ``words`` holds the model's arrays by word, ``common`` the sorted keys and weights of common n-grams; sums so far are those of common n-grams of the pass's shards and, in the first pass, of words. ``ends`` as in :func:`turns`."""
    shards, begin, end = ends[-1], ends[turn - 1] if turn else 0, ends[turn]

    def block(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = np.concatenate([h[2] for h in held])
        base = np.cumsum([0, *[len(h[2]) for h in held[:-1]]])
        number = int(K.mix(np.array([len(names)], np.uint64) ^ K.mix(names.view(np.uint64)).sum(dtype=np.uint64)).view(np.int64)[0])
        shard, place = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        d = np.concatenate([h[5] + b for h, b in zip(held, base, strict=True)])
        sums, n = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        yield _row(int(np.uint64(number & 0xFFFFFF)) % shards, 2, number, names.tobytes(), n.astype(np.int64).tobytes(), sums.tobytes())
        yield from _posted(shard, place, d, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicted, context, begins, ends = words.value
        mixed = K.mix(common.value[0])  # keys begin alike, their hashes do not
        order = np.argsort(mixed)
        often, worth = Places(mixed[order]), common.value[1][order]
        held: list[tuple] = []
        size = 0
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, part in K.chunks(batch.column(2)):
                t = Tokens(part, langs[a:b], _known(known))
                k, d = t.grams()
                sums = t.by_word(predicted, context, b - a) if turn == 0 else np.zeros(b - a)
                # words that the model lacks are in none of its pairs
                code = (k & np.uint64(PAIR)).astype(np.int64)
                may = np.flatnonzero(ends[code & MASK] & begins[code >> BITS] | (code & MASK == 0))
                k, d = k[may], d[may]
                shard, place = _places(k, shards)
                own = np.flatnonzero((shard >= begin) & (shard < end))
                k, d, shard, place = k[own], d[own], shard[own], place[own]
                at = often(K.mix(k))
                hit = at >= 0
                sums += np.bincount(d[hit], weights=worth[at[hit]], minlength=b - a)
                held.append((shard[~hit], place[~hit], batch.column(0).slice(a, b - a).to_numpy(), sums, t.words, d[~hit]))
                size += len(held[-1][0])
                if size > BLOCK:
                    yield from block(held)
                    held, size = [], 0
        if held:
            yield from block(held)

    return docs.select("row_key", "lang", F.col("text").cast("string")).mapInArrow(run, _POSTED)


def _shard_sums(key: tuple, model: pa.Table, blocks: pa.Table) -> pa.Table:
    """Of each block of a shard, the documents that the model's n-grams are in and their weights' sums; rows of kind 2 as they are."""
    k = np.concatenate([_unpacked(_blob(model, "keys", i)) for i in range(model.num_rows)] or [np.zeros(0, np.int64)])
    x = np.concatenate([_unplaned(_blob(model, "sizes", i)) for i in range(model.num_rows)] or [np.zeros(0, np.int16)])
    k, x = _merged([(k, x.astype(np.int32))])
    out: list[tuple[int, int, bytes, bytes, bytes]] = []
    for i in range(blocks.num_rows):
        number = blocks.column("block")[i].as_py()
        if blocks.column("kind")[i].as_py() == 2:
            out.append((number, 2, *[bytes(_blob(blocks, c, i)) for c in ("keys", "sizes", "at")]))
            continue
        own, (sizes, at, times) = _unpacked(_blob(blocks, "keys", i)), (_unplaned(_blob(blocks, c, i)) for c in ("sizes", "at", "times"))
        if not len(k):
            continue
        found = np.minimum(np.searchsorted(k, own), len(k) - 1)
        value = np.repeat(np.where(k[found] == own, x[found], 0), sizes).astype(np.int64) * times
        hit = np.flatnonzero(value)
        if len(hit):
            some, to = np.unique(at[hit], return_inverse=True)
            out.append((number, 1, _packed(some.astype(np.int32)), _planes(np.bincount(to, weights=value[hit]).astype(np.int64)), b""))
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "kind", "a", "b", "c"])


def _block_sums(rows: pa.Table) -> pa.Table:
    """Each document's words and log-probability from the rows of its block."""
    kinds = rows.column("kind").to_numpy()
    i = int(np.flatnonzero(kinds == 2)[0])
    copies = int((kinds == 2).sum())  # blocks of the very same rows share a number and have the same sums
    head = [rows.column(c)[i].as_buffer() for c in ("a", "b", "c")]
    names, n, sums = np.frombuffer(head[0], np.int64), np.frombuffer(head[1], np.int64), np.frombuffer(head[2], np.float64).copy()
    for j in np.flatnonzero(kinds == 1).tolist():
        at = _unpacked(rows.column("a")[j].as_buffer())
        sums[at] += _unplaned(rows.column("b")[j].as_buffer()) / (1000 * copies)
    keep = n > 0
    return pa.table({"row_key": names[keep], "n": n[keep], "logp": sums[keep]})


def _scored(posted: DataFrame, model: DataFrame) -> DataFrame:
    sums = model.groupBy("shard").cogroup(posted.groupBy("shard")).applyInArrow(_shard_sums, "block long, kind int, a binary, b binary, c binary")
    return sums.groupBy("block").applyInArrow(_block_sums, "row_key long, n long, logp double")


def common_keys(docs: DataFrame, n_docs: int, known) -> DataFrame:
    """``key`` of the n-grams that at least one of HUNDREDTH documents of a hashed sample holds, COMMON at most."""
    part = max(1, n_docs // SAMPLE)

    def keys(texts: pa.Array, langs: list[str | None]) -> np.ndarray:
        t = Tokens(texts, langs, _known(known))
        k, d = t.grams()
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        return k[np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])] if len(k) else k

    some = docs.filter(F.pmod("row_key", F.lit(part)) == 0)
    least = max(2, min(n_docs, SAMPLE) // HUNDREDTH)
    return _counted(some, keys, 2).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "key").limit(COMMON).select("key")


def log_likelihoods(docs: DataFrame, trusted: DataFrame, known, scratch: list[str]) -> DataFrame:
    """``row_key, n, logp`` of each row of ``docs`` (``row_key, lang, text``) with words, by the model of ``trusted`` (``lang, text``); the end mark's probability is part of ``logp``, the mark not of ``n``."""
    spark = docs.sparkSession
    n_docs, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = min(1 << 20, max(8, -(-(size or 0) // BYTES_A_SHARD)))
    ends = turns(shards, PASSES if (size or 0) > SMALL else 1)
    model = KneserNey(trigram_counts(trusted, shards, known), ends, scratch)
    often = np.sort(common_keys(docs, n_docs, known).toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    worth = model.of_keys(often, shards)
    common = spark.sparkContext.broadcast((often, worth))
    words = spark.sparkContext.broadcast(model.weights())
    every = None
    for turn in range(len(ends)):
        # rows that repeat share a row_key and have the same sums
        sums = stored(_scored(postings(docs, ends, known, words, common, turn), model.of_turn(turn)).groupBy("row_key").agg(F.max("n").alias("n"), F.max("logp").alias("logp")), scratch)
        every = sums if every is None else every.union(sums)
        model.drop_turn(turn)
    for x in (common, words):
        x.destroy()
    return every.groupBy("row_key").agg(F.max("n").alias("n"), F.sum("logp").alias("logp"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that all their labels call good and none toxic."""
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def poor_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that a label calls bad."""
    return labels.filter("doc_id is not null and quality = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def thresholds(rows: DataFrame, group: Column) -> DataFrame:
    """``_lang, threshold`` for each value of ``group`` with trusted rows of ``rows`` (``trusted, poor, log_perplexity``)."""
    known = rows.filter("log_perplexity is not null").select(group.alias("_lang"), "trusted", "poor", "log_perplexity")
    cuts = known.filter("trusted").groupBy("_lang").agg(F.percentile_approx("log_perplexity", QUANTILES, 10_000).alias("cuts"))
    poor = known.filter("poor").withColumnRenamed("_lang", "_of")
    over = [F.coalesce(F.avg((F.col("log_perplexity") > F.col("cuts")[i]).cast("double")), F.lit(0.0)) for i in range(len(QUANTILES))]
    judged = cuts.join(poor, F.col("_lang").eqNullSafe(F.col("_of")), "left").groupBy("_lang", "cuts").agg(F.array(*[F.struct((F.round(x + q, 9)).alias("both"), F.lit(i).alias("i")) for i, (q, x) in enumerate(zip(QUANTILES, over, strict=True))]).alias("tried"))
    return judged.select("_lang", F.col("cuts")[F.array_max("tried")["i"]].alias("threshold"))


def _row_key() -> Column:
    return K.row_hash(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))


def held_out() -> Column:
    """Whether a trusted or bad document is kept from the model, by its ``doc_id``."""
    return F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_key, doc_id, lang, n_words, log_perplexity, threshold, keep``, one row per row of ``docs``. Joins with label ids are left to the planner, which knows the stored tables' sizes."""
    with shuffles_deleted(docs.sparkSession), small_batches(docs.sparkSession):
        return _scores(docs, labels)


def _scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.select(_row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    scratch: list[str] = []
    near, poor = (stored(f(labels), scratch) for f in (trusted_ids, poor_ids))
    trusted = keyed.join(near, "doc_id", "left_semi").filter(~held_out())
    known = spark.sparkContext.broadcast(known_words(trusted))
    totals = log_likelihoods(keyed, trusted, known, scratch)
    known.destroy()
    flagged = keyed.select("row_key", "doc_id", "lang").join(near.withColumn("trusted", F.lit(True)), "doc_id", "left").join(poor.withColumn("poor", F.lit(True)), "doc_id", "left")
    log_ppl = F.round(-F.col("logp") / F.col("n"), 6)
    held = [(F.coalesce(c, F.lit(False)) & held_out()).alias(c) for c in ("trusted", "poor")]
    rows = stored(flagged.join(totals, "row_key", "left").select("row_key", "doc_id", "lang", *held, F.col("n"), log_ppl.alias("log_perplexity")))
    dropped(spark, scratch)  # the scores are all that is read from here on
    overall = thresholds(rows, F.lit("")).first()
    out = rows.join(thresholds(rows, F.col("lang")), F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall and overall["threshold"]).cast("double")))
    return out.select("row_key", "doc_id", "lang", F.col("n").alias("n_words"), "log_perplexity", F.round("threshold", 6).alias("threshold"), F.coalesce(F.col("log_perplexity") <= F.round("threshold", 6), F.lit(True)).alias("keep"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, lang, n_words, log_perplexity, threshold, keep`` of each document."""
    return scores(docs, labels).drop("row_key")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns as they were."""
    bad = scores(docs, labels).filter("not keep").select("row_key").distinct()
    return K.keyed(docs, row_key=_row_key()).join(bad, "row_key", "left_anti").select("row.*")
