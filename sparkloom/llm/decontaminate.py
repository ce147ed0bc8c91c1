"""Benchmark decontamination by template windows.

Texts of both sides become sequences of canonical words: numbers, names (capitalised words inside a sentence) and
units (unit words after a number) turn into typed placeholders, other words are lower-cased without marks at their
ends. Windows of :data:`WIDTH` canonical words, three of them plain at least, are joined by hash; windows of fewer plain
words only with windows of the very same words, as numbers and names alone are no template. The values behind
the placeholders are the slots: along one occurrence of an item in a document (one diagonal of positions) a slot value
of the item must always meet the same value in the document; if it doesn't, windows with slots don't count there. So
a re-parameterised question is caught, and a chance mixture of like-shaped phrases is not. A document is contaminated by
an item of whose template windows it holds :data:`COVERAGE` or more, or of which it holds a run of :data:`RUN` words (the
whole item if that is shorter). A run is what windows that overlap or touch on one diagonal cover together; where the
diagonal's slots differ, windows that have the item's own values still belong to it.

A bitmap of fixed size with the hashes of the benchmark's windows keeps almost all other windows of the documents from
leaving the task that reads them; whatever passes it is joined exactly, so its size limits cost, never results.

An item of fewer than WIDTH words is a single exact window. As so few words also stand in other texts by chance, it is
found only where the same words stand by themselves: between the beginnings and ends of sentences, lines or the text.

Null texts count as empty; texts and items without words take no part. Rows that repeat are found each. Null ids are
carried as they are. Extra columns, of any name, are left alone. An empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.session import stored

WIDTH, PLAIN, COVERAGE, RUN = 5, 3, 0.5, 13
#: Bits of the hash that the bitmap holds: 2**22 bits are 512 KiB, whatever the size of the benchmark.
BITS = 22
#: Unit words.
UNITS = "kg g mg km m cm mm mile miles hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents percent liter liters litre litres meter meters metre metres foot feet inch inches pound pounds mph kmh".split()
_UNIT = np.sort(np.array([K.text_hash(u) for u in UNITS], np.uint64))
_NUMBER_AT, _NAME_AT, _UNIT_AT, _EXACT, _SHORT = (np.uint64(K.text_hash(x)) for x in ("<number>", "<name>", "<unit>", "<exact>", "<short>"))


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, K.Words]:
    """Canonical word hashes, the hashes of the words themselves, whether each is a slot, whether it opens a sentence, line or text, and the words."""
    raw = K.words(texts)
    w = K.trimmed(raw)
    low = K.Words(K.lowered(w.data), w.start, w.end, w.doc, w.text_start)
    own = low.hashes()
    n = len(own)
    if not n:
        return own, own, np.zeros(0, bool), np.zeros(0, bool), w
    number = K._DIGIT[w.data[w.start]]
    opens = np.zeros(n, bool)
    opens[w.doc[:-1][w.doc[:-1] < n]] = True
    opens[1:] |= K._ENDS[raw.data[raw.end[:-1] - 1]]
    # a line feed between two words opens a sentence too
    feeds = np.concatenate([[0], np.cumsum(raw.data == 10)])
    opens[1:] |= feeds[raw.start[1:]] > feeds[raw.end[:-1]]
    last = w.data[w.end - 1]
    small = K._SMALL[last] | (last >= 128)
    name = K.capital(w.data, w.start) & ~opens & small & (w.end - w.start > 1)
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1]
    at = np.flatnonzero(unit)
    unit[at] = _UNIT[np.minimum(np.searchsorted(_UNIT, own[at]), len(_UNIT) - 1)] == own[at]
    can = np.where(number, _NUMBER_AT, np.where(unit, _UNIT_AT, np.where(name, _NAME_AT, own)))
    return can, own, number | name | unit, opens, w


def template_windows(texts: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its text, its position there, its hash; its first word, the words' own hashes and slot marks, and whether the window is exact (too few plain words for a template). Shorter windows are those that stand by themselves, with ``whole`` only whole texts."""
    can, own, slot, opens, w = canonical(texts)
    h = K.windows(can, WIDTH)
    first = np.arange(len(h))
    text = K.text_of_word(w)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    exact = plain[WIDTH:] - plain[: len(h)] < PLAIN if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(exact)
    if len(at):
        h[at] = K.mix(K.windows(own, WIDTH)[at] ^ _EXACT)
    ok = text[: len(h)] == text[WIDTH - 1 :] if len(h) else np.zeros(0, bool)
    first, h, exact = first[ok], h[ok], exact[ok]
    closes = np.append(opens[1:], True) if len(own) else opens
    size = np.diff(w.doc)
    for n in range(1, WIDTH):
        some = np.arange(max(0, len(own) - n + 1))
        some = some[opens[some] & closes[some + n - 1] & (text[some] == text[some + n - 1])]
        if whole:  # an item's only window is all of it
            some = some[size[text[some]] == n]
        first, exact = np.append(first, some), np.append(exact, np.ones(len(some), bool))
        h = np.append(h, K.mix(K.windows(own, n)[some] ^ _SHORT) if len(some) else np.zeros(0, np.uint64))
    return text[first], first - w.doc[text[first]], h, first, np.stack([own, slot.astype(np.uint64)]) if len(own) else np.zeros((2, 0), np.uint64), exact


def _emit(ids: list[pa.Array], a: int, keep: np.ndarray, found: tuple) -> pa.RecordBatch:
    text, pos, h, first, words, exact = found
    values = [[] if e else [int(np.int64(words[0, j].astype(np.int64))) for j in range(f, f + WIDTH) if words[1, j]] for f, e in zip(first[keep], exact[keep], strict=True)]
    rows = pa.array(a + text[keep])
    cols = [x.take(rows) for x in ids]
    return pa.RecordBatch.from_arrays([*cols, pa.array(pos[keep].astype(np.int32)), pa.array(h[keep].view(np.int64)), pa.array(values, pa.list_(pa.int64())), pa.array(exact[keep])], names=[*[f"k{i}" for i in range(len(ids))], "pos", "h", "slots", "exact"])


def windows_of(rows: DataFrame, ids: list[str], text: str, bitmap=None) -> DataFrame:
    """``ids..., pos, h, slots, exact`` of each window of the texts that ``bitmap`` (a broadcast of packed bits) lets through."""
    source = rows.select(*[F.col(i) for i in ids], F.col(text).cast("string").alias("_t"))
    n = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap.value, bitorder="little").view(bool) if bitmap is not None else None
        for batch in batches:
            own = [batch.column(i) for i in range(n)]
            for a, _, part in K.chunks(batch.column(n)):
                found = template_windows(part, bitmap is None)
                h = found[2]
                keep = np.flatnonzero(bits[(h & np.uint64(2**BITS - 1)).astype(np.int64)]) if bits is not None else np.arange(len(h))
                if len(keep):
                    yield _emit(own, a, keep, found)

    fields = ", ".join(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(n))
    out = source.mapInArrow(run, f"{fields}, pos int, h long, slots array<long>, exact boolean")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(ids)})


def _bitmap(items: DataFrame) -> np.ndarray:
    """Which values the low bits of the windows' hashes take, made in 64 parts by the cluster."""
    part = BITS - 6

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << part, bool)
        bits[rows.column("at").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    low = items.select(F.shiftright(F.col("h").bitwiseAND(2**BITS - 1), part).alias("part"), F.col("h").bitwiseAND(2**part - 1).alias("at")).distinct()
    out = np.zeros(2**BITS // 8, np.uint8)
    for x in low.groupBy("part").applyInArrow(packed, "part long, bits binary").collect():
        out[x["part"] << part - 3 : x["part"] + 1 << part - 3] = np.frombuffer(x["bits"], np.uint8)
    return out


def _row_key():
    return K.row_hash(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, row_key, item_id, windows, coverage`` of each document and item whose coverage reaches COVERAGE or whose run is long enough.

    Windows and coverage are of the template windows, or of the exact ones for an item that has no others.

    ``row_key`` is the hash of the document's id and text, so that rows that share an id but not a text are told apart.
    """
    item, text = F.col("item_id").cast("long"), F.col("text").cast("string")
    items = stored(windows_of(benchmark.select(item.alias("item_id"), K.row_hash(item, text).alias("item_key"), text.alias("text")).dropDuplicates(["item_id", "item_key"]), ["item_id", "item_key"], "text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), "text")
    found = windows_of(rows, ["doc_id", "row_key"], "text", bitmap).drop("exact").withColumnsRenamed({"pos": "dpos", "slots": "dslots"})
    sized = items.groupBy("item_id", "item_key").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("exact")).alias("n_template"), (F.max("pos") + WIDTH).alias("n_words"))
    pairs = found.join(items, "h").filter(F.size("slots") == F.size("dslots"))
    both = F.arrays_zip("slots", "dslots")
    group = ["doc_id", "row_key", "item_id", "item_key"]
    # one diagonal holds each window of the item once at most
    runs = pairs.groupBy(*group, (F.col("dpos") - F.col("pos")).alias("diagonal")).agg(
        F.collect_set(F.when(~F.col("exact") & (F.size("slots") == 0), F.col("pos"))).alias("free"),
        F.collect_set(F.when(F.col("exact"), F.col("pos"))).alias("exact"),
        F.collect_set(F.when(F.col("slots") == F.col("dslots"), F.col("pos"))).alias("same"),
        F.collect_set(F.when(F.size("slots") > 0, F.col("pos"))).alias("slotted"),
        F.array_distinct(F.flatten(F.collect_set(both))).alias("met"),
    )
    steady = F.size(F.array_distinct("met.slots")) == F.size("met")
    held = F.when(steady, F.array_union("free", "slotted")).otherwise(F.col("free"))
    start = F.struct(*[F.lit(x).alias(c) for c, x in (("begin", -WIDTH - 1), ("last", -WIDTH - 1), ("best", 0))])

    def longer(run, pos):
        begin = F.when(pos - run["last"] <= WIDTH, run["begin"]).otherwise(pos)
        return F.struct(begin.alias("begin"), pos.alias("last"), F.greatest(run["best"], pos + WIDTH - begin).alias("best"))

    run = F.aggregate(F.array_sort(F.array_union(held, F.col("same"))), start, longer)["best"]
    marked = lambda c, exact: F.transform(c, lambda p: F.struct(p.alias("pos"), F.lit(exact).alias("exact")))
    each = runs.select(*group, run.alias("run"), F.explode_outer(F.concat(marked(held, False), marked(F.col("exact"), True))).alias("w"))
    # nulls group with nulls, so documents without id keep their windows together
    covered = each.groupBy(*group).agg(F.max("run").alias("run"), F.count_distinct(F.when(~F.col("w.exact"), F.col("w.pos"))).alias("template"), F.count_distinct(F.when(F.col("w.exact"), F.col("w.pos"))).alias("exact"))
    both = covered.join(sized.withColumnRenamed("item_id", "i").withColumnRenamed("item_key", "k"), F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_key") == F.col("k")))
    some = F.col("n_template") > 0
    of = F.when(some, F.col("n_template")).otherwise(F.col("n_all"))
    found = both.withColumn("windows", F.when(some, F.col("template")).otherwise(F.col("exact")))
    hit = some & (F.col("windows") >= COVERAGE * of) | (F.col("run") >= F.least(F.lit(RUN), F.col("n_words")))
    return found.filter(hit).select("doc_id", "row_key", "item_id", F.col("windows").cast("long").alias("windows"), F.round(F.col("windows") / of, 6).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, windows, coverage``: each contaminated document with each of its items, repeated rows once."""
    return matches(docs, benchmark).select("doc_id", "item_id", "windows", "coverage").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, all columns as they were."""
    bad = matches(docs, benchmark).select("row_key").distinct()
    return K.keyed(docs, row_key=_row_key()).join(bad, "row_key", "left_anti").select("row.*")
