"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its word 5-shingles (lower case, split at white space), each labelled with the count of its
earlier occurrences, so that labels are unique within the text. A sketch takes the three labelled shingles with the
smallest hashes and keeps them in text order; its hash is a bucket. Two texts whose ordered similarity is ``s`` share a
given bucket with probability of about ``s**3``, and one of 14 at ``s = 0.8`` with all but 1 in 20,000.

The similarity of two texts of ``n`` and ``m`` shingles is ``M / (n + m - M)``, where ``M`` is the most labelled shingles
that an alignment can match in order within the band that a similarity of 0.8 leaves. Pairs at 0.8 or more are linked;
classes are the connected components.

Equal texts are collapsed first. Within a bucket, first only the members with the smallest and the largest id are
compared with the others (linear). Where a bucket then still holds several classes, everything outside its largest class
is compared with everything of another class, block by block, so that no link that could join two classes is lost,
whatever the size of the bucket; blocks bound the memory of a task.

Null texts count as empty; texts without words form classes by equality only. Repeated rows share a class. ``class_id``
is the smallest ``doc_id`` of the class (null if it has none). Extra columns are left alone. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K
from sparkloom.operators.components import component_labels
from sparkloom.session import cut, stored

SHINGLE, SKETCHES, TAKEN, LEAST = 5, 14, 3, 0.8
#: Links that one task may unite at the end.
FINISH = 20_000
#: Bytes of sequences on one side of a block comparison.
BLOCK = 16 << 20
_rng = np.random.Generator(np.random.PCG64(1907))
_SEED = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64)
_ODD = _rng.integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_ORDER = _rng.integers(1, 2**63, TAKEN, dtype=np.uint64) | np.uint64(1)


def labelled_shingles(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text of a slice, its labelled shingles in text order; a text of fewer words than a shingle has one of all its words."""
    w = K.words(texts)
    h = w.hashes()
    runs = K.windows(h, SHINGLE)
    for a, b in zip(w.doc[:-1], w.doc[1:], strict=True):
        if b - a >= SHINGLE:
            s = runs[a : b - SHINGLE + 1]
        elif b > a:
            s = K.windows(h[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
            continue
        order = np.argsort(s, kind="stable")
        ranked = s[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            at = np.arange(len(s))
            begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
            count = np.empty(len(s), np.uint64)
            count[order] = (at - begin).astype(np.uint64)
            s = K.mix(s + count * np.uint64(0x9E3779B97F4A7C15))
        yield s


def sketch(s: np.ndarray) -> np.ndarray:
    """The bucket of each sketch for the labelled shingles of one text."""
    x = (s[None, :] ^ _SEED[:, None]) * _ODD[:, None]
    if len(s) > TAKEN:
        at = np.sort(np.argpartition(x, TAKEN - 1, axis=1)[:, :TAKEN], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(s)), (SKETCHES, len(s)))
    return K.mix((K.mix(s[at]) * _ORDER[: at.shape[1]]).sum(axis=1, dtype=np.uint64) ^ _SEED)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """The banded ordered similarity of two sequences of labelled shingles; 0 where it can be seen to be below ``least``."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    common, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(common) < least * (n + m - len(common)):
        return 0.0
    order = np.argsort(at)
    at, to = at[order], to[order]
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)  # a float just below a whole number is that number
    to = to[np.abs(to - at) <= band]
    if (to[1:] > to[:-1]).all():
        most = len(to)
    else:
        tails: list[int] = []
        for x in to.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        most = len(tails)
    return most / (n + m - most)


def _texts(docs: DataFrame) -> DataFrame:
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(whole)).alias("node"), F.lower(whole).alias("t"))


def _sketched(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in K.chunks(batch.column(1)):
                rows = [sketch(s).view(np.int64) if len(s) else None for s in labelled_shingles(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.list_(pa.int64()))], names=["node", "buckets"])

    return texts.mapInArrow(run, "node binary, buckets array<long>").filter("buckets is not null").dropDuplicates(["node"])


def _sequences(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in K.chunks(batch.column(1)):
                rows = [s.tobytes() for s in labelled_shingles(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], names=["node", "seq"])

    return texts.mapInArrow(run, "node binary, seq binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame) -> DataFrame:
    """Those of ``a, b, sa, sb`` that are similar enough, as ``src, dst``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i in range(batch.num_rows) if similarity(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)) >= LEAST]
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["src", "dst"])

    return pairs.mapInArrow(run, "src binary, dst binary")


def _shared(mine: list[np.ndarray], theirs: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """For each of ``mine``, how many of its labels some other text of ``theirs`` has; ``own`` marks those that are among ``theirs`` themselves."""
    known, count = np.unique(np.concatenate(theirs), return_counts=True)
    flat, size = np.concatenate(mine), np.array([len(x) for x in mine])
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = (known[at] == flat) & (count[at] > np.repeat(own, size))
    return np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)


def _joined_blocks(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of different classes of two blocks, one for each two classes at least.

    Two texts share no more labels than either shares with the whole other block; where even that many would leave them
    below the threshold, they are not compared.
    """
    out: list[tuple[bytes, bytes]] = []
    if not len(left) or not len(right):
        return pd.DataFrame(out, columns=["src", "dst"])
    leader: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        top = x
        while (y := leader.get(top, top)) != top:
            top = y
        while x != top:
            leader[x], x = top, leader[x]
        return top

    mine, theirs = ([np.frombuffer(s, np.uint64) for s in side["seq"]] for side in (left, right))
    nodes, others = left["node"].tolist(), right["node"].tolist()
    classes, their_classes = left["component"].tolist(), right["component"].tolist()
    sa, sb = _shared(mine, theirs, left["node"].isin(set(others)).to_numpy()), _shared(theirs, mine, right["node"].isin(set(nodes)).to_numpy())
    size = np.array([len(x) for x in theirs])
    for i, (node, own) in enumerate(zip(nodes, classes, strict=True)):
        most = np.minimum(sa[i], sb)
        for j in np.flatnonzero(most >= LEAST * (len(mine[i]) + size - most)).tolist():
            x, y = find(own), find(their_classes[j])
            if x != y and similarity(mine[i], theirs[j]) >= LEAST:
                leader[x] = y
                out.append((node, others[j]))
    return pd.DataFrame(out, columns=["src", "dst"])


def _rest(rows: DataFrame, labels: DataFrame, seqs: DataFrame) -> DataFrame:
    """Links that buckets with several classes still hide. ``rows``: ``bucket, node``."""
    sized = seqs.select("node", F.length("seq").cast("long").alias("bytes"))
    own = rows.join(sized, "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", "bytes", F.coalesce("component", "node").alias("component"))
    sizes = own.groupBy("bucket", "component").agg(F.sum("bytes").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).filter("classes > 1")
    open_ = open_.select("bucket", F.col("top.component").alias("core"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("minor"))
    held = stored(own.join(open_, "bucket").drop("bytes"))
    side = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = held.filter("component <> core").withColumn("i", side("minor")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = held.withColumn("j", side("blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor") - 1)))
    cols = ["bucket", "i", "j", "node", "component", "seq"]
    # fresh names for each side: both come from the same table
    left, right = left.join(seqs, "node").select(*cols), right.join(seqs, "node").select(*cols)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in cols]).toDF(*cols)
    return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInPandas(_joined_blocks, "src binary, dst binary")


def node_classes(docs: DataFrame) -> DataFrame:
    """``id, component`` of each distinct text (by its MD5) that is near another one."""
    texts = _texts(docs)
    rows = stored(_sketched(texts).select("node", F.explode("buckets").alias("bucket")))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("n > 1")
    dense = stored(rows.join(full, "bucket").select("bucket", "node", "low", "high"))
    pairs = dense.select("node", F.explode(F.array("low", "high")).alias("lead")).filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    seqs = stored(_sequences(texts.join(dense.select("node").distinct(), "node", "left_semi")))
    sa = seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa"))
    sb = seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb"))
    links = cut(_verified(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")))
    labels = component_labels(links, finish=FINISH)
    more = cut(_rest(dense.select("bucket", "node"), labels, seqs))
    if more.isEmpty():
        return labels
    return component_labels(links.union(more), finish=FINISH)


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size`` of each row of ``docs``."""
    labels = node_classes(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("id"))
    rows = ids.join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    heads = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(heads, "component").select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest ``doc_id``; all columns as they were."""
    labels = node_classes(docs)
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    ids = docs.select(node.alias("id"), F.col("doc_id").cast("long").alias("doc_id")).join(labels, "id", "left")
    best = ids.groupBy(F.coalesce("component", "id").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("id"))).alias("k"))
    kept = best.select(F.col("k.id").alias("node"), F.col("k.doc_id").alias("kept"))
    # each class keeps one text, so the text alone finds the rows; of rows that are equal one stays
    chosen = K.keyed(docs, node=node, doc_id=F.col("doc_id").cast("long")).join(kept, "node").filter(F.col("doc_id").eqNullSafe(F.col("kept"))).dropDuplicates(["node"])
    return chosen.select("row.*")
