from collections import Counter

import numpy as np
import pyarrow as pa

from sparkloom.llm import kernel as K
from sparkloom.llm import quality

TEXTS = ["a b c a b c a b", "a b c d", None, "", "b b b", "x a b c", "a b c a b c a b"]


def plain(texts):
    (_, _, part), = K.chunks(pa.array(texts))
    return Counter(quality.Tokens(part, ["en"] * len(texts), quality._known(None)).triple.tolist())


def test_triples_travel_as_blocks_that_a_shard_merges(spark, monkeypatch):
    """Triples are rows for each shard, not rows of their own; a shard has all triples of its pairs."""
    monkeypatch.setattr(quality, "MERGED", 5)
    docs = spark.createDataFrame([("en", t) for t in TEXTS], "lang string, text string").repartition(3)
    rows = quality.trigram_counts(docs, 4).toArrow()
    assert 1 < rows.num_rows <= 4 and len(set(rows.column("shard").to_pylist())) == rows.num_rows
    got, pairs = {}, []
    for k, c, pair, begin, c2 in quality._counts(iter(rows.to_batches())):
        assert (np.diff(k) > 0).all() and c2.sum() == len(k) and (k[begin] >> quality.BITS == pair).all()
        got |= dict(zip(((k & quality.MASK) << 2 * quality.BITS | k >> quality.BITS).tolist(), c.tolist(), strict=True))
        pairs += pair.tolist()
    assert got == dict(plain(TEXTS)) and len(pairs) == len(set(pairs))


def test_tallies_are_those_of_the_plain_counts(spark):
    docs = spark.createDataFrame([("en", t) for t in TEXTS], "lang string, text string").repartition(3)
    sums, seen = quality.tallies(quality.trigram_counts(docs, 4))
    tri = plain(TEXTS)
    bi = Counter(k & quality.PAIR for k in tri)
    want = np.zeros_like(sums)
    for pair, c2 in bi.items():
        v, w = pair >> quality.BITS, pair & quality.MASK
        want[0, w] += 1
        want[1, v] += c2
        want[1 + min(c2, 3), v] += 1
    assert (sums == want).all()
    assert seen.tolist() == [sum(x == j for x in n.values()) for n in (tri, bi) for j in (1, 2, 3, 4)]
    none, few = quality.tallies(quality.trigram_counts(docs.limit(0), 4))
    assert not none.any() and not few.any()


def test_python_gets_few_texts_at_once_only_while_scoring(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with quality.small_batches(spark):
        assert int(spark.conf.get(key)) <= 500
    assert spark.conf.get(key) == before
