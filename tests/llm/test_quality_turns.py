import os
import random
import tracemalloc
from urllib.parse import urlparse

import numpy as np

from sparkloom import session
from sparkloom.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def some(spark, n=400):
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 40))) for _ in range(n)]
    docs = spark.createDataFrame([(i, t, r.choice(["en", "de", None])) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    return docs, spark.createDataFrame([(i, int(i < n // 2), 0) for i in range(n)], LABELS)


def test_turns_take_each_shard_once_and_later_ones_more():
    assert quality.turns(8, 1) == [8]
    for shards in (8, 31, 1800):
        sizes = np.diff([0, *quality.turns(shards, 3)])
        assert sizes.sum() == shards and 0 < sizes[0] <= sizes[1] <= sizes[2] and sizes[0] < sizes[2]


def test_a_turns_part_of_the_model_goes_after_it(spark, monkeypatch):
    """A pass finds on disk no part of the model that an earlier one was the last to read; the model is dealt to the passes only; scores are those of a single pass."""
    docs, labels = some(spark)
    want = sorted(quality.classified(docs, labels).collect())
    root = urlparse(session.checkpoint_root(spark)).path
    before, seen, dealt = set(os.listdir(root)), [], []
    stored, scored = quality.stored, quality._scored

    def watched(df, *args):
        if df.columns == ["row_key", "n", "logp"]:
            seen.append({x for d in set(os.listdir(root)) - before for x in os.listdir(f"{root}/{d}") if x.startswith("turn=")})
        return stored(df, *args)

    monkeypatch.setattr(quality, "stored", watched)
    monkeypatch.setattr(quality, "_scored", lambda *x: dealt.append(1) or scored(*x))
    monkeypatch.setattr(quality, "SMALL", 0)
    got = sorted(quality.classified(docs, labels).collect())
    assert seen == [{"turn=0", "turn=1", "turn=2"}, {"turn=1", "turn=2"}, {"turn=2"}] and len(dealt) == 3
    assert got == want and {x["keep"] for x in got} == {True, False}


def test_broadcasts_leave_no_files(spark):
    docs, labels = some(spark)
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    quality.classified(docs, labels).collect()
    assert set(os.listdir(folder)) <= before


def test_common_weights_are_those_of_the_models_rows(spark):
    docs, _ = some(spark)
    ends = quality.turns(4, 3)
    scratch = []
    model = quality.KneserNey(quality.trigram_counts(docs.select("lang", "text"), 4), ends, scratch)
    want = {}
    for t in range(3):
        for x in model.of_turn(t).collect():
            assert (ends[t - 1] if t else 0) <= x["shard"] < ends[t]
            for place, n in zip(quality._unpacked(x["keys"]).tolist(), quality._unplaned(x["sizes"]).tolist(), strict=True):
                want[x["shard"], place] = want.get((x["shard"], place), 0) + n
    (_, _, part), = quality.K.chunks(quality.pa.array(["a b c a b", "a zz zz b", "qqqq"]))
    keys = np.unique(quality.Tokens(part, ["en"] * 3, quality._known(None)).grams()[0])
    shard, place = quality._places(keys, 4)
    assert model.of_keys(keys, 4).tolist() == [want.get(x, 0) / 1000 for x in zip(shard.tolist(), place.tolist(), strict=True)]
    assert model.of_keys(keys, 4).any() and len(model.of_keys(keys[:0], 4)) == 0
    session.dropped(spark, scratch)


def test_the_driver_unpacks_the_model_a_range_at_a_time(spark):
    """What the driver's Python holds is some arrays that it broadcasts, not all tallies by word code (84 MB) with copies of them."""
    docs, labels = some(spark)
    tracemalloc.start()
    try:
        rows = quality.classified(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 72 << 20 and rows.count() == 400
