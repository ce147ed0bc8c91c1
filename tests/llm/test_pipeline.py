from conftest import DATA

import corpus_pipeline
from sparkloom.llm import bpe, decontaminate, neardup, pii, quality
from sparkloom.session import table


def test_stages_take_effect_in_order(spark):
    docs = table(spark, DATA, "documents")
    seen = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, DATA)
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), out.schema)
        counts.append(seen.count())
    good = {x["doc_id"] for x in quality.classified(docs, table(spark, DATA, "labels")).filter("keep").collect()}
    left = docs.filter(docs.doc_id.isin(list(good)))
    classes = {x["doc_id"]: x["class_id"] for x in neardup.classes(left).collect()}
    heads = {d for d, c in classes.items() if d == c}
    bad = {x["doc_id"] for x in decontaminate.contaminated(docs, table(spark, DATA, "benchmark")).collect()}
    rows = {x["doc_id"]: x for x in seen.collect()}
    assert set(rows) == heads - bad
    assert all(x["round_trip"] for x in rows.values())
    spans = {x["doc_id"]: x["spans"] for x in pii.digests(docs).collect()}
    coder = bpe.coder(bpe.public_tokenizers.path(bpe.DEFAULT_RANKS), bpe.public_tokenizers.PATTERN)
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    for d, x in rows.items():
        assert (coder.decode(bytes(x["ids"])).decode() == texts[d]) == (not spans[d])
    assert counts == sorted(counts, reverse=True)


def test_run_returns_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) == {"doc_id", "lang", "source", "ids", "n_tokens", "round_trip"}
