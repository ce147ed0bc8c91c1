"""Empty tables, nulls, clashing names, repeats, very long texts; and brute force where operators have rules of their own."""

import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import xxhash
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import ann, bpe, chat, decontaminate, html, licences, neardup, pii, quality, shards
from sparkloom.session import table

NAMES = "row row_key node id kept key k0 t i at keys shard unit pii body text_ _node _kept _pii _whole _row_key c best s m x".split()
BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def odd_docs(spark):
    """Null ids, languages and texts, an empty and a very long text, repeats, and columns whose names operators might use themselves."""
    long = " ".join(f"w{i % 5000}" for i in range(120_000)) + " mail a@b.co"
    rows = [(1, None, "en"), (1, "en", None), (None, "some words here, a@b.co said one of them", "en"), (None, None, None), (2, "", "en"), (3, long, "en"), (4, "twice the same words stand in here", "de"), (4, "twice the same words stand in here", "de"), (5, "\x00   \U0001f600 Licensed under CC BY 4.0.", "fr")]
    df = spark.createDataFrame([(a, b, c, "s", len(b or "")) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(7).alias(n) for n in NAMES])


def benchmark(spark):
    return spark.createDataFrame([(1, "one of the items has these many words in it"), (None, None), (2, ""), (3, "Yes.")], BENCH)


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (3, 1, None), (None, 0, 1), (5, None, None), (2, 0, 0), (4, 1, 0)], LABELS)


def test_stages_keep_columns_and_odd_rows(spark):
    df = odd_docs(spark)
    stages = {
        "quality": lambda d: quality.kept(d, labels(spark)), "neardup": neardup.deduplicated,
        "decontaminate": lambda d: decontaminate.clean(d, benchmark(spark)), "pii": pii.redact,
    }
    for name, f in stages.items():
        out = f(df)
        assert out.columns == df.columns and [x.dataType for x in out.schema] == [x.dataType for x in df.schema], name
        rows = out.collect()
        assert all(x[n] == 7 for x in rows for n in NAMES), name
        assert f(df.limit(0)).count() == 0, name
        if name in ("decontaminate", "pii"):
            assert len(rows) == 9
        if name == "neardup":  # null and empty texts are one class, of the smallest id
            assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in rows) == [(False, 1), (False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
        if name == "pii":
            assert Counter(x["text"] for x in rows)["some words here, [EMAIL] said one of them"] == 1 and sum((x["text"] or "").endswith("mail [EMAIL]") for x in rows) == 1
    encoded = corpus_pipeline.encoding(spark, df, DATA).collect()
    assert len(encoded) == 9 and all(x["round_trip"] for x in encoded)
    assert corpus_pipeline.encoding(spark, df.limit(0), DATA).count() == 0


def test_queries_take_odd_rows(spark):
    df = odd_docs(spark)
    for f in (neardup.classes, pii.digests, shards.shard_documents, bpe.digests):
        assert f(df).count() == 9 and f(df.limit(0)).count() == 0
    assert quality.classified(df, labels(spark)).count() == 9
    assert [(x["doc_id"], x["licence"]) for x in licences.scan(df).collect()] == [(5, "CC-BY-4.0")]
    assert decontaminate.contaminated(df, benchmark(spark)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert html.extract(pages).count() == 4 and html.extract(pages.limit(0)).count() == 0
    talk = spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    assert chat.digests(talk).count() == 1
    vectors = spark.createDataFrame([(0, [1.0, None]), (100, [1.0, 2.0]), (100, [1.0, 1.0]), (None, [1.0]), (200, [1e300, 1e300]), (300, [3e38, 1e39]), (7, [float("nan"), 1.0]), (8, [])], "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = ann.nearest(vectors).collect()
    assert {(x["query_id"], x["vec_id"]) for x in got} == {(a, b) for a in (100, 200, 300) for b in (100, 200, 300) if a != b}


def test_shards_against_their_scores(spark):
    df = table(spark, DATA, "documents").select("doc_id", "text").union(spark.createDataFrame([(None, None), (None, "x"), (-5, "é")], "doc_id long, text string"))

    def best(key, n):
        score = lambda s: struct.unpack("<q", struct.pack("<Q", h(key, s)))[0]
        h = lambda k, s: xxhash.xxh64(struct.pack("<q", k), seed=one[s]).intdigest() if k is not None else one[s]
        one = [xxhash.xxh64(struct.pack("<i", s), seed=42).intdigest() for s in range(n)]
        return max(range(n), key=lambda s: (score(s), -s))

    texts = defaultdict(list)
    for x in df.collect():
        texts[x["doc_id"]].append((x["text"] or "").encode())
    got = shards.shard_documents(df).collect()
    slots = defaultdict(list)
    for x in got:
        raw = next(t for t in texts[x["doc_id"]] if zlib.crc32(t) == x["text_crc32"])
        assert (x["size"], x["law"]) == (len(raw) + 16, "key")
        assert (x["shard"], x["grown_shard"]) == (best(x["doc_id"], 40), best(x["doc_id"], 41))
        slots[x["shard"]].append(x["slot"])
    assert len(got) == sum(map(len, texts.values())) and all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- main text -----------------------------------------------------------------------------------------------------

PROSE = "The house at the end of the street is old and it was built by a man who had come from the sea with all that he had."
MENU = "Products Services Solutions Industries Partners Resources Company Careers Investors Support Downloads Contact Privacy Imprint Sitemap"


def two_passes(blocks):
    """The two passes on blocks ``(container, text, linked share)`` without any mark of place, step by step."""
    label = []
    for _, text, linked in blocks:
        words = text.lower().split()
        stop = sum(w.strip(".,;:!?") in html.STOP_WORDS for w in words) / len(words)
        if linked > 0.34:
            label.append(False)
        elif len(text) < 70:
            label.append(None)
        elif stop >= 0.2 or stop >= 0.05 and len(text) >= 200:
            label.append(True)
        else:
            label.append(None if stop >= 0.05 else False)
    out = []
    for i, (box, text, _) in enumerate(blocks):
        good = label[i]
        if good is None:
            near = [j for j in ([k for k in range(i) if label[k] is not None][-1:] + [k for k in range(i + 1, len(blocks)) if label[k] is not None][:1])]
            near.sort(key=lambda j: (blocks[j][0] != box, abs(j - i), not label[j]))
            good = bool(near) and label[near[0]]
        if good:
            out.append(text)
    return "\n".join(out)


def test_blocks_without_marks_against_two_plain_passes():
    r = random.Random(3)
    stop, rare = ["the", "of", "and", "in", "is", "to"], ["market", "window", "growth", "silver", "engine", "garden"]
    for _ in range(150):
        blocks, page = [], ""
        for box in range(r.randint(1, 4)):
            page += "<div>"
            for _ in range(r.randint(1, 5)):
                share = r.choice((0.0, 0.03, 0.1, 0.5))
                text = " ".join(r.choice(stop) if r.random() < share else r.choice(rare) for _ in range(r.choice((3, 8, 20, 60))))
                linked = r.random() < 0.15
                blocks.append((box, text, 1.0 if linked else 0.0))
                page += f"<p><a href='x'>{text}</a></p>" if linked else f"<p class=x{r.randint(0, 9)}>{text}</p>"
            page += "</div>"
        assert html.main_text(page) == two_passes(blocks)


def test_stop_words_decide_where_no_tag_does():
    assert html.main_text(f"<div><p>{MENU}</p></div><div><p>{PROSE}</p><p>Short line.</p></div><div><p>{MENU}</p></div>") == f"{PROSE}\nShort line."
    assert html.main_text(f"<article></article><div><p>{PROSE}</p></div>") == PROSE


def test_linked_prose_stays_and_attributes_have_any_length():
    linked = "<a href=1>The report of the agency on the state of the rivers</a> was read out by all of <a href=2>the people of the town on the hill</a> in May."
    plain = re.sub("<[^>]+>", "", linked)
    assert html.main_text(f"<article><p>{PROSE}</p><p>{linked}</p><p><a href=3>How the man of the house came to the sea and what he had to say of it</a></p></article>") == f"{PROSE}\n{plain}"
    assert html.main_text(f"<article><p data-x=\"{'y' * 9000}> leaked words\">{PROSE}</p></article>") == PROSE
    begun = time.time()
    for page in ("<p x='" * 20_000, "<p x=\"" + "<a b=" * 50_000, "<p " * 100_000, f"<p title=it's>{PROSE}</p><p>it's</p>" * 2000):
        html.main_text(page)
    assert time.time() - begun < 20


# --- personal data -------------------------------------------------------------------------------------------------


def test_context_decides_weak_spans_and_many_matches_stay_cheap(spark):
    many = " ".join(f"user{i}@mail{i % 7}.org, then é" for i in range(16_000))
    texts = ["my ssn is 123-45-6789.", "order 123-45-6789 came", "ssn 000-12-3456", many]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    begun = time.time()
    got = {x["doc_id"]: x for x in pii.digests(df).collect()}
    assert got[0]["spans"] == "ssn:10:21" and got[1]["spans"] == got[2]["spans"] == ""
    spans = [tuple(map(int, s.split(":")[1:])) for s in got[3]["spans"].split(",")]
    assert spans == [m.span() for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.org", many)]
    out = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert out[3] == re.sub(r"[a-z0-9]+@[a-z0-9]+\.org", "[EMAIL]", many) and out[0] == "my ssn is [SSN]."
    assert time.time() - begun < 60


def test_overlapping_spans_become_one(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdé ") for _ in range(4000))
    spans = [(r.choice(pii.KINDS), a := r.randrange(3990), a + r.randint(1, 9)) for _ in range(700)]
    marks = sorted((a, -b, k) for k, a, b in spans)
    want, at = "", 0
    for a, b, k in marks:
        if a >= at:
            want += text[at:a] + f"[{k.upper()}]"
        at = max(at, -b)
    df = spark.createDataFrame([(text, [(k, a, b, 1.0) for k, a, b in spans])], "text string, s array<struct<kind:string,start:int,end:int,score:double>>")
    assert df.select(pii.redacted(F.col("text"), F.col("s"))).first()[0] == want + text[at:]


# --- decontamination -----------------------------------------------------------------------------------------------

MARKS = "\"'()[]{}<>.,;:!?*#&%$|"


def plain_words(text):
    """Words with kind and value, as the template rules say."""
    out, opens, number = [], True, False
    for piece in re.split(r"([ \t\n\r\f\v\x1c-\x1f]+)", text):
        if not piece:
            continue
        if not piece.strip("\t\n\r\f\v\x1c\x1d\x1e\x1f "):
            opens |= "\n" in piece
            continue
        w = piece
        for _ in range(4):
            w = w[:-1] if len(w) > 1 and w[-1] in MARKS else w
        for _ in range(2):
            w = w[1:] if len(w) > 1 and w[0] in MARKS else w
        low = w.lower()
        kind = "<number>" if w[0].isdigit() else "<unit>" if number and low in decontaminate.UNITS else "<name>" if w[0].isupper() and not opens and len(w) > 1 and w[-1].islower() else low
        number = w[0].isdigit()
        out.append((kind, low, opens))
        opens = piece[-1] in ".!?:;"
    return out


def plain_contaminated(doc, item):
    d, i = plain_words(doc), plain_words(item)
    n, w = len(i), decontaminate.WIDTH
    if not n:
        return False
    if n < w:
        return any([x[1] for x in d[a : a + n]] == [x[1] for x in i] and d[a][2] and (a + n == len(d) or d[a + n][2]) for a in range(len(d) - n + 1))
    slot = lambda x: x[0] != x[1]
    exact = [sum(not slot(x) for x in i[p : p + w]) < decontaminate.PLAIN for p in range(n - w + 1)]
    by = defaultdict(list)
    for a in range(len(d) - w + 1):
        for p in range(n - w + 1):
            if [x[1 if exact[p] else 0] for x in d[a : a + w]] == [x[1 if exact[p] else 0] for x in i[p : p + w]]:
                by[a - p].append(p)
    covered, run = set(), 0
    for at, ps in by.items():
        met = {(i[p + k][1], d[at + p + k][1]) for p in ps if not exact[p] for k in range(w) if slot(i[p + k])}
        steady = len({x for x, _ in met}) == len(met)
        slotted = {p for p in ps if not exact[p] and any(slot(x) for x in i[p : p + w])}
        free = {p for p in ps if not exact[p]} - slotted
        held = free | slotted if steady else free
        same = {p for p in ps if [x[1] for x in i[p : p + w] if slot(x)] == [x[1] for x in d[at + p : at + p + w] if slot(x)]}
        covered |= held
        begin = last = None
        for p in sorted(held | {p for p in ps if exact[p]} | same):
            begin = p if last is None or p - last > w else begin
            last = p
            run = max(run, p + w - begin)
    template = [p for p in range(n - w + 1) if not exact[p]]
    return bool(template) and len(covered) >= decontaminate.COVERAGE * len(template) or run >= min(decontaminate.RUN, n)


def test_contamination_against_plain_templates(spark):
    r = random.Random(5)
    plain = "river stone house garden window silver market engine paper letter".split()
    names, units = "Ann Bob Carl Dora Emil".split(), "kg km hours dollars".split()

    def item():
        out = []
        for _ in range(r.choice((2, 3, 4, 6, 12, 25))):
            k = r.random()
            out += [str(r.randint(1, 30))] + ([r.choice(units)] if r.random() < 0.5 else []) if k < 0.25 else [r.choice(names)] if k < 0.45 else [r.choice(plain)]
        return " ".join(out)

    def changed(t):
        one, two = dict(zip(names, r.sample(names, 5), strict=True)), {}
        out = [one.get(x, x) if not x.isdigit() else two.setdefault(x, str(r.randint(1, 99))) for x in t.split()]
        for _ in range(r.choice((0, 0, 1, 3))):
            out[r.randrange(len(out))] = r.choice(plain + names + ["7"])
        return " ".join(out[: r.choice((99, 99, 14, 8))])

    items = [item() for _ in range(25)] + ["Alice has 12 kg Bob has 14 kg Carol has 15 kg", "Yes.", "What is 7?", "one two three four"]
    docs = [f"{sentence_of(r, plain)}. {r.choice((changed, str))(t)}{r.choice(('.', ' ', chr(10)))} {sentence_of(r, plain)}" for t in items for _ in range(4)] + ["Yes.", "yes it is", "It is so. What is 7? Well"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, spark.createDataFrame(list(enumerate(items)), BENCH)).collect()}
    want = {(a, b) for a, d in enumerate(docs) for b, t in enumerate(items) if plain_contaminated(d, t)}
    assert got == want and len(want) > 40


def sentence_of(r, words):
    return " ".join(r.choice(words) for _ in range(12))


def test_text_hash_tells_nulls(spark):
    rows = spark.createDataFrame([(1, None, "en"), (1, "en", None)], "doc_id long, text string, lang string")
    assert rows.select(quality._row_key()).distinct().count() == 2
