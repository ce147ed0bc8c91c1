"""Personal data by rule: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a DataFrame expression. Positions come from one pass per kind: the text split at the matches gives the
gaps, the matches give the lengths, and their running sum gives the offsets, in code points. The patterns are written
so that a failing attempt costs no more than the run of characters it starts in (possessive quantifiers, and attempts
only where a run begins or the last match ended), so that very long texts and runs stay linear.

Kinds: ``email``, ``ip`` (parts at most 255), ``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits) are the base;
``iban`` (mod 97) and ``ssn`` are added. A span holds ``kind, start, end, score``; ``end`` is exclusive. A score starts
from the kind's own, rises where a checksum holds and where a context word stands in the WINDOW code points before or
after the match, as far as the neighbouring matches of its kind; spans below LEAST go. The base kinds start at LEAST, so
all of them stay; the form of an ``ssn`` alone says too little, so it needs a context word.

Arrays grow in runs of RUN matches, and every piece of text is cut out of the gap or run it lies in, so a text with very
many matches costs little more than its length. Null texts count as empty and have no spans. Repeated rows give the same
spans each. Extra columns, of any name, are left alone. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernel as K

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = r"A-Za-z0-9._%+-"
_PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
}
#: A cheap test that every text with a match passes; the pattern runs only on those.
_HINT = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
#: Words that, within WINDOW code points before or after a span, raise its score.
CONTEXT = {
    "email": ["mail", "email", "contact", "correo", "courriel", "kontakt"],
    "ip": ["ip", "host", "server", "address", "login", "serveur"],
    "card": ["card", "visa", "credit", "payment", "carte", "karte", "tarjeta"],
    "phone": ["phone", "call", "tel", "mobile", "telefon", "appel"],
    "iban": ["iban", "bank", "account", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social", "security"],
}
WINDOW = 40
#: Score of a span: by its pattern, with a checksum that holds, and with a context word near by.
BY_PATTERN, BY_CHECKSUM, BY_CONTEXT, LEAST = 0.6, 0.25, 0.15, 0.6
#: Own scores of kinds whose form says less.
WEAK = {"ssn": 0.45}
#: Matches of one run.
RUN = 256


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.try_element_at(F.array(*[F.lit((2 * k) // 10 + (2 * k) % 10) for k in range(10)]), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number (spaces dropped) leaves the remainder 1 by 97, its first four characters moved to the end and letters read as 10 to 35."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(value < 10, (rest * 10 + value) % 97).otherwise((rest * 100 + value) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        # parts longer than any number up to 255, zeros in front aside, fail as they are; the rest is compared
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        d = digits_of(match)
        return F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19))
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & mod97(match)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _runs(rows: Column) -> Column:
    """An array in runs of RUN elements."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / RUN).cast("int")), lambda b: F.slice(rows, b * RUN + 1, RUN))


def _before(values: Column) -> Column:
    """For each of a few values, the sum of those before it."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind that reach LEAST, leftmost first, never overlapping each other; a match that fails is dropped and not retried."""
    found = F.regexp_extract_all(text, F.lit(_PATTERN[kind]), F.lit(0))
    context = rf"(?<![a-z])(?:{'|'.join(CONTEXT[kind])})(?![a-z])"
    own = WEAK.get(kind, BY_PATTERN) + (BY_CHECKSUM if kind in ("ip", "card", "iban") else 0.0)

    def placed(gaps: Column) -> Column:
        # each match with the gap before it and what of both gaps is near it
        near = lambda i: F.lower(F.concat(F.right(F.get(gaps, i), F.lit(WINDOW)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(WINDOW))))
        each = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), near(i).rlike(context).alias("hit")))

        def numbered(runs: Column) -> Column:
            begin = _before(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda s, x: s + x["gap"] + x["n"])))
            empty = F.array().cast("array<struct<m:string,start:int,end:int,hit:boolean>>")
            step = lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(x["m"].alias("m"), (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end"), x["hit"].alias("hit")))).alias("out"))
            return F.flatten(F.zip_with(runs, begin, lambda r, at: F.aggregate(r, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])))

        return _let(_runs(each), numbered)

    score = lambda x: F.round(F.lit(own) + F.when(x["hit"], BY_CONTEXT).otherwise(0.0), 2)
    good = F.filter(_let(F.split(text, _PATTERN[kind], -1), placed), lambda x: _confirmed(kind, x["m"]) & (score(x) >= LEAST))
    out = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
    return F.when(text.rlike(_HINT[kind]), out).otherwise(F.array().cast(_SPANS))


def find(docs: DataFrame, text: str = "text", into: str = "pii", kinds: Sequence[str] = KINDS) -> DataFrame:
    """``docs`` with an array column of spans, ordered by kind as listed, then start."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(into, F.concat(*[spans_of(whole, k) for k in kinds]))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))

    def step(s: Column, x: Column) -> Column:
        end = -x["last"]
        piece = F.array(F.left(s["rest"], x["start"] - s["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.when(x["start"] >= s["at"], F.struct(end.alias("at"), F.substr(s["rest"], end - s["at"] + 1).alias("rest"), F.concat(s["out"], piece).alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], end).alias("at"), F.substr(s["rest"], F.greatest(end - s["at"], F.lit(0)) + 1).alias("rest"), s["out"].alias("out")))

    def joined(runs: Column) -> Column:
        # a run begins where all spans before it have ended, and takes the text up to the beginning of the next
        ends = F.transform(runs, lambda r: F.array_max(F.transform(r, lambda x: -x["last"])))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begin = F.aggregate(ends, state, lambda s, x: F.struct(F.greatest(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

        def each(begin: Column) -> Column:
            def one(r: Column, i: Column) -> Column:
                at = F.get(begin, i)
                to = F.coalesce(F.get(begin, i + 1), F.length(text))
                start = F.struct(at.alias("at"), F.substr(text, at + 1, to - at).alias("rest"), F.array().cast("array<string>").alias("out"))
                return F.aggregate(r, start, step, lambda s: F.concat(F.array_join(s["out"], ""), s["rest"]))

            return F.array_join(F.transform(runs, one), "")

        return _let(begin, each)

    return F.when(F.size(by_start) > 0, _let(_runs(by_start), joined)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]`` and ``n_chars`` brought up to date; a null text stays null."""
    row = K.keyed(docs, body=F.col("text").cast("string"))
    found = find(row, text="body", into="pii")
    some = F.size("pii") > 0
    new = {"text": redacted(F.col("body"), F.col("pii"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[F.when(some, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, the base counts, ``base_sha256``, ``spans`` and the scored spans."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), into="pii")
    key = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("pii", lambda s: s["kind"].isin(*BASE)), key), ",")
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("pii", key), ",").alias("spans"), scores)

