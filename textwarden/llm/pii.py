"""Personal data in text: patterns propose spans, checksums confirm them, nearby words score them.

Everything is a Spark expression on one row, so a scan needs no shuffle. Offsets
count code points: a text is split by a pattern, and the lengths of the pieces
and of the matches between them add up to the places of the matches. Sums and the words
right before a match come from one scan over the pieces, linear in the text however many
matches it has; so do redacted texts.

The patterns are possessive wherever the plain form would match the same text:
each kind is then found in time linear in the text and without deep recursion.

Defined cases: a null text has no spans; spans of different kinds may overlap
and all stay; repeated rows are scanned each; an empty table gives an empty
result; only the text column is read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.scans import let, replaced, scan

# The kinds of the base in their order, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")

_LOCAL = "A-Za-z0-9._%+-"
#: A match of local characters begins where a run of them begins, or where the last match ended.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text that lacks these has no match of the kind that could be kept.
GATES = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9][\x20().0-9-]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Words that, within CONTEXT code points before a span, make its kind likelier.
CONTEXT_WORDS = {
    "email": r"(?i)\b(e-?mail|contact|write|address)",
    "ip": r"(?i)\b(ip|host|server|address|client)",
    "card": r"(?i)\b(card|visa|master|credit|payment)",
    "phone": r"(?i)\b(phone|call|tel|mobile|fax)",
    "iban": r"(?i)\b(iban|bank|account|transfer)",
    "ssn": r"(?i)\b(ssn|social security)",
}
CONTEXT = 40
#: Score of a span without and with such a word; added kinds need ADDED_SCORE to be reported.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.8, 1.0), "ssn": (0.3, 0.8)}
ADDED_SCORE = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(char: Column, i: Column) -> Column:
        d = char.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 modulo 97."""
    compact = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        letter = (rest * 100 + code - 55) % 97
        return F.when(char == "", rest).when(code <= 57, (rest * 10 + code - 48) % 97).otherwise(letter)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # A part may be written with any number of leading zeros.
        return F.forall(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34) & mod97(value)
    return ~value.rlike("^(?:000|666|9)|-00-|-0000$")


def kind_spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: an array of ``(kind, start, end, score)`` in order of start."""
    pattern = PATTERNS[kind]
    plain, with_word = SCORES[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pieces: Column) -> Column:
        """Matches with their start and the text right before them, from what stands before each piece."""
        pairs = F.zip_with(pieces, matches, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"))
        both = lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.right(F.concat(a["near"], b["near"]), F.lit(CONTEXT)).alias("near"))

        def length(x: Column) -> Column:
            whole = F.concat(x["gap"], F.coalesce(x["value"], F.lit("")))
            return F.struct(F.length(whole).alias("at"), F.right(whole, F.lit(CONTEXT)).alias("near"))

        def place(x: Column, before: Column) -> Column:
            near = F.right(F.concat(before["near"], F.right(x["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
            return F.struct((before["at"] + F.length(x["gap"])).alias("at"), near.alias("near"), x["value"].alias("value"))

        return let(pairs, lambda p: F.filter(F.zip_with(p, scan(F.transform(p, length), zero, both), place), lambda x: x["value"].isNotNull()))

    def scored(x: Column) -> Column:
        score = F.when(x["near"].rlike(CONTEXT_WORDS[kind]), F.lit(with_word)).otherwise(F.lit(plain))
        return F.struct(F.lit(kind).alias("kind"), x["at"].alias("start"), (x["at"] + F.length(x["value"])).alias("end"), score.alias("score"))

    found = F.transform(F.filter(placed(F.split(text, pattern, -1)), lambda x: _confirmed(kind, x["value"])), scored)
    if kind in ADDED_KINDS:
        found = F.filter(found, lambda x: x["score"] >= ADDED_SCORE)
    gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
    return F.when(gate, found).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)"))


def find_personal_data(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the column ``__pii``: all confirmed spans, by kind as listed, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    by_kind = documents.withColumns({f"__pii_{kind}": kind_spans(whole, kind) for kind in BASE_KINDS + ADDED_KINDS})
    joined = F.concat(*[F.col(f"__pii_{kind}") for kind in BASE_KINDS + ADDED_KINDS])
    return by_kind.withColumn("__pii", joined).drop(*[f"__pii_{kind}" for kind in BASE_KINDS + ADDED_KINDS])


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(documents: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, the digest of base spans, all spans as text."""
    found = find_personal_data(documents.select("doc_id", "text"))
    base = F.filter("__pii", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("__pii", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("__pii")).alias("spans"), F.transform("__pii", lambda s: s["score"]).alias("scores"))


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with each span of ``text`` replaced by its kind in angle brackets; ``n_chars`` follows.

    Where spans overlap, the first by start (the longer on ties) gives the name
    and all their characters go. Texts without a span, nulls among them, stay as they are.
    """
    found = find_personal_data(documents)
    keyed = F.transform("__pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["end"].alias("end"), F.upper(s["kind"]).alias("name")))
    found = found.withColumn("__spans", F.array_sort(keyed))
    new_text = replaced(F.col("text"), F.col("__spans"), lambda span, _: F.concat(F.lit("<"), span["name"], F.lit(">")))
    found = found.withColumn("text", F.when(F.size("__pii") > 0, new_text).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        found = found.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*documents.columns)
