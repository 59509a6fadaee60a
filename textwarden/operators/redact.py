"""Replace found values by numbered placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.scans import between, replaced

#: Types whose values are the same whatever their layout.
LAYOUT_FREE = ("IBAN", "CREDIT_CARD", "PHONE", "SSN", "NATIONAL_ID", "TAX_ID", "MAC_ADDRESS", "LICENSE_PLATE")
MOST_NUMBER = 1_000_000


def value_key(entity: Column, value: Column) -> Column:
    """What makes two values the same: letters and digits in upper case for types without a layout."""
    return F.when(entity.isin(*LAYOUT_FREE), F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))).otherwise(value)


def placeholder_names(text: Column) -> Column:
    """``(entity, number)`` of each placeholder in a text, in order."""
    pattern = r"<([A-Z][A-Z_]*)_([0-9]{1,6})(?::[0-9]{1,4})?>"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("entity"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("number"))
    return F.transform(pairs, lambda p: F.struct(p["entity"].alias("entity"), p["number"].cast("int").alias("number")))


def number_values(findings: DataFrame, scope: list[str], position: list[str], floors: DataFrame | None = None) -> DataFrame:
    """``findings`` (with ``entity, value``) with ``number``: by first appearance of its value in the scope.

    ``floors`` (``scope, entity, floor``) holds the highest numbers already
    written in the scope; numbers go on above them.
    """
    keyed = findings.withColumn("_key", value_key(F.col("entity"), F.col("value")))
    first = F.min(F.struct(*position)).over(Window.partitionBy(*scope, "entity", "_key"))
    order = Window.partitionBy(*scope, "entity").orderBy("_first")
    numbered = keyed.withColumn("_first", first).withColumn("number", F.dense_rank().over(order))
    if floors is not None:
        numbered = numbered.join(floors, [*scope, "entity"], "left").withColumn("number", F.col("number") + F.coalesce("floor", F.lit(0))).drop("floor")
    return numbered.drop("_key", "_first")


def written_floors(df: DataFrame, text: str, scope: list[str]) -> DataFrame:
    """The highest number below a million that placeholders in the texts of a scope already have."""
    names = df.select(*scope, F.explode(placeholder_names(F.col(text))).alias("p"))
    return names.where(F.col("p.number") < MOST_NUMBER).groupBy(*scope, F.col("p.entity").alias("entity")).agg(F.max("p.number").alias("floor"))


def reveal_tail(value: Column, count: int) -> Column:
    """The last ``count`` digits of a value."""
    return F.right(F.regexp_replace(value, "[^0-9]", ""), F.lit(count))


def redact(df: DataFrame, text: str, keys: list[str], findings: DataFrame, reveal: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``redacted``: each finding (with ``start, end, entity, number``) as ``<TYPE_n>``.

    Types in ``reveal`` end in their last digits; line breaks of a span follow
    its placeholder. Without findings the text stays.
    """
    reveal = reveal or {}
    tail = F.lit("")
    for entity, n in reveal.items():
        tail = F.when(F.col("entity") == entity, F.concat(F.lit(":"), reveal_tail(F.col("value"), n))).otherwise(tail)
    name = F.concat(F.lit("<"), "entity", F.lit("_"), F.col("number").cast("string"), tail, F.lit(">"))
    spans = findings.withColumn("name", name).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("spans"))
    spans = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], "spans")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    whole = F.col(text)

    def placeholder(span: Column, chunked: Column) -> Column:
        return F.concat(span["name"], F.regexp_replace(between(chunked, span["start"], span["end"]), "[^\n]", ""))

    done = replaced(whole, F.col("spans"), placeholder)
    return df.join(spans, on, "left").withColumn("redacted", F.when(F.col("spans").isNull(), whole).otherwise(done)).drop("spans", *[f"_{k}" for k in keys])
