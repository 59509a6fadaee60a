"""Tool events: targets, what is text and what is not, context of values, sizes of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig
from textwarden.operators.scan import scan
from textwarden.operators.spans import dedupe_spans, merge_spans

# The fields of a tool's input that say what it is about, in order.
TARGET_KEYS = ("file_path", "notebook_path", "path", "url")
#: Characters of a value that are read again with its key before it.
FRAMED_CHARS = 4_096


def target_of(tool_input: Column) -> Column:
    """What an event is about: the first of its fields that is not empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(tool_input, f"$.{k}"), F.lit("")) for k in TARGET_KEYS])


def opaque(leaves: DataFrame) -> DataFrame:
    """Leaves (``path, text, sibling_type``) without base64 image data and signatures of thinking."""
    name = F.element_at("path", -1)
    hidden = ((name == "data") & (F.col("sibling_type") == "base64")) | ((name == "signature") & (F.col("sibling_type") == "thinking"))
    return leaves.where(~F.coalesce(hidden, F.lit(False)))


def shrinkable(events: DataFrame) -> DataFrame:
    """Inbound results of network or remote tools, not only observed, on clients that can rewrite them."""
    remote = F.col("tool_name").startswith("mcp__") | F.col("tool_name").isin("WebFetch", "WebSearch")
    return events.where((F.col("direction") == "inbound") & remote & (F.col("mode") != "observe") & F.col("can_rewrite"))


def scan_with_keys(leaves: DataFrame, keys: list[str], config: ScanConfig | None = None) -> DataFrame:
    """Findings of leaves (``name, text``), each read a second time with its key before it.

    The key adds context and takes nothing away: findings of the framed reading
    are moved back, clipped to the value, and merged with those of the plain one.
    """
    prefix = F.concat(F.lit('"'), F.col("name"), F.lit('": "'))
    framed = leaves.where("name is not null").select(*keys, F.length(prefix).alias("_shift"), F.concat(prefix, F.substring("text", 1, FRAMED_CHARS), F.lit('"')).alias("text"), F.least(F.length("text"), F.lit(FRAMED_CHARS)).alias("_chars"))
    plain = scan(leaves, "text", keys, config)
    moved = scan(framed, "text", [*keys, "_shift", "_chars"], config)
    start, end = F.greatest(F.col("value_start") - F.col("_shift"), F.lit(0)), F.least(F.col("value_end") - F.col("_shift"), F.col("_chars"))
    moved = moved.select(*keys, "entity", start.alias("start"), end.alias("end"), "score", "label").where("start < end")
    both = plain.select(*keys, "entity", F.col("value_start").alias("start"), F.col("value_end").alias("end"), "score", "label").unionByName(moved)
    return merge_spans(dedupe_spans(both, keys), keys)


def tool_result_size(content: Column) -> Column:
    """UTF-8 bytes of the text of a result, a string or a list of parts, given as JSON."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    of_parts = F.aggregate(parts, F.lit(0), lambda total, p: total + F.coalesce(F.octet_length(p["text"]), F.lit(0)))
    as_text = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]
    return F.when(content.rlike(r"^\s*\["), of_parts).otherwise(F.octet_length(as_text))


def at_file_totals(requests: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Files that requests carry inlined in reminder blocks: how many and how many bytes."""
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)<system-reminder>(.*?)</system-reminder>"), F.lit(1)), lambda b: b.contains("Called the Read tool") | b.contains("Result of calling the Read tool"))
    rows = requests.select(*keys, blocks.alias("b"))
    return rows.groupBy(*keys).agg(F.sum(F.size("b")).alias("n_files"), F.sum(F.aggregate("b", F.lit(0), lambda total, x: total + F.octet_length(x))).alias("bytes"))


def model_output_counts(turns: DataFrame, config: ScanConfig | None = None, most: int = 100_000) -> DataFrame:
    """Entities in the last message of each turn (``session_id, turn, text``), its first characters read, and whether it was longer."""
    read = turns.withColumn("_long", F.length("text") > most).withColumn("text", F.substring("text", 1, most))
    found = scan(read, "text", ["session_id", "turn", "_long"], config)
    return found.groupBy("session_id", "entity").agg(F.count("*").alias("n"), F.max("_long").alias("truncated"))


def env_state(entries: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """``path, line, name, state, entities``: what a variable's value holds, found past its name; the value itself goes.

    ``entries``: ``path, line, name, value``.
    """
    value = F.col("value")
    state = F.when(value.isNull() | (value == ""), "empty").when(value.rlike(r"^\$\{?\w+\}?$"), "ref").otherwise("set")
    texts = entries.withColumn("_text", F.concat("name", F.lit("="), F.coalesce("value", F.lit(""))))
    found = scan(texts, "_text", ["path", "line", "name"], config).where(F.col("start") >= F.length("name") + 1)
    kinds = found.groupBy("path", "line", "name").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    return entries.withColumn("state", state).join(kinds, ["path", "line", "name"], "left").select("path", "line", "name", "state", F.coalesce("entities", F.expr("cast(array() as array<string>)")).alias("entities"))
