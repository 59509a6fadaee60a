"""Audit of agent transcripts: what reached the model, and by which door."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.checks import is_json

BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,content:string,is_error:boolean>"
LINE = f"type string, cwd string, timestamp string, isCompactSummary boolean, message struct<role:string,content:string>, attachment struct<type:string,filename:string,displayPath:string,content:string,snippet:string,prompt:string>"
#: Bytes of a line beyond which it is counted and not read.
MOST_LINE_BYTES = 8_000_000


def parse_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, skipped)``: lines (``session_id, file, is_subagent, line_no, raw``) parsed, and how many a file could not be."""
    good = (F.octet_length("raw") <= MOST_LINE_BYTES) & F.col("raw").rlike(r"^\s*\{") & is_json(F.col("raw"))
    marked = lines.withColumn("good", F.coalesce(good, F.lit(False)))
    records = marked.where("good").withColumn("r", F.from_json("raw", LINE)).select("session_id", "file", "is_subagent", "line_no", "r.*").withColumn("ts", F.try_to_timestamp("timestamp"))
    return records, marked.where(~F.col("good") & (F.trim("raw") != "")).groupBy("session_id", "file").agg(F.count("*").alias("skipped"))


def _blocks(records: DataFrame) -> DataFrame:
    """Content blocks of messages; a content that is one string is one text block."""
    content = F.col("message.content")
    as_blocks = F.when(content.rlike(r"^\s*\["), F.from_json(content, f"array<{BLOCK}>")).otherwise(F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), BLOCK)))
    return records.where(content.isNotNull()).select("session_id", "file", "is_subagent", "line_no", "ts", "type", F.col("isCompactSummary").alias("summary"), F.posexplode(as_blocks).alias("block_no", "b"))


def name_tool_results(blocks: DataFrame) -> DataFrame:
    """Tool results with the name of the latest earlier tool use of their id in the same file, else ``unknown tool``."""
    uses = blocks.where("b.type = 'tool_use'").select("file", F.col("b.id").alias("id"), "line_no", "block_no", F.col("b.name").alias("name"), F.lit(None).cast("struct<a:int>").alias("result"))
    by = Window.partitionBy("file", "id").orderBy("line_no", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    results = blocks.where("b.type = 'tool_result'").select("*", F.col("b.tool_use_id").alias("id"), F.lit(None).cast("string").alias("name"))
    both = results.unionByName(uses.drop("result"), allowMissingColumns=True)
    return both.withColumn("tool", F.coalesce(F.last("name", ignorenulls=True).over(by), F.lit("unknown tool"))).where("b is not null").drop("id", "name")


def extract_texts(records: DataFrame) -> DataFrame:
    """``session_id, file, line_no, ts, kind, door, text``: what a person or tool sent to the model, and its output.

    Compact summaries and the prompts of subagents are left out.
    """
    blocks = _blocks(records)
    columns = ["session_id", "file", "line_no", "ts"]
    prompts = blocks.where("type = 'user' and b.type = 'text' and not is_subagent and not coalesce(summary, false)").select(*columns, F.lit("reached").alias("kind"), F.lit("your prompt").alias("door"), F.col("b.text").alias("text"))
    results = name_tool_results(blocks)
    # The content of a result is a string or a list of parts.
    parts = F.when(F.col("b.content").rlike(r"^\s*\["), F.array_join(F.transform(F.from_json("b.content", "array<struct<type:string,text:string>>"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")).otherwise(F.col("b.content"))
    tools = results.select(*columns, F.lit("reached").alias("kind"), F.concat(F.when(F.col("b.is_error"), "failed ").otherwise(""), "tool").alias("door"), parts.alias("text"))
    output = blocks.where("type = 'assistant' and b.type in ('text', 'thinking')").select(*columns, F.lit("output").alias("kind"), F.lit("model output").alias("door"), F.coalesce("b.text", "b.thinking").alias("text"))
    attached = F.coalesce("attachment.content", "attachment.snippet", "attachment.prompt")
    door = F.when(F.col("attachment.type") == "queued_command", "queued command").when(F.col("attachment.type") == "edited_text_file", "edited file").otherwise("@file")
    files = records.where("type = 'attachment'").select(*columns, F.lit("reached").alias("kind"), door.alias("door"), attached.alias("text"))
    return prompts.unionByName(tools).unionByName(output).unionByName(files).where("text is not null and text != ''")


def project_filter(records: DataFrame, project: str) -> DataFrame:
    """Records of sessions whose first working folder is ``project`` or lies below it."""
    root = project.rstrip("/")
    first = records.where("not is_subagent and cwd is not null").groupBy("session_id").agg(F.min_by("cwd", "line_no").alias("cwd"))
    inside = first.where((F.col("cwd") == (root or "/")) | F.col("cwd").startswith(root + "/")).select("session_id")
    return records.join(inside, "session_id", "left_semi")


def since_filter(records: DataFrame, since) -> DataFrame:
    """Records from a moment on; those without a time stay, sessions without any time go."""
    kept = records.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(since)))
    timed = kept.groupBy("session_id").agg(F.max("ts").alias("last")).where("last is not null").select("session_id")
    return kept.join(timed, "session_id", "left_semi")


def audit_rollup(found: DataFrame) -> DataFrame:
    """Counts by entity, entity and door, project and entity, session and entity, over ``project, door, session, entity``.

    Rows are counted to the finest level first, so the grouping sets expand few rows.
    """
    finest = found.groupBy("project", "door", "session", "entity").agg(F.count("*").alias("n"))
    sets = [["entity"], ["entity", "door"], ["project", "entity"], ["session", "entity"]]
    grouped = finest.groupingSets([[F.col(c) for c in s] for s in sets], "entity", "door", "project", "session")
    return grouped.agg(F.sum("n").alias("n"), F.count_distinct(finest["session"]).alias("n_sessions"))


def top_doors(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k doors of each entity with most findings, and how many more there are."""
    by = Window.partitionBy("entity").orderBy(F.desc("n"), "door")
    doors = F.count("*").over(Window.partitionBy("entity"))
    return counts.withColumn("place", F.row_number().over(by)).withColumn("more", F.greatest(doors - k, F.lit(0))).where(F.col("place") <= k)


def masked_per_session(sessions: DataFrame, live: DataFrame, ledger: DataFrame) -> DataFrame:
    """``sessions`` with ``masked``: the larger of what its live and its ledger records masked, joined by session key."""
    key = F.substring(F.sha2("session_id", 256), 1, 32)
    sums = lambda records, name: records.where("action = 'mask'").groupBy("session_key").agg(F.sum("n").alias(name))
    joined = sessions.withColumn("session_key", key).join(sums(live, "live"), "session_key", "left").join(sums(ledger, "kept"), "session_key", "left")
    return joined.withColumn("masked", F.greatest(F.coalesce("live", F.lit(0)), F.coalesce("kept", F.lit(0)))).drop("live", "kept")


def forget_sessions(history: DataFrame, purge: DataFrame) -> DataFrame:
    """History without the sessions to be forgotten."""
    return history.join(purge.select("session_id").distinct(), "session_id", "left_anti")


def verdict(n, skipped, uninspected):
    """``findings``, ``incomplete`` or ``safe``: what was not inspected is never safe."""
    return F.when(n > 0, "findings").when(skipped + uninspected > 0, "incomplete").otherwise("safe")
