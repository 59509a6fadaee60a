"""Totals of reports: sections, responses, stop reasons, bounds of audits, orders of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ways in which a stop for lack of room is spelled.
TRUNCATED = ("max_tokens", "length", "max_output_tokens")
#: Days after which a table of prices is out of date.
STALE_DAYS = 90


def section_totals(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Size of each section (``name, bytes``) over all requests of a key, its requests, and its share of the key's bytes."""
    sums = sections.groupBy(*keys, "name").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_requests"))
    whole = F.sum("bytes").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return sums.withColumn("share", F.round(F.col("bytes") / F.nullif(whole, F.lit(0)), 6))


def entity_section_totals(found: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (``entity, section, n``) by section."""
    return found.groupBy(*keys, "section", "entity").agg(F.sum("n").alias("n"))


def response_totals(found: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (``entity, kind, n``) of responses by kind: text, thinking, tool input."""
    return found.groupBy(*keys, "kind", "entity").agg(F.sum("n").alias("n"))


def custom_totals(records: DataFrame, keys: list[str], custom: str = "custom") -> DataFrame:
    """Counts of the user's own patterns by label, from maps of label to count."""
    return records.select(*keys, F.explode(custom).alias("label", "n")).groupBy(*keys, "label").agg(F.sum("n").alias("n"))


def stop_reason_totals(responses: DataFrame, keys: list[str], reason: str = "stop_reason") -> DataFrame:
    """Responses by the reason they stopped; those without one are left out."""
    return responses.where(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count("*").alias("n"))


def truncated_share(responses: DataFrame, keys: list[str], reason: str = "stop_reason") -> DataFrame:
    """Of the responses with a reason, how many stopped for lack of room."""
    known = responses.where(F.col(reason).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_known"), F.count_if(F.col(reason).isin(*TRUNCATED)).alias("n_truncated"))
    return known.withColumn("truncated_share", F.round(F.col("n_truncated") / F.col("n_known"), 6))


def bare_number_totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """Bare numbers of all records but those of model output."""
    kept = F.when(F.coalesce(F.col("direction") != "model_output", F.lit(True)), F.col("bare_numbers"))
    return records.groupBy(*keys).agg(F.coalesce(F.sum(kept), F.lit(0)).alias("bare_numbers"))


def audit_bounds(texts: DataFrame, keys: list[str]) -> DataFrame:
    """First and last moment, texts, bytes, and what was skipped or not inspected, over ``ts, text, skipped, inspected``."""
    return texts.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_texts"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
        F.count_if(~F.coalesce("inspected", F.lit(False))).alias("uninspected"),
    )


def ranked(counts: DataFrame, name: str, by: list[str] | None = None, total: str = "n") -> DataFrame:
    """Rows with their place by falling total, then name."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(total), name)
    return counts.withColumn("place", F.row_number().over(order))


def projects_by_total(found: DataFrame) -> DataFrame:
    """Projects by falling number of findings (``project, n``), then name."""
    return ranked(found.groupBy("project").agg(F.sum("n").alias("n")), "project")


def top_sources(counts: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k places of a key with most events (``place_name, n``), as one line, and how many more there are."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "place_name")
    best = counts.withColumn("_no", F.row_number().over(order)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_no") <= k, F.struct("_no", "place_name")))).alias("_top"), F.count("*").alias("n_sources")
    )
    more = F.greatest(F.col("n_sources") - k, F.lit(0))
    names = F.array_join(F.transform("_top", lambda x: x["place_name"]), ", ")
    return best.select(*keys, F.when(more > 0, F.concat(names, F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(names).alias("sources"))


def in_ledger_order(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with ``ordinal``: by moment, then file and place in it; a late line falls where its moment is."""
    return records.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "file", "file_pos")))


def late_records(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records that were written after one with a later moment, as ``late`` in the order of writing."""
    written = Window.partitionBy(*keys).orderBy("file", "file_pos").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("late", F.coalesce(F.col("ts") < F.max("ts").over(written), F.lit(False)))


def new_since_summary(records: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Records after the one that the last summary of their key ended with (``mark``, an ordinal); all where there was none."""
    m = marks.groupBy(*keys).agg(F.max("mark").alias("mark"))
    return records.join(m, keys, "left").where(F.col("ordinal") > F.coalesce("mark", F.lit(0))).drop("mark")


def in_finding_order(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with ``no``: by start, end and type within their text."""
    return findings.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "entity")))


def payload_bytes(before: Column, after: Column) -> Column:
    """UTF-8 sizes of a payload before and after it was changed."""
    return F.struct(F.coalesce(F.octet_length(before), F.lit(0)).alias("in_bytes"), F.coalesce(F.octet_length(after), F.lit(0)).alias("out_bytes"))


def prices_stale(checked: Column, today: Column) -> Column:
    """Whether a table of prices was last checked more than STALE_DAYS days ago."""
    return F.coalesce(F.datediff(today, checked) > STALE_DAYS, F.lit(True))


def report(found: DataFrame) -> DataFrame:
    """One JSON document a project: its sessions with their findings by type, over ``project, session, entity, n``."""
    by_session = found.groupBy("project", "session", "entity").agg(F.sum("n").alias("n"))
    sessions = by_session.groupBy("project", "session").agg(F.array_sort(F.collect_list(F.struct("entity", "n"))).alias("counts"), F.sum("n").alias("n"))
    # Sessions are sorted by name, and maps can't be, so their counts go in as JSON text.
    entities = F.to_json(F.map_from_entries("counts"))
    projects = sessions.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("session", "n", entities.alias("entities")))).alias("sessions"), F.sum("n").alias("n"))
    one = lambda x: F.concat(F.lit('{"session":"'), F.regexp_replace(x["session"], r'(["\\\\])', r"\\\\$1"), F.lit('","n":'), x["n"].cast("string"), F.lit(',"entities":'), x["entities"], F.lit("}"))
    return projects.select("project", "n", F.concat(F.lit('{"sessions":['), F.array_join(F.transform("sessions", one), ","), F.lit("]}")).alias("document"))


def write_report(found: DataFrame, path: str) -> None:
    """The report as JSON lines, one a project."""
    report(found).select("document").write.mode("overwrite").text(path)
