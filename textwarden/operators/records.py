"""Decision records: summaries of sessions, days and findings about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.operators.ranks import values_at

#: Namespace of published finding ids (version 5 UUIDs), as hex.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
EVIDENCE = 20
#: Kinds of session events: anything else is a record.
RECORD, TURN_END, SESSION_END = "record", "turn_end", "session_end"


def session_key(session_id: Column) -> Column:
    return F.substring(F.sha2(session_id, 256), 1, 32)


def finding_id(rule: Column, kind: Column, subject: Column) -> Column:
    """A version 5 UUID of ``rule|kind|subject``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(F.concat_ws("|", rule, kind, subject), "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def session_summary(records: DataFrame) -> DataFrame:
    """Entities by session and what was done (masked, unmasked, blocked, warned), model output apart."""
    done = F.when(F.col("action") == "mask", "masked").when(F.col("action") == "deny", "blocked").when(F.col("action") == "report", "warned").otherwise("unmasked")
    rows = records.select("session_id", done.alias("done"), (F.col("direction") == "model_output").alias("model_output"), F.explode("entities").alias("entity", "n"))
    return rows.groupBy("session_id", "done", "model_output", "entity").agg(F.sum("n").alias("n"))


def session_lives(events: DataFrame, idle_minutes: int, same: tuple[str, ...] = ()) -> DataFrame:
    """``events`` (``session_id, ts, seq, kind``) with ``life``: a session's events up to its end, or up to a pause longer than ``idle_minutes``.

    ``_pos`` is the place in the session, ``_end`` tells an end, ``_over`` the last event before a pause or the
    end of the data. An event that is repeated (same ``ts``, ``seq`` and columns ``same``) counts once, one without session or time not at all.
    Different events of one ``ts`` and ``seq`` come in the order of those columns, nulls first.
    """
    once = events.where("session_id is not null and ts is not null").withColumn("seq", F.coalesce("seq", F.lit(0))).dropDuplicates(["session_id", "ts", "seq", *same])
    by = Window.partitionBy("session_id").orderBy("ts", "seq", *same)
    pause = F.expr(f"interval {idle_minutes} minutes")
    kept = once.withColumns(
        {
            "_pos": F.row_number().over(by),
            "_end": F.coalesce(F.col("kind") == SESSION_END, F.lit(False)),
            "_before": F.lag("ts").over(by),
            "_after_end": F.coalesce(F.lag("kind").over(by) == SESSION_END, F.lit(False)),
            "_next": F.lead("ts").over(by),
        }
    )
    new = F.col("_before").isNull() | F.col("_after_end") | (F.col("ts") > F.col("_before") + pause)
    over = ~F.col("_end") & (F.col("_next").isNull() | (F.col("_next") > F.col("ts") + pause))
    return kept.withColumn("life", F.sum(new.cast("int")).over(by)).withColumn("_over", over).drop("_before", "_after_end", "_next")


def session_summaries(events: DataFrame, idle_minutes: int = 30, until: str | None = None) -> DataFrame:
    """A summary of a session at each end of a turn and when it has been quiet, if records came since the last one.

    ``events``: ``session_id, ts, seq, kind, done, entities``; see
    ``session_lives``. A session that ends is forgotten without a summary. ``n_records``
    and ``totals`` (done, type, count) are of the life so far, ``n_new`` of what came since
    the last summary. Sessions quiet since before ``until`` count as over, all if it is null.
    """
    lives = session_lives(events, idle_minutes)
    by_life = Window.partitionBy("session_id", "life").orderBy("_pos")
    is_turn = F.coalesce(F.col("kind") == TURN_END, F.lit(False))
    is_record = ~is_turn & ~F.col("_end")
    counted = lives.withColumn("n_records", F.sum(is_record.cast("long")).over(by_life))
    closes = F.col("ts") + F.expr(f"interval {idle_minutes} minutes")
    over = F.col("_over") & (F.lit(True) if until is None else closes <= F.lit(until).cast("timestamp"))
    marks = F.array_compact(F.array(F.when(is_turn, F.struct(F.col("ts").alias("at"), F.lit("turn").alias("reason"), F.lit(0).alias("rank"))), F.when(over, F.struct(closes.alias("at"), F.lit("idle").alias("reason"), F.lit(1).alias("rank")))))
    asked = counted.select("session_id", "life", "_pos", "n_records", F.explode(marks).alias("mark"))
    in_order = Window.partitionBy("session_id", "life").orderBy("_pos", "mark.rank")
    new = F.col("n_records") - F.coalesce(F.lag("n_records").over(in_order), F.lit(0))
    shown = asked.withColumn("n_new", new).where("n_new > 0").select("session_id", "life", "_pos", "n_records", "n_new", "mark.at", "mark.reason")
    # Totals so far: what each type of a life adds, and the summaries, in one order.
    added = lives.where(is_record).select("session_id", "life", "_pos", "done", F.explode("entities").alias("entity", "n")).where("n is not null")
    pairs = added.select("session_id", "life", "done", "entity").distinct()
    asks = shown.select("session_id", "life", "_pos", "reason").join(pairs, ["session_id", "life"])
    running = Window.partitionBy("session_id", "life", "done", "entity").orderBy("_pos", F.col("reason").isNotNull(), F.desc("reason")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = added.withColumn("reason", F.lit(None).cast("string")).unionByName(asks, allowMissingColumns=True)
    so_far = both.withColumn("n", F.sum("n").over(running)).where("reason is not null and n is not null")
    totals = so_far.groupBy("session_id", "life", "_pos", "reason").agg(F.array_sort(F.collect_list(F.struct("done", "entity", F.col("n").cast("long").alias("n")))).alias("totals"))
    none = F.expr("cast(array() as array<struct<done:string,entity:string,n:bigint>>)")
    return shown.join(totals, ["session_id", "life", "_pos", "reason"], "left").select("session_id", "at", "reason", "n_records", "n_new", F.coalesce("totals", none).alias("totals"))


def latency_stats(records: DataFrame, keys: list[str], value: str = "latency_ms", most_sorted: int | None = None) -> DataFrame:
    """Exact median and 95th percentile (the element at rank 0.95 * (n - 1), half to even) of valid latencies.

    One key may hold all rows: see ``ranks.values_at``.
    """
    valid = records.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < float("inf")))
    n = F.col("n")
    at = values_at(valid, keys, value, {"_lower": F.floor((n - 1) / 2), "_upper": F.floor(n / 2), "p95": F.rint(0.95 * (n - 1))}, most_sorted)
    return at.select(*keys, "n", (F.col("_lower") * 0.5 + F.col("_upper") * 0.5).alias("median"), "p95")


def ledger_by_day(records: DataFrame, ts: str = "ts") -> DataFrame:
    return records.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n_events"))


def session_windows(events: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes") -> DataFrame:
    """Stretches of events of a key with no gap longer than ``gap``."""
    return events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def record_ordinals(records: DataFrame) -> DataFrame:
    return records.withColumn("ordinal", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "file_pos")))


def newest_session(records: DataFrame) -> DataFrame:
    """The session with the latest record."""
    return records.agg(F.max_by("session_id", F.struct("ts", "session_id")).alias("session_id"))


def bytes_saved(records: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes that transforms took off, and about how many tokens those are."""
    saved = F.sum(F.when(F.size("transforms") > 0, F.greatest(F.col("in_bytes") - F.col("out_bytes"), F.lit(0))).otherwise(0))
    return records.groupBy(*keys).agg(saved.alias("bytes_saved")).withColumn("tokens_saved", F.expr("bytes_saved div 4"))


def marker_totals(records: DataFrame) -> DataFrame:
    return records.select("session_id", F.explode(F.array_distinct("markers")).alias("marker")).groupBy("session_id", "marker").agg(F.count("*").alias("n"))


def source_counts(records: DataFrame) -> DataFrame:
    """Places of each action: tool and base name of the target; URLs whole; prompts as ``your prompt``."""
    base = F.when(F.contains("target", F.lit("://")), F.col("target")).otherwise(F.element_at(F.split("target", r"[/\\]"), -1))
    place = F.when(F.col("direction") == "prompt", "your prompt").otherwise(F.concat_ws(" ", "tool_name", F.nullif(base, F.lit(""))))
    return records.groupBy("session_id", "action", place.alias("place")).agg(F.count("*").alias("n"))


def uninspected_counts(records: DataFrame) -> DataFrame:
    """Records by session that were not inspected, or have findings and an unknown action."""
    known = F.col("action").isin("allow", "report", "mask", "deny")
    not_seen = F.coalesce(F.col("note").startswith("not inspected"), F.lit(False))
    return records.groupBy("session_id").agg(F.count_if(not_seen | (~F.coalesce(known, F.lit(False)) & (F.size("entities") > 0))).alias("n_uninspected"), F.count_if(F.col("note") == "partial").alias("n_partial"))


def session_findings(records: DataFrame) -> DataFrame:
    """Three rules over the records of a session: values sent unmasked, events not inspected, injection markers."""
    with_no = record_ordinals(records)
    rules = F.array_compact(
        F.array(
            F.when((F.col("action") == "allow") & (F.size("entities") > 0) & (F.col("direction") != "model_output"), "sent-unmasked"),
            F.when(F.coalesce(F.col("note").startswith("not inspected"), F.lit(False)), "not-inspected"),
            F.when(F.size("markers") > 0, "injection-markers"),
        )
    )
    hits = with_no.withColumn("rule", F.explode(rules))
    # Only the first are gathered, however many a session has.
    nth = F.row_number().over(Window.partitionBy("session_id", "rule").orderBy("ordinal"))
    hits = hits.withColumn("_first", F.when(nth <= EVIDENCE, F.col("ordinal")))
    found = hits.groupBy("session_id", "rule").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("occurrences"), F.sort_array(F.collect_list("_first")).alias("evidence"))
    return found.withColumn("finding_id", finding_id(F.col("rule"), F.lit("session"), session_key(F.col("session_id"))))


def scorecard(cases: DataFrame, predicted: DataFrame) -> DataFrame:
    """True and false positives, false negatives, precision and recall, by category and in all (null).

    Both sides: ``case_id, category``, a row for each category of a case.
    """
    a = cases.select("case_id", "category").distinct().withColumn("labelled", F.lit(1))
    b = predicted.select("case_id", "category").distinct().withColumn("predicted", F.lit(1))
    both = a.join(b, ["case_id", "category"], "full_outer")
    counts = both.rollup("category").agg(F.count_if(F.col("labelled").isNotNull() & F.col("predicted").isNotNull()).alias("tp"), F.count_if(F.col("labelled").isNull()).alias("fp"), F.count_if(F.col("predicted").isNull()).alias("fn"))
    ratio = lambda x, y: F.when(x + y > 0, F.round(x / (x + y), 6))
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("fn")))
