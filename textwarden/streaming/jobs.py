"""The batch operators over streams of events and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textwarden.functions.detectors import ScanConfig
from textwarden.operators.inspection import hits_in_row, inspect
from textwarden.operators.records import session_key
from textwarden.operators.spans import merge_in_row

LATE = "1 hour"


def stream_scan(events: DataFrame, text: str, keys: list[str], config: ScanConfig | None = None) -> DataFrame:
    """``keys, entity, start, end, score, label, value_start, value_end``: the resolved findings of each event, without state or shuffle."""
    hits = events.select(*keys, hits_in_row(F.col(text), config).alias("_hits"))
    return hits.where(F.size("_hits") > 0).select(*keys, F.inline(merge_in_row(F.col("_hits"))))


def stream_records(events: DataFrame, text: str, tools: DataFrame | None = None, modes: dict[str, str] | None = None, config: ScanConfig | None = None) -> DataFrame:
    """A record for each event: what was found in it and what is done with it; see ``inspection.inspect``."""
    return inspect(events, text, tools, modes, config).drop(text)


def stream_ledger(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Records into the folders of their months; a batch that is run again replaces what it wrote."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_session_summary(records: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Closed sessions: records and actions between gaps."""
    closed = records.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return closed.agg(F.count("*").alias("n_records"), F.count_if(F.col("action") == "mask").alias("n_masked"), F.count_if(F.col("action") == "deny").alias("n_denied")).select(session_key(F.col("session_id")).alias("session_key"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_records", "n_masked", "n_denied")


def stream_daily(records: DataFrame, late: str = LATE) -> DataFrame:
    """Records by day."""
    by_day = records.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return by_day.agg(F.count("*").alias("n_events")).select(F.to_date("w.start").alias("day"), "n_events")


def stream_first_requests(requests: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Requests without those that repeat one (same path and digest) begun shortly before."""
    return requests.withWatermark("started", within).dropDuplicatesWithinWatermark(["path", "digest"])


def stream_duplicates(requests: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Pairs of equal requests of which the later began while the earlier was unanswered: an interval join on the digest."""
    a = requests.withWatermark("started", within).select(F.col("request_id").alias("first_id"), "path", "digest", F.col("started").alias("first_started"), F.col("ended").alias("first_ended"))
    b = requests.withWatermark("started", within).select("request_id", F.col("path").alias("_path"), F.col("digest").alias("_digest"), "started")
    during = (F.col("started") >= F.col("first_started")) & (F.col("started") <= F.col("first_started") + F.expr(f"interval {within}")) & (F.col("started") < F.col("first_ended"))
    return a.join(b, (F.col("path") == F.col("_path")) & (F.col("digest") == F.col("_digest")) & (F.col("first_id") < F.col("request_id")) & during).drop("_path", "_digest")


def run_once(df: DataFrame, name: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Work through what there is and stop, into a memory table or a sink of batches."""
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.foreachBatch(sink) if sink else writer.format("memory").queryName(name)).start()
