"""Operators on tool events."""

from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig
from textwarden.operators import events


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_targets_and_filters(spark):
    df = spark.createDataFrame([(1, '{"file_path":"","url":"http://x"}'), (2, '{"path":"/a"}'), (3, "{}")], "i int, t string")
    assert rows(df.select("i", events.target_of(F.col("t")).alias("x")), "i", "x") == [(1, "http://x"), (2, "/a"), (3, None)]
    leaves = spark.createDataFrame([(["a", "data"], "AA", "base64"), (["a", "data"], "AA", None), (["signature"], "s", "thinking")], "path array<string>, text string, sibling_type string")
    assert rows(events.opaque(leaves), "sibling_type") == [(None,)]
    e = spark.createDataFrame([("inbound", "WebFetch", "warn", True), ("inbound", "Read", "warn", True), ("inbound", "mcp__a", "observe", True)], "direction string, tool_name string, mode string, can_rewrite boolean")
    assert rows(events.shrinkable(e), "tool_name") == [("WebFetch",)]


def test_a_key_gives_context(spark):
    leaves = spark.createDataFrame([(1, "password", "hunter2abc"), (2, "note", "hunter2abc"), (3, None, "a@x.com"), (4, "mail", "a@x.com")], "id int, name string, text string")
    found = events.scan_with_keys(leaves, ["id"])
    assert rows(found, "id", "entity", "start", "end") == [(1, "SECRET", 0, 10), (3, "EMAIL", 0, 7), (4, "EMAIL", 0, 7)]


def test_sizes_and_totals(spark):
    df = spark.createDataFrame([(1, '[{"type":"text","text":"hé"},{"type":"image"}]'), (2, '"abc"'), (3, None)], "i int, c string")
    assert rows(df.select("i", events.tool_result_size(F.col("c")).alias("n")), "i", "n") == [(1, 3), (2, 3), (3, None)]
    text = "<system-reminder>Called the Read tool: x</system-reminder> <system-reminder>other</system-reminder>"
    assert rows(events.at_file_totals(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]), "n_files", "bytes") == [(1, 23)]


def test_model_output_and_env(spark):
    turns = spark.createDataFrame([("s", 1, "mail a@x.com and b@x.com"), ("s", 2, "x" * 50 + " c@x.com")], "session_id string, turn int, text string")
    assert rows(events.model_output_counts(turns, ScanConfig(entities=("EMAIL",)), most=40), "entity", "n", "truncated") == [("EMAIL", 2, False)]
    entries = spark.createDataFrame([("p", 1, "DB_PASSWORD", "hunter2abc"), ("p", 2, "A", "${B}"), ("p", 3, "C", None)], "path string, line int, name string, value string")
    assert rows(events.env_state(entries), "line", "state", "entities") == [(1, "set", ["SECRET"]), (2, "ref", []), (3, "empty", [])]
