"""Log sources and streaming jobs over small folders."""

import datetime as dt
import json

from textwarden.sources import logs
from textwarden.streaming import jobs

RECORDS = "session_id string, ts timestamp, action string"


def test_ledger_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 31, 23), "mask"), ("a", dt.datetime(2024, 2, 1), "deny")], RECORDS)
    logs.write_ledger(df, str(tmp_path / "ledger"))
    (tmp_path / "ledger" / "month=2024-01" / "more.json").write_text("not json\n[1]\n")
    assert logs.read_ledger(spark, str(tmp_path / "ledger")).count() == 2
    assert [r.action for r in logs.read_ledger(spark, str(tmp_path / "ledger"), "2024-02-01").collect()] == ["deny"]
    assert [r.month for r in logs.kept_months(logs.read_ledger(spark, str(tmp_path / "ledger")), "2024-03-15").collect()] == ["2024-02"]


def test_transcripts(spark, tmp_path):
    (tmp_path / "p" / "s1" / "subagents").mkdir(parents=True)
    (tmp_path / "p" / "s1.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "p" / "s1" / "subagents" / "x.jsonl").write_text('{"a":3}')
    got = sorted((r.session_id, r.is_subagent, r.line_no, r.raw) for r in logs.read_transcripts(spark, str(tmp_path)).where("raw != ''").collect())
    assert got == [("s1", False, 0, '{"a":1}'), ("s1", False, 1, '{"a":2}'), ("s1", True, 0, '{"a":3}')]


def test_env_files(spark, tmp_path):
    (tmp_path / "a.env").write_text("export A=1 # note\nB=\nC=${A}\n[part]\nD='x\ny'\nwhat is this\n")
    (tmp_path / "b.env").write_bytes(b"\xff\xfe")
    got = sorted((r.name or "", r.state, r.line, r.section) for r in logs.read_env_files(spark, str(tmp_path)).where("kind != 'section'").collect())
    assert got == [("", "unparsed", 0, None), ("", "unparsed", 7, "part"), ("A", "set", 1, None), ("B", "empty", 2, None), ("C", "ref", 3, None), ("D", "set", 5, "part")]


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_stream_scan_and_ledger(spark, tmp_path):
    events = _stream(spark, tmp_path, [(1, "mail a@x.com"), (2, None)], "id int, text string")
    jobs.run_once(jobs.stream_scan(events, "text", ["id"]), "hits").awaitTermination()
    assert [(r.id, r.entity) for r in spark.table("hits").collect()] == [(1, "EMAIL")]
    (tmp_path / "r").mkdir()
    records = _stream(spark, tmp_path / "r", [("s", dt.datetime(2024, 1, 5), "mask"), ("s", dt.datetime(2024, 2, 5), "deny")], RECORDS)
    jobs.stream_ledger(records, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.month for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["2024-01", "2024-02"]


def test_stream_sessions_and_days(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", t, "mask"), ("s", t + dt.timedelta(minutes=10), "deny"), ("s", t + dt.timedelta(days=2), "allow")]
    records = _stream(spark, tmp_path, rows, RECORDS)
    jobs.run_once(jobs.stream_session_summary(records), "closed", checkpoint=str(tmp_path / "c1")).awaitTermination()
    assert [(r.n_records, r.n_masked, r.n_denied) for r in spark.table("closed").collect()] == [(2, 1, 1)]
    jobs.run_once(jobs.stream_daily(records), "daily", checkpoint=str(tmp_path / "c2")).awaitTermination()
    assert [(str(r.day), r.n_events) for r in spark.table("daily").collect()] == [("2024-01-01", 2)]


def test_stream_duplicates(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    rows = [(1, "m", "d", at(0), at(30)), (2, "m", "d", at(10), at(20)), (3, "m", "d", at(40), at(50)), (4, "m", "e", at(11), at(12))]
    requests = _stream(spark, tmp_path, rows, "request_id int, path string, digest string, started timestamp, ended timestamp")
    jobs.run_once(jobs.stream_duplicates(requests), "pairs", checkpoint=str(tmp_path / "c")).awaitTermination()
    assert [(r.first_id, r.request_id) for r in spark.table("pairs").collect()] == [(1, 2)]
    jobs.run_once(jobs.stream_first_requests(requests), "firsts", checkpoint=str(tmp_path / "c2")).awaitTermination()
    assert len({r.digest for r in spark.table("firsts").collect()}) == 2


def test_findings_as_json(spark, tmp_path):
    logs.write_findings(spark.createDataFrame([("r", 2)], "rule string, occurrences int"), str(tmp_path / "f"))
    text = "".join(p.read_text() for p in (tmp_path / "f").glob("part-*"))
    assert json.loads(text) == {"rule": "r", "occurrences": 2}
