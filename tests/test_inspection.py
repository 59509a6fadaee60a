"""Events inspected in their rows, in batch and stream, and texts scanned once over runs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig
from textwarden.operators import inspection, payload, scan, spans
from textwarden.operators.scan_store import FindingStore
from textwarden.streaming import jobs

EVENT = "id long, text string, event string, tool_name string, can_rewrite boolean, digest string"
TEXTS = [
    "mail a@x.com and 10.1.2.3", "password = hunter2abc9 for jane@corp.example.com", None, "", "nothing here", "DE89 3704 0044 0532 0130 00 and 4111 1111 1111 1111", "x " * 70_000 + "late@x.com",
    "postgres://u:pw1234secret@db.example.com:5432/x", "a@x.com a@x.com b@y.org",
]


def _events(spark):
    rng = random.Random(2)
    rows = [(i, TEXTS[i % len(TEXTS)], rng.choice(["prompt", "result", "use", "output"]), rng.choice(["Bash", "Read", "mcp__x", "WebFetch", ""]), i % 2 == 0, "d") for i in range(36)]
    return spark.createDataFrame(rows, EVENT)


def _order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_spans_merge_in_the_row_as_over_rows(spark):
    rng = random.Random(4)
    hits = [(k, rng.choice(["EMAIL", "SECRET", "PHONE", "IBAN"]), s := rng.randint(0, 60), s + rng.randint(1, 12), rng.choice([0.5, 0.9]), rng.choice(["a", None])) for k in range(40) for _ in range(rng.randint(0, 9))]
    df = spark.createDataFrame(hits, "k long, entity string, start int, end int, score double, label string").distinct()
    want = spans.merge_spans(spans.dedupe_spans(df, ["k"]), ["k"])
    rows = df.groupBy("k").agg(F.collect_list(F.struct("entity", "start", "end", "score", "label")).alias("hits"))
    assert _order(rows.select("k", F.inline(spans.merge_in_row(F.col("hits")))).collect()) == _order(want.collect())


def test_inspect_equals_scan_and_policy(spark):
    events = _events(spark)
    got = inspection.inspect(events, "text")
    found = got.select("id", F.inline("findings"))
    assert _order(found.collect()) == _order(scan.scan(events, "text", ["id"]).collect())
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 36 and set(events.columns) < set(got.columns)
    for r in rows.values():
        assert sum(r.entities.values()) == len(r.findings)
        assert r.in_bytes == len((r.text or "").encode())
        if not r.findings or r.mode == "observe":
            assert r.action == "allow"
        elif r.mode == "warn" or r.direction == "model_output":
            assert r.action == "report"
        else:
            assert r.action == ("deny" if r.direction in ("prompt", "executable") or not r.can_rewrite else "mask")
    assert inspection.inspect(events.where("false"), "text").count() == 0


def test_stream_gives_the_same_records(spark, tmp_path):
    events = _events(spark)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hits, records = [], []
    jobs.run_once(jobs.stream_scan(stream, "text", ["id"]), "", sink=lambda b, _: hits.extend(b.collect()), checkpoint=str(tmp_path / "c1")).awaitTermination()
    assert _order(hits) == _order(scan.scan(events, "text", ["id"]).collect())
    jobs.run_once(jobs.stream_records(stream, "text"), "", sink=lambda b, _: records.extend(b.collect()), checkpoint=str(tmp_path / "c2")).awaitTermination()
    want = inspection.inspect(events, "text").drop("text")
    assert _order(records) == _order(want.collect())


def test_second_run_scans_only_new_texts(spark, tmp_path, monkeypatch):
    events = _events(spark)
    store = FindingStore(spark, str(tmp_path / "store"))
    read = []
    real = scan.scan
    monkeypatch.setattr(scan, "scan", lambda df, *a: read.append(df.count()) or real(df, *a))
    first = store.scan(events.where("id < 4"), "text", ["id", "digest"])
    assert read == [3] and _order(first.collect()) == _order(real(events.where("id < 4"), "text", ["id", "digest"]).collect())
    whole = store.scan(events, "text", ["id"])
    texts = {t for t in TEXTS if t is not None}
    assert read == [3, len(texts) - 3]
    assert _order(whole.collect()) == _order(real(events, "text", ["id"]).collect())
    store.add(events, "text")
    assert read[-1] == 0 and store.scanned().count() == len(texts)
    # Another configuration has findings of its own.
    other = ScanConfig(entities=("EMAIL",))
    assert store.scanned(other).count() == 0
    store.add(events, "text", other)
    assert read[-1] == len(texts) and {r.entity for r in store.findings(other).collect()} == {"EMAIL"}


def test_findings_of_a_run_that_broke_off_do_not_count(spark, tmp_path, monkeypatch):
    events = _events(spark)
    store = FindingStore(spark, str(tmp_path / "store"))
    store.add(events.where("id = 0"), "text")
    lost = spark.createDataFrame([("x", "EMAIL", 0, 1, 1.0, None, 0, 1)], "digest string, entity string, start int, end int, score double, label string, value_start int, value_end int")
    from textwarden.operators.scan_store import fingerprint

    lost.withColumns({"config": F.lit(fingerprint(None)), "run": F.lit("broken")}).write.mode("append").partitionBy("config", "run").parquet(f"{store.path}/findings")
    assert {r.digest for r in store.findings().collect()} == {r.digest for r in store.scanned().collect()}


def _picky(piece, config):
    if "boom" in piece:
        raise RuntimeError("boom")
    return [("WORD", m.start(), m.end(), 1.0, None) for m in re.finditer("zz", piece)]


def test_a_piece_that_fails_makes_its_text_partial(spark):
    line = "x1 zz " * 20_000 + "\n"
    rows = [(1, "a1 zz"), (2, "boom zz 1"), (3, line + "boom 1\n" + line), (4, None), (1, "a1 zz"), (5, "none 1")]
    df = spark.createDataFrame(rows, "id long, text string")
    found, status = scan.scan_checked(df, "text", ["id"], None, _picky)
    counts = {r.id: r["count"] for r in found.groupBy("id").count().collect()}
    assert set(counts) == {1, 3} and counts[1] == 2 and 0 < counts[3] < 40_000
    assert sorted((r.id, r.partial, r.n_failed > 0) for r in status.collect()) == [(1, False, False), (1, False, False), (2, True, True), (3, True, True), (4, False, False), (5, False, False)]
    with pytest.raises(Exception, match="boom"):
        scan._find(ScanConfig(), _picky)(iter([pa.RecordBatch.from_pydict({"k": ["a"], "at": [0], "t": ["boom"]})])).__next__()


def test_payloads_that_cannot_be_rebuilt_are_withheld(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": 1}'), (2, '{"a": 1, "b": 2}'), (3, "no json"), (4, "no json"), (5, None)], "id int, body string")
    changes = spark.createDataFrame([(1, ["a"], "<X>"), (2, ["#", "a"], "b"), (3, ["a"], "<X>")], "id int, path array<string>, text string")
    got = {r.id: (r.body, r.why) for r in payload.replace_leaves(df, "body", changes, ["id"], "why").collect()}
    assert got[1] == ('{"a":"<X>","b":1}', None) and got[4] == ("no json", None) and got[5] == (None, None)
    assert got[3][0] is None and got[3][1] and got[2] == (None, "two keys become 'b'")
    assert payload.replace_leaves(df, "body", changes, ["id"]).columns == ["id", "body"]
