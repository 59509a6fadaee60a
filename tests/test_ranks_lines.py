"""Exact ranks with one key that holds everything, and line numbers of files read in splits."""

import math
import os
import random

from pyspark.sql import functions as F

from textwarden.operators import ranks, records
from textwarden.sources import logs


def test_ranks_of_large_and_small_keys_are_the_sorted_ones(spark):
    rng = random.Random(3)
    draw = [lambda: rng.random(), lambda: float(rng.randint(0, 3)), lambda: rng.choice([0.0, 5e-324, 1e-300, 1e300, 1.7e308]), lambda: rng.lognormvariate(0, 9)]
    rows = [(k, draw[i]()) for i, k in enumerate(["a", "b", "c", None]) for _ in range(900)] + [("d", 1.5), ("e", 2.0), ("e", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit("clash"))
    n = F.col("n")
    asked = {"low": F.lit(0), "mid": F.floor(n / 2), "high": n - 1, "beyond": n}
    for most in (10**6, 100, 0):
        got = {r.k: (r.n, r.low, r.mid, r.high, r.beyond) for r in ranks.values_at(df, ["k"], "v", asked, most).collect()}
        for key in ("a", "b", "c", None, "d", "e"):
            v = sorted(x for k, x in rows if k == key)
            assert got[key] == (len(v), v[0], v[len(v) // 2], v[-1], None)
    assert ranks.values_at(df.where("false"), ["k"], "v", asked, 0).count() == 0


def test_latency_stats_by_histograms(spark):
    rng = random.Random(5)
    v = [rng.expovariate(0.01) for _ in range(501)]
    df = spark.createDataFrame([("s", x) for x in v] + [("s", None), ("s", math.nan), ("s", -1.0), ("s", math.inf)], "s string, latency_ms double")
    for most in (0, 10**6):
        row = records.latency_stats(df, ["s"], most_sorted=most).first()
        assert (row.n, row.median, row.p95) == (501, sorted(v)[250], sorted(v)[475])


def test_lines_of_files_in_many_splits(spark, tmp_path):
    rng = random.Random(1)
    (tmp_path / "p" / "s1" / "subagents").mkdir(parents=True)
    want = []
    for name, session, sub in (("p/s1.jsonl", "s1", False), ("p/s1/subagents/x.jsonl", "s1", True), ("p/empty.jsonl", "empty", False), ("p/s2.jsonl", "s2", False)):
        lines = ["".join(rng.choices("ab é\r{}", k=rng.choice([0, 3, 40, 900]))) for _ in range(0 if session == "empty" else 300)]
        (tmp_path / name).write_text("\n".join(lines), newline="\n")
        want += [(session, sub, i, line) for i, line in enumerate(lines)]
    for size in ("1024", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = logs.read_transcripts(spark, str(tmp_path))
            assert size != "1024" or rows.rdd.getNumPartitions() >= 1
            got = sorted((r.session_id, r.is_subagent, r.line_no, r.raw) for r in rows.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        # A file's last line, if empty, is none.
        assert got == sorted(w for w in want if w[3] != "" or (w[0], w[1], w[2] + 1) in {x[:3] for x in want})


def test_files_changed_before_a_date_are_not_opened(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name, at in (("old", 1_600_000_000), ("new", 1_700_000_000)):
        (tmp_path / "p" / f"{name}.jsonl").write_text("{}\n")
        os.utime(tmp_path / "p" / f"{name}.jsonl", (at, at))
    assert {r.session_id for r in logs.read_transcripts(spark, str(tmp_path), "2023-01-01").collect()} == {"new"}
