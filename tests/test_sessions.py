"""Sessions in state: the stream against the batch functions and sequential versions, over shuffled micro-batches, restarts and late rows."""

import datetime as dt
import random

import pytest

from textwarden.operators import policy, records
from textwarden.streaming import jobs, sessions

T0 = dt.datetime(2024, 1, 1)
EVENTS = "session_id string, ts timestamp, seq long, kind string, done string, entities map<string,int>"
RUNS = "session_id string, ts timestamp, seq long, kind string, entity string, first long, last long"
FAR = T0 + dt.timedelta(days=9)


def _events(seed, n=150):
    rng = random.Random(seed)
    rows, at = [], {s: 0 for s in "abc"}
    for seq in range(n):
        s = rng.choice("aaabc")
        at[s] += rng.choice([0, 1, 5, 20, 31, 40])
        kind = rng.choice(["record"] * 6 + ["turn_end"] * 3 + ["session_end", None])
        rows.append((s, T0 + dt.timedelta(minutes=at[s]), seq, kind, rng.choice(["masked", "blocked", None]), rng.choice([None, {}, {"EMAIL": 1}, {"EMAIL": 2, "PHONE": rng.randint(1, 3)}])))
    return rows


def _summaries(rows, idle=30):
    """One session after the other, event by event."""
    out = []
    for s in {r[0] for r in rows}:
        life = None
        for _, ts, _, kind, done, entities in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if life and ts > life["last"] + dt.timedelta(minutes=idle):
                out += _say(s, life, life["last"] + dt.timedelta(minutes=idle), "idle")
                life = None
            if kind == "session_end":
                life = None
                continue
            life = life or {"n": 0, "shown": 0, "totals": {}}
            life["last"] = ts
            if kind == "turn_end":
                out += _say(s, life, ts, "turn")
                continue
            life["n"] += 1
            for e, n in (entities or {}).items():
                life["totals"][done, e] = life["totals"].get((done, e), 0) + n
        if life:
            out += _say(s, life, life["last"] + dt.timedelta(minutes=idle), "idle")
    return sorted(out, key=repr)


def _say(s, life, at, reason):
    if life["n"] <= life["shown"]:
        return []
    new, life["shown"] = life["n"] - life["shown"], life["n"]
    return [(s, at, reason, life["n"], new, sorted(((d, e, n) for (d, e), n in life["totals"].items()), key=repr))]


def _plain(rows):
    return sorted(((r.session_id, r.at, r.reason, r.n_records, r.n_new, sorted(map(tuple, r.totals), key=repr)) for r in rows), key=repr)


def _files(spark, tmp_path, rows, schema, parts):
    """The rows in files of their own, read one a micro-batch, in the order written."""
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _dealt(rows, n, seed):
    """Micro-batches whose rows come in any order, never later than an hour behind."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: rows[k][1] + dt.timedelta(minutes=rng.randint(0, 25)))
    size = -(-len(rows) // n)
    parts = [order[i : i + size] for i in range(0, len(rows), size)]
    for p in parts:
        rng.shuffle(p)
    return parts


@pytest.fixture
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sessions.use_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_summaries(spark, seed):
    rows = _events(seed)
    got = records.session_summaries(spark.createDataFrame(rows + rows[:9] + [(None, T0, 1, None, None, None), ("a", None, 1, None, None, None)], EVENTS))
    assert _plain(got.collect()) == _summaries(rows)
    assert records.session_summaries(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_summaries_of_shuffled_batches_and_a_restart(stateful, tmp_path):
    rows = _events(3)
    # A last event far ahead moves the watermark past all others.
    closing = [("z", FAR, 999, "record", "masked", None)]
    stream = _files(stateful, tmp_path, rows + closing, EVENTS, [*_dealt(rows, 4, 3), [len(rows)]])
    checkpoint = str(tmp_path / "c")
    got = []
    sink = lambda batch, _: got.extend(batch.collect())
    jobs.run_once(sessions.stream_summaries(stream), "", sink=sink, checkpoint=checkpoint).awaitTermination()
    assert _plain(got) == _summaries(rows)
    # Later files go on from the state; a row older than the watermark is late and left out.
    more = [("a", FAR + dt.timedelta(hours=2), 1000, "record", "masked", {"EMAIL": 5}), ("a", FAR + dt.timedelta(hours=2, minutes=1), 1001, "turn_end", None, None), ("a", T0, 1002, "record", "masked", {"EMAIL": 9}), ("y", FAR + dt.timedelta(days=1), 1003, "record", None, None)]
    stateful.createDataFrame(more, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got.clear()
    jobs.run_once(sessions.stream_summaries(stream), "", sink=sink, checkpoint=checkpoint).awaitTermination()
    assert [r for r in _plain(got) if r[0] == "a"] == [("a", more[1][1], "turn", 1, 1, [("masked", "EMAIL", 5)])]
    assert [r[2:4] for r in _plain(got) if r[0] == "z"] == [("idle", 1)]


def _run_events(seed, n=160):
    rng = random.Random(seed)
    rows, at = [], {s: 0 for s in "ab"}
    for seq in range(n):
        s = rng.choice("aaab")
        at[s] += rng.choice([0, 1, 3])
        kind = rng.choice(["issue"] * 4 + ["write"] * 8 + (["session_end"] if seq % 50 == 0 else []))
        first = rng.randint(0, 3000)
        last = first + rng.choice([0, 2, 40, 1500]) if kind == "issue" else None
        if kind == "issue" and s == "b" and seq > n // 2 and rng.random() < 0.3:
            first, last = rng.choice([(None, 5), (9, 3)])
        rows.append((s, T0 + dt.timedelta(minutes=at[s]), seq, kind, rng.choice(["EMAIL", "EMAIL", "PHONE", None] if kind == "write" else ["EMAIL", "PHONE"]), first, last))
    return rows


def _verdicts(rows):
    out = []
    for s in {r[0] for r in rows}:
        runs, damaged = [], False
        for _, ts, seq, kind, entity, first, last in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if kind == "session_end":
                runs, damaged = [], False
            elif kind == "issue":
                damaged |= first is None or last is None or first > last
                runs += [(entity, first, last)] if first is not None and last is not None else []
            else:
                held = any(e == entity and a <= first <= b for e, a, b in runs)
                out.append((s, seq, ts, entity, first, "unchecked" if damaged else "refused" if held else "free"))
    return sorted(out, key=repr)


def test_refusals_in_batch_and_stream(stateful, tmp_path):
    rows = _run_events(5)
    want = _verdicts(rows)
    assert {w[-1] for w in want} == {"unchecked", "refused", "free"}
    assert sorted(map(tuple, policy.refusals(stateful.createDataFrame(rows, RUNS)).collect()), key=repr) == want
    stream = _files(stateful, tmp_path, [*rows, ("z", FAR, 999, "issue", "EMAIL", 1, 1)], RUNS, [*_dealt(rows, 3, 5), [len(rows)]])
    got = []
    jobs.run_once(sessions.stream_refusals(stream), "", sink=lambda b, _: got.extend(b.collect()), checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, got), key=repr) == want


def test_different_events_of_one_number_all_count(stateful, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", at(0), 7, "issue", "EMAIL", low, low + 4) for low in (10, 20, 30)]
    rows += [("a", at(0), 7, "issue", entity, 1, 1) for entity in ("PHONE", "SSN")]
    rows += [("a", at(1), 8 + i, "write", e, n, None) for i, (e, n) in enumerate([("EMAIL", 12), ("EMAIL", 22), ("EMAIL", 32), ("EMAIL", 1), ("PHONE", 1), ("SSN", 1)])]
    # A run that can't be read, beside one that can, and a write beside an issue.
    rows += [("b", at(0), 1, "issue", "EMAIL", 5, 5), ("b", at(0), 1, "issue", None, None, 5), ("b", at(1), 2, "write", "EMAIL", 5, None), ("c", at(0), 1, "write", "EMAIL", 5, None), ("c", at(0), 1, "issue", "EMAIL", 5, 5)]
    rows += rows[:2]
    want = sorted([("a", 8 + i, at(1), e, n, v) for i, (e, n, v) in enumerate([("EMAIL", 12, "refused"), ("EMAIL", 22, "refused"), ("EMAIL", 32, "refused"), ("EMAIL", 1, "free"), ("PHONE", 1, "refused"), ("SSN", 1, "refused")])] + [("b", 2, at(1), "EMAIL", 5, "unchecked"), ("c", 1, at(0), "EMAIL", 5, "refused")], key=repr)
    assert sorted(map(tuple, policy.refusals(stateful.createDataFrame(rows, RUNS)).collect()), key=repr) == want
    n = len(rows)
    stream = _files(stateful, tmp_path, [*rows, ("z", FAR, 999, "issue", "EMAIL", 1, 1)], RUNS, [range(0, n, 2), range(1, n, 2), [n]])
    got = []
    jobs.run_once(sessions.stream_refusals(stream), "", sink=lambda b, _: got.extend(b.collect()), checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, got), key=repr) == want


def test_runs_are_merged():
    rng = random.Random(8)
    borders, numbers = [], set()
    for _ in range(200):
        low = rng.randint(0, 400)
        high = low + rng.randint(0, 6)
        borders = sessions.merge_run(borders, low, high)
        numbers |= set(range(low, high + 1))
        held = [n for a, b in zip(borders[::2], borders[1::2], strict=True) for n in range(a, b + 1)]
        assert held == sorted(numbers)
        assert all(a > b + 1 for b, a in zip(borders[1::2], borders[2::2], strict=False))
