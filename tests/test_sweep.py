"""The sweep over ranges against all pairs, at block borders, with nulls, repeats and one key that holds everything."""

import random

import pytest

from textwarden.operators import policy, spans, sweep


def _tables(spark, seed, n, most):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    items = [(i, key(), rng.choice(["X", "Y", None]), rng.randint(0, most)) for i in range(n)]
    items += items[:5]
    runs = [(key(), rng.choice(["X", "Y"]), f := rng.randint(0, most), rng.choice([None, f, f + rng.randint(0, most // 8)])) for _ in range(n)]
    issued = spark.createDataFrame(runs, "session_id string, entity string, first long, last long")
    return items, runs, spark.createDataFrame(items, "id long, session_id string, entity string, number long"), issued


@pytest.mark.parametrize(("seed", "most", "block"), [(1, 40, 1 << 14), (2, 200, 7), (3, 1000, 64)])
def test_same_as_all_pairs(spark, monkeypatch, seed, most, block):
    monkeypatch.setattr(sweep, "BLOCK", block)
    items, runs, written, issued = _tables(spark, seed, 120, most)
    holds = lambda s, e, a, z: any(s is not None and e is not None and (s, e) == r[:2] and r[3] is not None and r[2] <= a and z <= r[3] for r in runs)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(policy.write_back_check(written, issued).collect()) == order(i for i in items if holds(i[1], i[2], i[3], i[3]))
    new = written.selectExpr("session_id", "entity", "number as first", "number + 3 as last")
    want = order((s, e, a, a + 3) for _, s, e, a in items if not holds(s, e, a, a + 3))
    assert order(policy.issue_new_runs(new, issued).collect()) == want
    numbers = written.selectExpr("id", "session_id as k", "number as n_start", "number + 2 as n_end")
    found = issued.selectExpr("session_id as k", "first as start", "last as end")
    clear = [i for i in items if not any(r[0] == i[1] and r[3] is not None and r[2] < i[3] + 2 and i[3] < r[3] for r in runs)]
    assert order(r[:2] for r in sweep.touching_none(numbers, found, ["k"], "n_start", "n_end", "start", "end").collect()) == order(i[:2] for i in clear)


def test_empty_sides_and_clashing_names(spark):
    _, _, written, issued = _tables(spark, 4, 20, 30)
    assert policy.write_back_check(written.where("false"), issued).count() == 0
    assert policy.write_back_check(written, issued.where("false")).count() == 0
    named = written.selectExpr("*", "1 as _last", "2 as _block")
    assert policy.write_back_check(named, issued).columns == named.columns


def test_one_session_of_very_many_runs(spark):
    n = 300_000
    issued = spark.range(n).selectExpr("'s' as session_id", "'X' as entity", "id * 3 as first", "id * 3 + 1 as last")
    written = spark.range(n).selectExpr("id", "'s' as session_id", "'X' as entity", "id * 3 + id % 3 as number")
    assert policy.write_back_check(written, issued).count() == n - n // 3
    assert spans.outside(written.selectExpr("session_id as k", "number as start", "number as end"), issued.selectExpr("session_id as k", "first as start", "last as end"), ["k"]).count() == n // 3
