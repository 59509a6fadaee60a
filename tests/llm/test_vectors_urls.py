"""Operators over embeddings and pages, and the pipeline."""

import collections
import math
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import components, empty, odd_documents
from textwarden.llm import neighbours, topk, urls

NAN, INF = float("nan"), float("inf")


def vector_table(spark, x, more=()):
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as n_links", "3 as block")


def odd_vectors(dim):
    one = [1.0] * dim
    return [(900, None, 1), (901, [], 1), (902, [None] + one[1:], 1), (903, [NAN] + one[1:], 1), (904, [INF] + one[1:], 1), (905, [0.0] * dim, 1), (None, one, 1), (906, one[:-1], 1), (907, one, None), (907, one, None), (908, one, 2)]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 8)) + 3, rng.normal(size=(150, 8)) - 3, np.repeat(rng.normal(size=(1, 8)), 40, axis=0)]).astype(np.float32)
    df = vector_table(spark, x, odd_vectors(8))
    rows = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 8 and all(v is not None and math.isfinite(v) for v in r.embedding)}
    ints = {i: [math.floor(64 * v) for v in e] for i, e in rows.items()}
    want = []
    for q in ints:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(empty(df)).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 1, 2)")).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] and len(few) == 2


def test_top_k_of_several_lengths_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "CELL_BLOCKS", 2)
    monkeypatch.setattr(topk, "LOT_BLOCKS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4 + i % 3)]) for i in range(90)]
    rows += [(200 + i, [float(v) for v in rng.integers(-(2**40), 2**40, 4) / 64]) for i in range(30)]
    rows += [(300 + i, [float(v) for v in rng.integers(-(2**29), 2**29, 5)]) for i in range(30)]
    rows += [(400, [1e300, 1.0, -1e300, 0.0]), (40, [5.0] * 4), (40, [-5.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = {}
    for i, e in rows:
        best[i] = min(best.get(i, e), e)
    clip = lambda v: max(-(2**63), min(2**63 - 1, v))
    ints = {i: [clip(math.floor(64 * v)) for v in e] for i, e in best.items()}
    want = []
    for q in ints:
        if q % 20 == 0:
            found = sorted((-clip(sum(a * b for a, b in zip(ints[q], ints[c], strict=True))), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(found)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


def test_bounds_never_rule_out_a_result():
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (500, 6))
    pivots = topk.choose_pivots(x[:200].astype(float), 5)
    dist, norms = topk.pivot_distances(x.astype(float), pivots), (x.astype(float) ** 2).sum(axis=1)
    for i in range(0, 500, 50):
        got = topk.best_in_block(x[i].astype(float), norms[i], dist[i], i, -np.inf, 7, np.arange(500), x.astype(float), dist, norms)
        want = sorted((-int(x[i] @ x[j]), j) for j in range(500) if j != i)[:7]
        assert got == [(-s, j) for s, j in want]


@pytest.mark.parametrize("width", [0.0, 3.0])
def test_a_lot_of_queries_is_searched_in_tiles(width):
    """All queries of a lot at once, in a fraction of the time that they take one by one, ties and thresholds included."""
    rng = np.random.default_rng(6)
    x = np.floor(64 * (rng.normal(size=(4096, 64)) + width * np.sign(np.arange(4096) % 7 - 3)[:, None]))
    x[3000:3100] = x[3000]
    ids = rng.permutation(4096) * 10
    dist, norms = topk.pivot_distances(x, topk.choose_pivots(x[:500])), (x**2).sum(axis=1)
    at = np.concatenate([np.arange(0, 4000, 20), [3000, 3050]])
    least = np.where(np.arange(len(at)) % 3 == 0, -np.inf, np.sort(x[at] @ x.T, axis=1)[:, -10])
    began = time.process_time()
    query, row, score = topk.best_of_tiles(x[at], norms[at], dist[at], ids[at], least, 20, ids, x, dist, norms)
    tiled = time.process_time() - began
    got = list(zip(query.tolist(), score.tolist(), row.tolist(), strict=True))
    began = time.process_time()
    want = [(n, s, v) for n, i in enumerate(at) for s, v in topk.best_in_block(x[i], norms[i], dist[i], ids[i], least[n], 20, ids, x, dist, norms)]
    assert got == want and tiled < (time.process_time() - began) / 2
    assert all(len(v) == 0 for v in topk.best_of_tiles(x[:0], norms[:0], dist[:0], ids[:0], least[:0], 20, ids, x, dist, norms))


@pytest.mark.parametrize("most_rows", [4096, 32])
def test_near_duplicate_vectors(spark, monkeypatch, most_rows):
    monkeypatch.setattr(neighbours, "MOST_ROWS", most_rows)
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 64)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(1, 16))
    x = np.concatenate([rng.normal(size=(200, 16)), centre + 0.08 * rng.normal(size=(60, 16)), centre + 0.25 * rng.normal(size=(60, 16)), np.repeat(rng.normal(size=(1, 16)), 30, axis=0) * rng.uniform(0.5, 2, (30, 1))]).astype(np.float32)
    df = vector_table(spark, x, odd_vectors(16))
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    assert len(neighbours.near_duplicates(df).collect()) == df.count()
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and all(v is not None and math.isfinite(v) for v in r.embedding) and any(r.embedding)}
    ids = sorted(rows)
    u = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    near = u @ u.T >= 0.95
    comp = components(len(ids), list(zip(*np.nonzero(np.triu(near, 1)), strict=True)))
    counts = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in ids])
    assert (found <= counts).all() and found.sum() >= 0.98 * counts.sum()
    assert np.mean([got[i].component_id == ids[c] for i, c in zip(ids, comp, strict=True)]) >= 0.98
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 905, 906))
    assert neighbours.near_duplicates(empty(df)).count() == 0


@pytest.mark.parametrize("most_list", [80, 5])
def test_dense_groups_and_lengths(spark, monkeypatch, most_list):
    """Loose groups larger than a list, vectors of another length, and ids with different vectors."""
    monkeypatch.setattr(neighbours, "MOST_LIST", most_list)
    monkeypatch.setattr(neighbours, "MOST_ROWS", 50)
    rng = np.random.default_rng(7)
    loose = np.concatenate([rng.normal(size=(1, 24)) + 0.2 * rng.normal(size=(90, 24)), rng.normal(size=(1, 24)) + 0.05 * rng.normal(size=(30, 24)), rng.normal(size=(60, 24))])
    short = (rng.normal(size=(1, 10)) + 0.1 * rng.normal(size=(12, 10))).astype(np.float32)
    df = vector_table(spark, loose.astype(np.float32), [(500 + i, [float(v) for v in r], 0) for i, r in enumerate(short)] + [(600, [9.0] * 10, 0), (600, [-9.0] * 10, 0)])
    got = {r.vec_id: r for r in neighbours.near_duplicates(df).collect()}
    best = {}
    for r in df.collect():
        best[r.vec_id] = min(best.get(r.vec_id, r.embedding), r.embedding)
    ids = sorted(best)
    same = lambda i, j: len(best[i]) == len(best[j]) and float(np.dot(best[i], best[j]) / np.linalg.norm(best[i]) / np.linalg.norm(best[j])) >= 0.95
    near = np.array([[i != j and same(i, j) for j in ids] for i in ids])
    comp = components(len(ids), list(zip(*np.nonzero(near), strict=True)))
    assert near.sum() > 2000
    assert [got[i].n_links for i in ids] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in ids] == [ids[c] for c in comp]


def test_near_vectors_never_end_below_the_recall(spark, monkeypatch):
    """Rounds go on with larger lists until the recall is reached, and a recall out of reach is an error."""
    for name, value in (("BUCKET_ROWS", 16), ("TABLES", 1), ("NEIGHBOURS", 1), ("LEAST_ROUNDS", 1), ("MOST_ROUNDS", 1)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 16)), rng.normal(size=(1, 16)) + 0.2 * rng.normal(size=(60, 16))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    df = vector_table(spark, x)
    found = sum(r.n_links for r in neighbours.near_duplicates(df).collect())
    assert found >= 0.98 * (near.sum() - len(x))
    monkeypatch.setattr(neighbours, "RECALL", 1.1)
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_duplicates(df)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_of(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules_and_method(spark):
    sites = ["A.Example.COM/en/1", "www.example.com/en/x", "m.www.example.com/en/", "example.com", "x.net/es/1", "x.net/fr/", "net/es/", "notexample.com/en/1", "x.org/es/5?u=://a.com/"]
    rows = [(i, f"https://{s}") for i, s in enumerate(sites)] + [(50, None), (51, "no scheme"), (52, "http://"), (53, "x://a.com?q=/b"), (None, "http://a.com/b")]
    rng = np.random.default_rng(4)
    rows += [(100 + i, f"http://h{i}.net/{rng.choice(['es', 'fr'])}/{i}") for i in range(100)] + [(300 + i, f"https://site{i}.com/page/{i}") for i in range(100)]
    rows += [(0, rows[0][1])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as suffix", "0 as label")
    got = urls.judge(df).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        host, path, rule, verdict = rule_of(text[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    numbers, words = (lambda i: f"p/{i * 7919}{i * 104729}"), (lambda i: "p/" + "".join(rng.choice(list("abcdefgh"), 9)))
    shown = [(i, f"http://s{i}.{['bad', 'good', 'other'][i % 3]}.example/{numbers(i) if i % 3 == 0 or i % 6 == 2 else words(i)}") for i in range(900)]
    rules = (("block", "bad.example", "/"), ("allow", "good.example", "/"))
    learnt = urls.judge(spark.createDataFrame(shown, "page_id long, url string"), rules).where("rule is null").collect()
    assert len(learnt) == 300 and np.mean([r.verdict == ("block" if r.page_id % 6 == 2 else "allow") for r in learnt]) > 0.9
    assert urls.judge(empty(df)).count() == 0
    assert {r.verdict for r in urls.judge(df.where("page_id = 51")).collect()} == {"allow"}


def test_suffix_share_never_holds_the_own_label(spark):
    """Brute force: of a labelled URL the other folds count, of others all folds."""
    rng = np.random.default_rng(9)
    rows = [(i, f"http://h{i}.{rng.choice(['net', 'org'])}/{rng.choice(['es', 'fr', f'own{i}'])}/{i}") for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("block", "net", "/es/"), ("allow", "net", "/"), ("allow", "org", "/es/"), ("block", "org", "/o"))
    described = urls.described_urls(df, rules).selectExpr("*", f"pmod(xxhash64(url), {urls.FOLDS}) as nth")
    got = urls.with_suffix_share(described, 0.3).collect()
    assert len(got) == len(rows)
    for r in got:
        others = [o.blocked for o in got if o.suffix == r.suffix and o.blocked is not None and (r.blocked is None or o.nth != r.nth)]
        assert r.suffix_share == pytest.approx((sum(others) + urls.SMOOTHING * 0.3) / (len(others) + urls.SMOOTHING))
    alone = [r.suffix_share for r in got if r.blocked is not None and "own" in r.suffix]
    assert alone and set(alone) == {0.3}


def test_trees_judge_held_out_urls(spark):
    rng = np.random.default_rng(11)
    rows = [(i, f"http://s{i}.{'bad' if i % 3 == 0 else 'good'}.example/p/" + (f"{i * 7919}{i * 104729}" if i % 3 == 0 else "".join(rng.choice(list("abcdefgh"), 9)))) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    assert urls.held_out_accuracy(df, (("block", "bad.example", "/"), ("allow", "good.example", "/"))) > 0.95
    assert urls.held_out_accuracy(empty(df)) is None


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        if name in ("quality", "personal_data"):
            assert kept.count() == before
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert ids and not ids & {2, 3, 9, 10}
    fill, texts = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        fill[r.bin_id] += r.n_words
        texts[r.bin_id].append(r.cluster)
    assert max(fill.values()) <= 2048 and all(len(t) == len(set(t)) for t in texts.values())


@pytest.mark.parametrize(("most_audited", "probes"), [(40, 30), (4096, 0)])
def test_rare_links_are_audited(spark, monkeypatch, most_audited, probes):
    """No ball of the first sample has a link: more are drawn, or points planted, and the recall is measured."""
    monkeypatch.setattr(neighbours, "AUDITED", 10)
    monkeypatch.setattr(neighbours, "MOST_AUDITED", most_audited)
    monkeypatch.setattr(neighbours, "PROBES", 30)
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24))
    x[899] = x[17] + 0.05 * rng.normal(size=24)
    x[898] = x[500] + 0.25 * rng.normal(size=24)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df, report).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [got[i][0] for i in range(900)] == (near.sum(axis=1) - 1).tolist() and set(got) == set(range(900))
    assert got[899] == (1, 17)
    assert report[24]["recall"] >= 0.9 and report[24]["probes"] == probes and report[24]["true_pairs"] >= 1


def test_blocks_of_vectors_are_compared_in_bounded_memory():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_000, 17))
    x[:, :-1] /= np.linalg.norm(x[:, :-1], axis=1)[:, None]
    x[:, -1] = 0
    rows = pa.table({"id": pa.array(np.arange(len(x))), "vector": pa.array([r.tobytes() for r in x], pa.binary())})
    limit = -math.acos(0.6)

    class Sent:
        value = (np.arange(4096), x[:4096])

    tracemalloc.start()
    audit = pa.Table.from_batches(neighbours._true_links(Sent, limit)(rows.combine_chunks().to_batches()))
    lists = neighbours._start(rows.slice(0, 4096))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    near = x[:4096, :-1] @ x[:, :-1].T
    np.fill_diagonal(near[:, :4096], -9)
    got = sorted(zip(audit.column("id").to_pylist(), audit.column("other").to_pylist(), strict=True))
    assert got == [(a, b) for a, b in np.argwhere(near >= 0.6).tolist()] and got
    for i in range(0, 4096, 500):
        assert set(np.frombuffer(lists.column("others")[i].as_py(), np.int64).tolist()) == set(np.argsort(-near[i, :4096])[: neighbours.NEIGHBOURS].tolist())
