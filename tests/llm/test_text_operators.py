"""Operators over documents against brute-force versions, with every odd case."""

import collections
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.data import components, empty, odd_documents
from textwarden.llm import mixing, ngram_join, packing, paragraphs, pii, quality, repeats
from textwarden.llm import components as component_module
from textwarden.llm.components import connected_components
from textwarden.llm.scratch import Scratch
from textwarden.llm.wordhash import ngram_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_ngram_sets_tell_the_same_sets_apart():
    import pyarrow as pa

    texts = ["a b c d e", "A  b\tC d\ne", "a b", "", None, "é 😀 x y z", "a b c d e a b c d e"]
    got = [frozenset(s.tolist()) for s in ngram_sets(pa.array(texts), 4)]
    want = [shingles(t, 4) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j]) and len(got[i]) == len(want[i])


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text, n) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    # Rows of one id are one node.
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None and sets[i]:
            ids[r.doc_id].append(i)
    links += [(x, y) for same in ids.values() for x, y in zip(same, same[1:], strict=False)]
    comp = components(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[comp[i]] = min(least.get(comp[i], r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, len(sets[i]), least.get(comp[i]) if sets[i] else r.doc_id) for i, r in enumerate(rows)), key=repr)
    got = sorted((tuple(r)[:3] for r in ngram_join.ngram_components(docs, n, percent).collect()), key=repr)
    assert got == want
    assert ngram_join.ngram_components(empty(docs), n, percent).count() == 0


def test_ngram_join_of_a_large_group_in_parts(spark, monkeypatch):
    from textwarden.llm import verify

    monkeypatch.setattr(verify, "PART_TEXTS", 5)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 4)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(30):
        w = list(words)
        w[(i * 7) % 200] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("part_texts", [1000, 3])
def test_ngram_join_links_through_rows_without_id(spark, monkeypatch, part_texts):
    from textwarden.llm import verify

    monkeypatch.setattr(verify, "PART_TEXTS", part_texts)
    words = [f"v{i}" for i in range(100)]
    cut = lambda i: " ".join(words[5 * i :] + [f"n{k}" for k in range(5 * i)])
    rows = [(7, cut(0)), (None, cut(1)), (None, cut(2)), (3, cut(3)), (None, "a b c d e f"), (None, "a b c d e f"), (9, "x y z")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 3), (0, 3), (3, 3), (7, 3), (9, 9)]


def test_verified_parts_lose_no_link(spark, monkeypatch):
    from textwarden.llm import verify

    monkeypatch.setattr(verify, "PART_TEXTS", 4)
    monkeypatch.setattr(verify, "PIVOTS", 1)
    rng = np.random.default_rng(1)
    texts = []
    for group in range(8):
        words = [f"g{group}w{i}" for i in range(60)]
        for i in range(int(rng.integers(1, 9))):
            w = list(words)
            w[(7 * i) % 60] = f"x{i}"
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = list(ngram_sets(__import__("pyarrow").array(texts), 5))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    candidates = spark.createDataFrame([(0, i, verify.fingerprint(s), len(s)) for i, s in enumerate(sets)], "block long, key long, print long, weight int")
    found = verify.verified_components(candidates, spark.createDataFrame(rows, "key long, text string"), 5, 80, Scratch(spark, "test"))
    want = components(len(sets), links)
    assert {r.node: r.component for r in found.collect()} == {i: c for i, c in enumerate(want) if want.count(c) > 1}


def test_without_near_copies(spark):
    kept = ngram_join.without_near_copies(odd_documents(spark))
    got = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert got[1] == 1 and got[2] == got[3] == got[10] == 0 and got[8] == 1 and got[9] == 0 and got[5] == got[6] == 1
    assert kept.columns == odd_documents(spark).columns
    # Different texts of one id are not copies; near copies without an id are.
    words = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (1, " ".join(f"u{i}" for i in range(100))), (None, " ".join(words[:-1])), (None, "one other text"), (None, "one other text"), (None, "one Other text")]
    left = ngram_join.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in left) == sorted([(0, 14), (1, len(rows[0][1])), (1, len(rows[1][1]))])


def windows(texts, size):
    count = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        out.append(covered)
    return out


@pytest.mark.parametrize("most_runs", [2000, 1])
def test_repeats(spark, monkeypatch, most_runs):
    monkeypatch.setattr(repeats, "MOST_RUNS", most_runs)
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(1500))
    docs = odd_documents(spark).select("doc_id", "text")
    more = [(100, "x" + base[:450] + "y"), (101, "z" + base[30:440] + "é" * 300), (102, base[:399]), (103, "ab" * 300 + "q" + "ab" * 250), (104, "a" * 5000), (105, "é" * 450), (106, base[100:900])]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    want = []
    for r, t, c in zip(rows, texts, windows(texts, 400), strict=True):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        want.append((r.doc_id, len(t), sum(c), sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1])), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in repeats.without_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert repeats.without_repeats(empty(docs)).count() == 0


def test_hot_anchors_do_not_depend_on_the_order_of_rows():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 460, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, 150 + 5 * i, dtype=np.uint8)) + passage + bytes(rng.integers(97, 123, 90, dtype=np.uint8)) for i in range(20)]
    texts += [bytes(rng.integers(97, 123, 700, dtype=np.uint8)) for _ in range(5)]
    n = len(texts)
    table = pa.table({"gram": pa.array([5] * n), "run": pa.array(range(n)), "copies": pa.array([1] * n, pa.int32()), "doc_id": pa.array(range(n)), "row_key": pa.array(range(n)), "start": pa.array([10 * i for i in range(n)], pa.int32()), "windows": pa.array([len(t) - 399 for t in texts], pa.int32()), "text": pa.array(texts, pa.binary())})
    halves = [table.take(pa.array(range(0, n, 2))), table.take(pa.array(range(1, n, 2)))]
    shuffled = lambda t, seed: t.take(pa.array(np.random.default_rng(seed).permutation(t.num_rows)))
    prints = pa.concat_tables([repeats._blob_prints(4)((pa.scalar(blob),), shuffled(half, blob)) for blob, half in enumerate(halves)])
    found = pa.concat_tables([repeats._repeated_prints(shuffled(prints.filter(pa.array([b == bucket for b in prints.column("bucket").to_pylist()])), bucket)) for bucket in range(4)])
    want = {(i, 10 * i + at) for i, c in enumerate(windows(texts, 400)) for at in range(len(c)) if c[at]}
    for seed in range(3):
        got = []
        for blob, half in enumerate(halves):
            mine = found.filter(pa.array([b == blob for b in found.column("blob").to_pylist()]))
            got += [tuple(r.values()) for r in repeats._blob_spans(shuffled(half, seed), shuffled(mine, seed)).to_pylist()]
        assert want and {(i, at) for i, _, a, b in got for at in range(a, b)} == want


def test_maximal_repeats_have_all_occurrences():
    texts = [b"--" + b"abcdefgh" + b"!!", b"?" + b"abcdefgh" + b"##", b"+" + b"abcdef" + b"%%"]
    got = {(n, tuple(sorted(o))) for n, o in repeats.maximal_repeats(texts, 4)}
    assert got == {(8, ((0, 2), (1, 1))), (6, ((0, 2), (1, 1), (2, 1)))}


def test_mixing(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * size[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        assert (r.taken > 0) == (r.first_slot is not None) and r.first_slot == min(r.slots, default=None)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (repr(r.doc_id), repr(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(empty(docs)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies and max(copies[r.doc_id] for r in rows if r.doc_id not in (None, 3)) <= 2


def test_schedule_is_even(spark):
    """Every stretch of the mix holds each source in about its share."""
    sources = spark.createDataFrame([(1, 0, 500, 1, 500), (2, 500, 300, 1, 300), (3, 800, 224, 1, 224)], "source_no int, first_slot long, n_slots long, block_words long, line_words long")
    slots = mixing.schedule(sources, 10).orderBy("slot").collect()
    assert [sum(s.source_no == k for s in slots) for k in (1, 2, 3)] == [500, 300, 224]
    for at in range(0, 1024, 128):
        assert abs(sum(s.source_no == 1 for s in slots[at : at + 128]) - 62.5) < 8
    for k in (1, 2, 3):
        assert [s.rank for s in slots if s.source_no == k] == list(range(sum(s.source_no == k for s in slots)))


def naive_best_fit(pieces, capacity, per_source):
    pieces = pieces.sort_values(["n_words", "order", "start_word"], ascending=[False, True, True], kind="stable")
    bins, out = [], []
    for r in pieces.itertuples():
        best = None
        for i, (left, clusters, sources) in enumerate(bins):
            if left >= r.n_words and r.cluster not in clusters and sources[r.source] < per_source and (best is None or left < bins[best][0]):
                best = i
        if best is None:
            bins.append([capacity, set(), collections.Counter()])
            best = len(bins) - 1
        bins[best][0] -= r.n_words
        bins[best][1].add(r.cluster)
        bins[best][2][r.source] += 1
        out.append(best)
    return out


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    for _ in range(10):
        n = 200
        pieces = pd.DataFrame({"order": rng.permutation(n), "doc_id": np.arange(n), "start_word": 0, "n_words": rng.integers(1, 51, n), "source": rng.choice(["a", "b", None], n, p=[0.6, 0.3, 0.1]), "cluster": rng.choice(["x", "y"] + [str(i) for i in range(80)], n)})
        assert packing.pack_shard(pieces, 50, 3).bin_id.tolist() == naive_best_fit(pieces, 50, 3)


def test_packing(spark):
    docs = odd_documents(spark)
    rows = packing.pack(docs, capacity=100, shard_words=5000).collect()
    whole = collections.Counter((r.doc_id, r.text.rstrip()) for r in docs.collect() if WORD.search(r.text or ""))
    joined = collections.defaultdict(list)
    for r in rows:
        assert len(WORD.findall(r.text)) == r.n_words
        joined[r.doc_id, r.cluster].append((r.start_word, r.text))
    for (doc_id, _), parts in joined.items():
        copies = sum(at == 0 for at, _ in parts)
        text = "".join(t for _, t in sorted(parts)[::copies]).rstrip()
        assert whole.pop((doc_id, text)) == copies
    assert not whole
    fill, clusters = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        fill[r.bin_id] += r.n_words
        clusters[r.bin_id].append(r.cluster)
    assert max(fill.values()) <= 100
    assert all(len(c) == len(set(c)) for c in clusters.values())
    words = collections.Counter()
    for r in rows:
        words[r.doc_id] += r.n_words
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id] += len(WORD.findall(r.text or ""))
    assert words == +want
    assert packing.pack(empty(docs)).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"g{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(good if i % 4 else bad, 30)), "en", "s", 1) for i in range(600)] + [(700, None, None, None, None), (701, "", "en", "s", 0), (None, "g1 g2", "en", "s", 1)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.97
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and 400 < kept.count() < 500
    for few in (empty(labels), labels.where("quality = 1")):
        assert {r.score for r in quality.score(docs, quality.train(docs, few)).collect()} <= {0.5, 1.0}
    assert quality.score(empty(docs), quality.train(docs, labels)).count() == 0


def test_labels_of_the_held_out_third_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 2}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda x: sorted((r.doc_id, r.score) for r in quality.score(docs, quality.train(docs, x)).collect())
    assert scores(labels) == scores(flipped)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    t = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    found = [("email", m.span()) for m in EMAIL.finditer(t)]
    found += [("ip", m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [("card", m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return found + [("phone", m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]


def test_personal_data(spark):
    hard = ["a@b.c@d.e x@a.b-c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.0004 1.1.1", "4111 1111 1111 1111 x 4111-1111-1111-1111-1 +1 (415) 555-2671 +12", "é😀 mail me@x.io 😀 10.0.0.1", "a" * 20000, "1 " * 20000, "a.b." * 5000 + "@x.y" + ".z" * 5000, "+1" + "-" * 20000 + "x", "1.2.3." * 3000, "x@y.z@"]
    docs = odd_documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(200 + i, t) for i, t in enumerate(hard)], "doc_id long, text string"), allowMissingColumns=True)
    text = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        text[r.doc_id].append(r.text)
    got = pii.digest(docs).collect()
    assert len(got) == sum(map(len, text.values()))
    for r in got:
        if r.doc_id is None:
            continue
        spans = base_spans(text[r.doc_id][0])
        line = ",".join(f"{k}:{a}:{b}" for k, (a, b) in spans)
        count = collections.Counter(k for k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line)
    assert pii.digest(empty(docs)).count() == 0


def test_added_kinds_need_checksum_and_context(spark):
    df = spark.createDataFrame([(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "123-45-6789")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in pii.digest(df).collect()} == {1: "iban:5:32", 2: "", 3: "ssn:4:15", 4: ""}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é me@x.io, 10.0.0.1!", 20, "keep"), (2, None, None, "keep"), (3, "plain", 5, "keep")], "doc_id long, text string, n_chars long, pii string")
    got = {r.doc_id: (r.text, r.n_chars, r.pii) for r in pii.redacted(docs).collect()}
    assert got == {1: ("é <EMAIL>, <IP>!", 16, "keep"), 2: (None, None, "keep"), 3: ("plain", 5, "keep")}


def test_paragraphs(spark):
    passage = "One two three four five six seven eight nine ten. Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. Red orange yellow green blue indigo violet black white grey pink brown."
    near = passage.replace("grey pink", "grey rose")
    long_one = " ".join(f"t{i}" for i in range(100)) + "."
    changed = long_one.replace("t50 ", "t5x ")
    rows = [(1, "before it " + passage + " after it all there is no more of that kind here at all."), (2, "Other\n" + passage), (3, near), (4, long_one), (5, changed), (6, "All rights are reserved by the owner of this."), (7, "All rights are reserved by the owner of this."), (8, None), (9, ""), (None, long_one), (10, long_one), (10, long_one)]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    text = dict(rows)
    assert set(by_doc) == {1, 2, 3, 4, 5, 10, None}
    assert any(text[1][r.start : r.end].startswith("Alpha") for r in by_doc[1]) and not any(r.removed for r in by_doc[4])
    assert all(r.removed for r in by_doc[2] if r.start > 6) and all(r.removed for r in by_doc[3]) and all(r.removed for r in by_doc[5]) and all(r.removed for r in by_doc[None])
    assert len({r.group_id for d in (4, 5, 10, None) for r in by_doc[d]}) == 1
    assert paragraphs.repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert paragraphs.bands_for(80, 0.99, 2) == 5


def test_paragraphs_against_all_pairs(spark):
    """Groups are the components of exact similarity over all paragraphs."""
    docs = odd_documents(spark)
    got = collections.defaultdict(set)
    for r in paragraphs.repeated_paragraphs(docs).collect():
        got[r.group_id].add((r.doc_id, r.start))
    rows, items = docs.select("doc_id", "text").collect(), []
    for r in rows:
        for line in re.finditer(r"[^\n]+", r.text or ""):
            at = [(m.start() + line.start(), m.end() + line.start()) for m in WORD.finditer(line.group())]
            if len(at) >= 8:
                items.append((r.doc_id, at[0][0], len(at), shingles(line.group(), 5)))
    links = [(i, j) for i in range(len(items)) for j in range(i) if 100 * len(items[i][3] & items[j][3]) >= 80 * len(items[i][3] | items[j][3])]
    groups = collections.defaultdict(list)
    for i, c in enumerate(components(len(items), links)):
        groups[c].append(items[i])
    want = [{(d, s) for d, s, n, _ in g if n >= 20} for g in groups.values() if len(g) > 1]
    assert sorted(map(sorted, (map(repr, g) for g in got.values()))) == sorted(map(sorted, (map(repr, g) for g in want if g)))


@pytest.mark.parametrize("rare", [True, False])
def test_quality_learns_from_few_rows_of_one_class(rare):
    """Three rows of one class among 300, none of them where the curve takes its rows, still make a model."""
    rng = np.random.default_rng(6)
    good = np.full(300, not rare)
    good[[1, 102, 203]] = rare
    rows = [np.unique(rng.integers(0, 50, 20) + (1000 if y else 2000)).astype(np.int32) for y in good]
    model = quality.fit(rows, good)
    assert model.weights is not None
    margin = model.slope * quality.margins(rows, model.weights, model.intercept) + model.shift
    assert ((margin >= 0) == good).all()
    assert quality.fit(rows, np.ones(300, dtype=bool)).weights is None


@pytest.mark.parametrize("kind", ["short sentences", "one line", "cut sentences"])
def test_passages_are_found_wherever_they_lie(spark, kind):
    """Of a passage of 60 words all copies but the first are removed, to the word."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    passage = fresh(60)
    if kind == "short sentences":
        passage = [w + "." * (i % 5 == 4) for i, w in enumerate(passage)]
    if kind == "cut sentences":
        passage = [w + "." * (i % 40 == 19) for i, w in enumerate(passage)]
    rows = [(d, fresh(50 + d), fresh(70)) for d in (1, 2, 3)]
    docs = [(d, " ".join([*a, *passage, *b])) for d, a, b in rows] + [(4, " ".join(fresh(150))), (5, None), (6, "é " * 500 + "end")]
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    text = dict(docs)
    for d, a, _ in rows:
        spans = [r for r in got if r.doc_id == d and text[d][r.start : r.end] == " ".join(passage)]
        assert [(r.n_words, r.n_occurrences, r.first_doc_id, r.removed) for r in spans] == [(60, 3, 1, d != 1)]
    assert {r.doc_id for r in got} == {1, 2, 3}


def test_passages_against_all_windows(spark):
    """Words of passages are those of windows that occur again, and each occurrence of a group is the same words."""
    from textwarden.llm.passages import WINDOW, repeated_passages

    rng = np.random.default_rng(12)
    parts = [[f"p{k}w{i}" for i in range(rng.integers(5, 60))] for k in range(12)]
    texts = [[w for k in rng.integers(0, 12, rng.integers(1, 6)) for w in (*parts[k][rng.integers(0, 4) :], *(f"f{v}" for v in rng.integers(0, 10**9, rng.integers(0, 2))))] for _ in range(40)]
    texts += [["a", "b", "c"] * 100, ["a", "b", "c"] * 90, ["alone"] * 200, texts[0]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = repeated_passages(docs, Scratch(spark, "t")).collect()
    places = collections.defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - WINDOW + 1):
            places[tuple(t[i : i + WINDOW])].append((d, i))
    want = set()
    for found in places.values():
        if any(e != d or j - i >= WINDOW for (d, i), (e, j) in zip(found, found[1:], strict=False)):
            want |= {(d, i + k) for d, i in found for k in range(WINDOW)}
    assert {(r.doc_id, i) for r in got for i in range(r.place, r.reach)} == want
    groups = collections.defaultdict(list)
    for r in got:
        assert " ".join(texts[r.doc_id])[r.start : r.end].split() == texts[r.doc_id][r.place : r.reach]
        groups[r.group_id].append(r)
    for rows in groups.values():
        first = min(rows, key=lambda r: (r.doc_id, r.place))
        assert len(rows) == rows[0].n_occurrences > 1 and [r for r in rows if not r.removed] == [first] and {r.first_doc_id for r in rows} == {first.doc_id}
        assert len({" ".join(texts[r.doc_id][r.place : r.reach]) for r in rows}) == 1 or texts[first.doc_id][first.place] in "abc"
    assert repeated_passages(docs.where("false"), Scratch(spark, "t")).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(8), Scratch(spark, "t")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    comp = components(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[comp[i]] for i, x in enumerate(nodes)}


@pytest.mark.parametrize("most_edges", [1, 5, 40, 1_000_000])
def test_components_of_few_edges_take_no_rounds(spark, monkeypatch, most_edges):
    """One task finishes what it can hold, and larger tables give the same by rounds."""
    monkeypatch.setattr(component_module, "MOST_EDGES", most_edges)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (60, 2))] + [(1000 - i, 1001 - i) for i in range(120)]
    scratch = Scratch(spark, "t")
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8), scratch).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    comp = components(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[comp[i]] for i, x in enumerate(nodes)}
    assert (scratch.count == 2) == (most_edges > 1000)


def test_paragraphs_link_through_rows_without_id(spark):
    words = [f"v{i}" for i in range(60)]
    cut = lambda i: " ".join(words[3 * i :] + [f"n{i}x{k}" for k in range(3 * i)]) + "."
    rows = [(5, cut(0)), (None, cut(1)), (6, cut(2)), (7, " ".join(f"z{i}" for i in range(60)) + ".")]
    got = [r for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_words == 60]
    assert sorted((r.doc_id or 0, r.n_occurrences, r.first_doc_id) for r in got) == [(0, 3, 5), (5, 3, 5), (6, 3, 5)]


def test_paragraphs_are_cut_where_documents_are_read(spark, monkeypatch):
    """No text is dealt over tasks to be cut, and of repeated rows, with an id or not, a task hands on one text a paragraph."""
    line = [f"v{i}" for i in range(60)]
    texts = [" ".join(["\u00e9", *line[:k], "changed", *line[k + 1 :]]) + ".\nshort \u00fc line\n" + " ".join(f"{k}z{i}" for i in range(40)) for k in range(4)]
    rows = [(7, texts[0])] * 20 + [(None, texts[1])] * 20 + [(8, texts[2]), (8, texts[3]), (9, None), (10, "")]
    given, base = {}, paragraphs.verified_components

    def verified(candidates, texts, *rest):
        given.update(keys={r.key for r in candidates.collect()}, texts=texts.collect(), plan=texts._jdf.queryExecution().toString())
        return base(candidates, texts, *rest)

    monkeypatch.setattr(paragraphs, "verified_components", verified)
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    near = [r for r in got if r.n_words == 61]
    assert len(near) == 42 and {(r.n_occurrences, r.first_doc_id) for r in near} == {(42, 7)} and sum(not r.removed for r in near) == 20
    assert "Exchange" not in given["plan"]
    assert len(given["keys"]) == 4 and sorted(r.key for r in given["texts"] if r.key in given["keys"]) == sorted(given["keys"])
    assert {r.text for r in given["texts"] if r.key in given["keys"]} == {t.split("\n")[0] for t in texts}


def test_passages_are_dealt_once_by_place(spark):
    """Stretches are joined and grouped where they were dealt to, and covered words are summed where the document's rows are."""
    from textwarden.llm.passages import repeated_passages

    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, 60))) for i in range(4)], "doc_id long, text string")
    plan = repeated_passages(docs, Scratch(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    plan = paragraphs.repeated_paragraphs(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(row_id" not in plan
