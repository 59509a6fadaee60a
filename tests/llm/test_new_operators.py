"""The prefix trie, fill-in-middle and licence scan against brute force, with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tests.llm.data import empty, odd_documents
from textwarden.llm import fim, licenses, trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    ends = collections.defaultdict(list)
    for c in sorted(built):
        ends[built[c]].append(str(c))
    sha = lambda p: hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], sha(p)) for p, cs in members.items())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as key", "1 as depth", "1 as chain", "1 as turns")


def odd_conversations(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "nobody's"), (7, None, None, None), (7, None, "user", None), (7, 1, "user", "é 😀"), (900, 0, "user", ""), (900, 0, "user", "")]
    stems = [[("user", f"s{i}"), ("assistant", "same" * i)] * 3 for i in range(3)]
    for c in rng.sample(range(100, 700), 180):
        turns = list(rng.choice(stems)[: rng.randint(0, 6)]) + [(rng.choice("ua"), rng.choice(["x", "yy", "x" * 40])) for _ in range(rng.choice([0, 0, 1, 2, 5]))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    # One conversation under many ids, and one far longer than all.
    for c in range(2000, 2090):
        rows += [(c, t, "user", f"copy {t}") for t in range(8)]
    rows += [(3000 + c, t, "user", f"deep {min(t, 70 + c)}") for c in range(4) for t in range(80)]
    return rows


@pytest.mark.parametrize(("turns_a_task", "chains_a_task", "block"), [(500_000, 64, 8192), (60, 3, 5), (15, 2, 2)])
def test_trie(spark, monkeypatch, turns_a_task, chains_a_task, block):
    monkeypatch.setattr(trie, "TURNS_A_TASK", turns_a_task)
    monkeypatch.setattr(trie, "CHAINS_A_TASK", chains_a_task)
    monkeypatch.setattr(trie, "RUN_BLOCK", block)
    rows = odd_conversations(turns_a_task)
    got = trie.nodes(conversations(spark, rows).repartition(5)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)


def test_trie_of_few_conversations(spark):
    assert trie.nodes(conversations(spark, [(1, 0, "u", "t")]).where("false")).count() == 0
    for rows in ([(5, 0, "u", "abc")], [(5, 0, "u", "abc"), (6, 0, "u", "abc")], [(c, 0, "u", "t") for c in range(101, 140)]):
        assert sorted(map(tuple, trie.nodes(conversations(spark, rows)).select(*COLUMNS).collect())) == brute_trie(rows)


TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    w = TOKEN.findall(text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(w), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text)


def test_fill_in_middle(spark, monkeypatch):
    import textwarden.llm.wordhash as wordhash

    rng = random.Random(3)
    odd = ["<", "<P", "a<S>b", "<<M", "P><", "\x00\x7f", "é", "😀a😀", "ab" * 50, "\r\n", "ñÑabc123", " "]
    rows = [(i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(i, "".join(rng.choices("aZ é<\n7😀", k=rng.randint(1, 500)))) for i in range(300, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_documents(spark).select("doc_id", "text"))
    want = sorted((brute_fim(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sorted((tuple(r) for r in fim.digest(docs).collect()), key=repr) == want
    monkeypatch.setattr(wordhash, "PIECE", 50)
    texts = [t for _, t in rows]
    import pyarrow as pa

    cuts = fim.find_cuts(pa.array(texts), pa.array([5] * len(texts)), pa.array([11] * len(texts)))
    assert [c["n_tokens"] for c in cuts.to_pylist()] == [len(TOKEN.findall(t)) for t in texts]


def test_fill_in_middle_keeps_other_columns(spark):
    docs = odd_documents(spark)
    made = fim.fill_in_middle(docs.withColumn("fim", docs.n))
    assert set(docs.columns) <= set(made.columns) and made.count() == docs.count()
    assert fim.digest(empty(docs)).count() == 0
    plain = {r.form for r in made.where("text is null or text = ''").select("fim.form").collect()}
    assert plain == {"plain"}


RULES = [(r, re.compile(r["pattern"])) for r in licenses.rules()]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_licenses(doc_id, text):
    w = re.findall(licenses.WORD, (text or "").translate(LOWER))
    norm = f" {' '.join(w)} ".replace(" licence", " license")
    base = [(label, i) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    hits = []
    for r, pattern in RULES:
        for m in pattern.finditer(norm):
            start = norm[: m.start()].count(" ") - 1
            hits.append((start, start + m.group().count(" ") + 1, r["priority"], r["rule"], r["label"], r["score"]))
    inside = lambda h, g: g[0] <= h[0] and g[1] >= h[1] and g[2] <= h[2] and (g[:2] != h[:2] or g[2:4] < h[2:4])
    kept = [h for h in hits if not any(inside(h, g) for g in hits)]
    places = [i for _, i in base]
    labels = {label for label, _ in base}
    score = max([h[5] for h in kept] + [licenses.BASE_SCORE] * bool(base) + [0.0])
    return doc_id, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {h[4] for h in kept})), score


def test_license_scan(spark):
    rng = random.Random(5)
    said = [
        "under the MIT License", "Apache License, Version 2.0", "CC-BY-NC", "cc by nc sa 4.0", "SPDX-License-Identifier: GPL-3.0", "licensed under the terms of the BSD 3-Clause license",
        "GNU General Public License version 2 or (at your option) any later version", "released under the Mozilla Public License 2.0", "under the MIT licence", "licence: ISC", "https://opensource.org/licenses/MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "all rights reserved", "mit", "license", "under", "é", "the", "2", "\x01", "creative commons attribution 4.0 license", "apache license",
    ]
    rows = [(i, rng.choice([" ", "\n", ". ", "-"]).join(rng.choice(said) for _ in range(rng.randint(0, 14)))) for i in range(200)]
    rows.append((999, " ".join(["under the mit license apache license version 2 0"] * 4000)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_documents(spark).select("doc_id", "text"))
    small = docs.where("doc_id is null or doc_id <> 999")
    want = sorted((brute_licenses(r.doc_id, r.text) for r in small.collect()), key=repr)
    got = licenses.digest(docs).collect()
    assert sorted((tuple(r) for r in got if r.doc_id != 999), key=repr) == want
    long = next(r for r in got if r.doc_id == 999)
    assert (long.n_base, long.first_word, long.last_word, long.base_labels) == (8000, 0, 9 * 3999 + 4, "apache-2,mit")


def test_license_rules_name_their_words():
    rules = licenses.rules()
    assert len(rules) >= 300 and all(r["words"] and r["one_of"] for r in rules)
    for sentence in licenses.SENTENCES:
        assert all(re.search(rf"\\b{w}|{w}\\b|{w}", sentence[1]) for w in sentence[2].split())


def test_license_scan_of_odd_tables(spark):
    docs = odd_documents(spark)
    assert licenses.digest(empty(docs)).count() == 0
    made = licenses.find_licenses(docs.withColumn("licenses", docs.n))
    assert set(docs.columns) <= set(made.columns) and made.count() == docs.count()
