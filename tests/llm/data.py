"""Small tables with every odd case, shared by the tests."""

import random

LONG = "long " * 40_000


def odd_documents(spark, extra=True):
    """Nulls in each column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, " ".join(near), "en", "b"),
        (3, base, "en", "a"),
        (3, base, "en", "a"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, " \t\n", "en", None),
        (7, LONG, "en", "c"),
        (8, "two words", "en", "b"),
        (9, "two words", "en", "b"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (10, base.upper(), "en", "a"),
    ] + [(20 + i, prose(rng.randint(1, 200)), "en", rng.choice("abc")) for i in range(60)]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("n", "gid", "bucket", "component", "size", "copies", "pii", "spans", "rank", "place", "node", "key"):
            df = df.selectExpr("*", f"1 as `{name}`")
    return df


def empty(df):
    return df.where("false")


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]
