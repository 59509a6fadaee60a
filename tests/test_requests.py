"""Bodies, images, mentions, labels and normalization."""

import base64
import random
import unicodedata

from pyspark.sql import functions as F

from textwarden.functions.images import image_size
from textwarden.functions.detectors import ScanConfig
from textwarden.functions.normalization import find_all, normalize
from textwarden.operators import labels, requests


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def png(w, h):
    return base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")).decode()


def test_image_sizes(spark):
    assert image_size(png(30, 40)) == (30, 40)
    assert image_size(base64.b64encode(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little")).decode()) == (7, 9)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (50).to_bytes(2, "big") + (60).to_bytes(2, "big") + b"\0" * 10
    assert image_size(base64.b64encode(jpeg).decode()) == (60, 50)
    assert image_size("????") is None and image_size(None) is None
    df = spark.createDataFrame([("s", 1, png(280, 280)), ("s", 2, png(280, 280)), ("s", 2, "AAAA")], "session_id string, request_id int, data string")
    assert rows(requests.image_totals(df, ["session_id"]), "n_images", "n_requests", "tokens", "n_unknown") == [(2, 2, 200, 1)]


def test_sections_and_conversation(spark):
    body = '{"model": "m", "tools": [1, 2], "messages": [{"role": "user", "content": "hé"}]}'
    df = spark.createDataFrame([(1, body), (2, "[]"), (3, None)], "id int, body string")
    got = dict(rows(requests.section_bytes(df, ["id"]), "name", "bytes"))
    assert got == {"tools": 5, "messages": 33, "rest": len('{"model":"m","tools":,"messages":}')}
    keys = [r.k for r in df.select(requests.conversation_key(F.col("body")).alias("k")).collect()]
    assert len(keys[0]) == 16 and keys[1:] == [None, None]


def test_mentions(spark):
    prompts = spark.createDataFrame([(1, "/w", 'see @a.txt and @"b c.txt" and @a.txt#L2-3, mail x@y.z @gone')], "id int, cwd string, prompt string")
    files = spark.createDataFrame([("/w", "a.txt", "1\n2\n3\n4"), ("/w", "b c.txt", "bc"), ("/w", "gone", "\x00")], "cwd string, name string, content string")
    assert rows(requests.attach_mentions(prompts, files, ["id"]), "name", "content") == [("a.txt", "1\n2\n3\n4"), ("a.txt", "2\n3"), ("b c.txt", "bc")]


def test_costliest_and_findings(spark):
    priced = spark.createDataFrame([("s", 1, 2.0, 10), ("s", 2, 2.0, 30), ("t", 1, 5.0, 7), ("t", 2, None, 9)], "session_id string, seq int, cost double, request_bytes int")
    assert rows(requests.costliest_and_largest(priced, ["session_id"]), "session_id", "costliest_seq", "largest_seq") == [("s", 1, 2), ("t", None, 2)]
    r = spark.createDataFrame([("s", "m", True)], "session_id string, model_id string, rewrite boolean")
    d = spark.createDataFrame([("s", "/v1/messages", False)], "session_id string, path string, duplicate boolean")
    t = spark.createDataFrame([("s", "t1", 30_000, 4), ("s", "t2", 26_000, 1)], "session_id string, tool_use_id string, bytes long, carried long")
    assert rows(requests.traffic_findings(r, d, t), "rule", "subject", "occurrences") == [("cache-rewrite", "m", 1), ("large-result", "t1", 4)]


def test_labels(spark):
    df = spark.createDataFrame([(1, "/x/" + "y" * 200 + "/a@x.com"), (2, None), (3, "plain")], "i int, target string")
    got = dict(rows(labels.scrub_target(df), "i", "target"))
    assert got[1].endswith("<EMAIL_1>") and len(got[1]) == 121 and got[2] is None and got[3] == "plain"
    names = spark.createDataFrame([("ok",), (" ",), ("a" * 121,), ("b\x00",)], "n string")
    assert [r[0] for r in names.select(labels.display_label(F.col("n"))).collect()] == ["ok", "unknown", "unknown", "unknown"]


def test_normalization_maps_back():
    n = normalize("a%40b\u200b.ﬁ e\u0301x")
    assert n.text == "a@b.fi éx"
    at = n.text.index("@")
    assert n.to_source(at, at + 1) == (1, 4) and n.to_source(n.text.index("é"), n.text.index("é") + 1) == (9, 11)
    assert normalize("plain").to_source(1, 3) == (1, 3)
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab%4é\u0301\u200bﬁ①") for _ in range(30))
        n = normalize(text)
        assert len(n.text) == len(n.starts) == len(n.ends) and all(0 <= a < b <= len(text) for a, b in zip(n.starts, n.ends, strict=True))
        if "%" not in text:
            plain = text.replace("\u200b", "")
            assert n.text == unicodedata.normalize("NFKC", plain) or plain[:1] == "\u0301"


def test_hidden_forms_are_found():
    at = lambda t: sorted((e, t[a:b]) for e, a, b, _, _ in set(find_all(t, ScanConfig())))
    assert at("mail jane%40example.com now") == [("EMAIL", "jane%40example.com")]
    assert at("card 4111\u200b1111\u200b1111\u200b1111 x") == [("CREDIT_CARD", "4111\u200b1111\u200b1111\u200b1111")]
    assert at("caf\u00e9 a@x.com") == [("EMAIL", "a@x.com")]
