"""Bodies of model requests: sections, images, mentions of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.images import image_size
from textwarden.functions.reshaping import compact_json
from textwarden.operators.traffic import image_tokens

SECTIONS = ("tools", "system", "messages")
#: Files attached to a prompt, bytes of one and of all.
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 8, 262_144, 1_000_000


def section_bytes(requests: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``keys, name, bytes``: compact UTF-8 sizes of tools, system, messages and the rest of each body that is an object."""
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, sizes = [], [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    value = json.loads(text or "")
                except ValueError:
                    continue
                if not isinstance(value, dict):
                    continue
                size = lambda v: len(json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
                parts = {n: size(value[n]) for n in SECTIONS if n in value}
                parts["rest"] = max(0, len(compact_json(text).encode("utf-8", "surrogatepass")) - sum(parts.values()))
                at += [i] * len(parts)
                names += parts
                sizes += parts.values()
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in range(len(keys))] + [pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=[*keys, "name", "bytes"])

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in requests.select(*keys).schema.fields] + ["name string", "bytes bigint"])
    return requests.select(*keys, body).mapInArrow(run, schema)


def conversation_key(body: Column) -> Column:
    """A short hash of the first message of a user."""
    messages = F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string,content:string>>")
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))
    return F.when(first.isNotNull(), F.substring(F.sha2(F.to_json(first), 256), 1, 16))


def image_totals(images: DataFrame, keys: list[str], encoded: str = "data") -> DataFrame:
    """Different images by key, requests with one, their tokens in all, and those of unknown size.

    ``images``: a row for each image of a request (``request_id``, base64 ``data``); equal images are measured once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [image_size(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s and s[0] for s in sizes], pa.int32()), pa.array([s and s[1] for s in sizes], pa.int32())], names=["digest", "width", "height"])

    with_digest = images.withColumn("digest", F.sha2(encoded, 256))
    measured = with_digest.groupBy("digest").agg(F.first(encoded).alias("data")).mapInArrow(run, "digest string, width int, height int").withColumn("tokens", image_tokens(F.col("width"), F.col("height")))
    rows = with_digest.select(*keys, "request_id", "digest").join(measured, "digest")
    return rows.groupBy(*keys).agg(F.count_distinct("digest").alias("n_images"), F.count_distinct("request_id").alias("n_requests"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens").isNull()).alias("n_unknown"))


def mentions(prompts: DataFrame, keys: list[str], text: str = "prompt") -> DataFrame:
    """``keys, no, name, first, last``: the ``@name``, ``@"name"`` and ``@name#L3-9`` of prompts, each once, in order."""
    pattern = r'(?:^|\s)@(?:"([^"\n]{1,400})"|([^\s"#@,;]{1,400}))(?:#L([0-9]{1,6})(?:-([0-9]{1,6}))?)?'
    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    rows = prompts.select(*keys, F.posexplode(F.arrays_zip(part(1).alias("quoted"), part(2).alias("plain"), part(3).alias("a"), part(4).alias("b"))).alias("no", "m"))
    number = lambda c: F.expr(f"try_cast(nullif(m.{c}, '') as int)")
    named = rows.select(*keys, "no", F.coalesce(F.nullif("m.quoted", F.lit("")), F.regexp_replace("m.plain", r"[.:!?)]+$", "")).alias("name"), number("a").alias("first"), F.coalesce(number("b"), number("a")).alias("last")).where("name != ''")
    return named.groupBy(*keys, "name", "first", "last").agg(F.min("no").alias("no"))


def attach_mentions(prompts: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, no, name, content``: files (``cwd, name, content``) that prompts (with ``cwd``) mention.

    Lines are sliced; texts with NUL bytes or over the size of one file are left
    out; of the rest those are taken, in order, that still fit into what all may
    have, eight at most: one that does not fit is passed over and the next is tried.
    """
    named = mentions(prompts, [*keys, "cwd"]).join(files, ["cwd", "name"])
    lines = F.split("content", "\n")
    sliced = F.when(F.col("first").isNull(), F.col("content")).when(F.col("first") >= 1, F.array_join(F.slice(lines, F.greatest("first", F.lit(1)), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")).otherwise(F.lit(""))
    fit = named.withColumn("content", sliced).where(~F.contains("content", F.lit("\x00")) & (F.octet_length("content") <= MOST_FILE_BYTES))
    item = F.struct("no", "name", "content", F.octet_length("content").alias("bytes"))
    # The choice depends on what was taken before; a prompt mentions few files, so it is folded in its row.
    choose = lambda state, x: F.when((F.size(state["taken"]) < MOST_FILES) & (state["used"] + x["bytes"] <= MOST_BYTES), F.struct((state["used"] + x["bytes"]).alias("used"), F.concat(state["taken"], F.array(x)).alias("taken"))).otherwise(state)
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<no:int,name:string,content:string,bytes:int>>)").alias("taken"))
    chosen = fit.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("taken", F.aggregate("items", start, choose, lambda s: s["taken"]))
    return chosen.select(*keys, F.explode("taken").alias("x")).select(*keys, "x.no", "x.name", "x.content")


def costliest_and_largest(priced: DataFrame, keys: list[str]) -> DataFrame:
    """By key: the request of the highest cost (only where two are priced) and the one of most bytes, the first on ties."""
    top = lambda by: F.max_by(F.struct("seq", by), F.when(F.col(by).isNotNull(), F.struct(F.col(by), -F.col("seq"))))
    out = priced.groupBy(*keys).agg(F.count("cost").alias("n_priced"), top("cost").alias("c"), top("request_bytes").alias("b"))
    return out.select(*keys, F.when(F.col("n_priced") > 1, F.col("c.seq")).alias("costliest_seq"), F.when(F.col("n_priced") > 1, F.col("c.cost")).alias("cost"), F.col("b.seq").alias("largest_seq"), F.col("b.request_bytes").alias("request_bytes"))


def traffic_findings(rewrites: DataFrame, duplicates: DataFrame, results: DataFrame, most_result: int = 25_000) -> DataFrame:
    """Findings over sessions: cache rewrites by model, duplicate requests, and the largest tool result over a size.

    ``session_id, rule, subject, occurrences``.
    """
    a = rewrites.where("rewrite").groupBy("session_id", F.lit("cache-rewrite").alias("rule"), F.col("model_id").alias("subject")).agg(F.count("*").alias("occurrences"))
    b = duplicates.where("duplicate").groupBy("session_id", F.lit("duplicate-request").alias("rule"), F.col("path").alias("subject")).agg(F.count("*").alias("occurrences"))
    by = Window.partitionBy("session_id").orderBy(F.desc("bytes"), "tool_use_id")
    c = results.where(F.col("bytes") > most_result).withColumn("_no", F.row_number().over(by)).where("_no = 1").select("session_id", F.lit("large-result").alias("rule"), F.col("tool_use_id").alias("subject"), F.col("carried").cast("long").alias("occurrences"))
    return a.unionByName(b).unionByName(c)
