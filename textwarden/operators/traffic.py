"""Meter logged model requests: usage, cost, cache rewrites, duplicates, results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textwarden.functions.checks import is_json
from textwarden.functions.scans import let, running_sums
from textwarden.operators.ranks import values_at

#: Characters of a response's texts that are kept.
MOST_CHARACTERS = 1_000_000
#: Paths of model requests.
MODEL_PATH = r"(?:messages|responses|completions)$"


def model_exchanges(exchanges: DataFrame) -> DataFrame:
    return exchanges.where(F.col("path").rlike(MODEL_PATH))


#: Where counts of tokens stand: at the top, in ``message`` or in ``response``.
ROOTS = ("", "message.", "response.")


def _counts(read: Callable[[str], Column]) -> dict[str, Column]:
    """What one object of counts says, by name: the first non-negative integer of those that mean the same."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.when(t.rlike("^[0-9]{1,18}$"), t.cast("bigint")) for t in map(read, names)])

    return {
        "inputs": first("input_tokens", "prompt_tokens"),
        "outputs": first("output_tokens", "completion_tokens"),
        "write": first("cache_creation_input_tokens"),
        "hour": first("cache_creation.ephemeral_1h_input_tokens"),
        "read": first("cache_read_input_tokens"),
        "cached": first("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens"),
    }


def _usage(of: Callable[[str], Column]) -> Column:
    return F.struct(
        (of("inputs") - F.coalesce(of("cached"), F.lit(0))).alias("input_tokens"),
        of("outputs").alias("output_tokens"),
        of("write").alias("cache_write"),
        F.coalesce(of("read"), of("cached")).alias("cache_read"),
        F.least(of("hour"), of("write")).alias("cache_write_1h"),
    )


def usage_of(json: Column) -> Column:
    """Token counts of a response or event: two naming schemes, at the top, in ``message`` or in ``response``."""
    counts = [_counts(lambda name, root=root: F.get_json_object(json, f"$.{root}usage.{name}")) for root in ROOTS]
    return _usage(lambda name: F.coalesce(*[c[name] for c in counts]))


def _field(value: Column, path: str) -> Column:
    """A field of a parsed value by its path; ``[0]`` behind a name is the first element."""
    for step in path.split("."):
        value = F.get(value[step.removesuffix("[0]")], F.lit(0)) if step.endswith("[0]") else value[step]
    return value


def sse_events(exchanges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, seq, json``: the events of streamed responses; ``json`` is null where a frame is not JSON."""
    frames = F.split(F.regexp_replace("response", "\r\n", "\n"), "\n\n")
    data = F.array_join(F.transform(F.filter(F.split(F.col("frame"), "\n"), lambda line: line.startswith("data:")), lambda line: F.regexp_replace(line, "^data: ?", "")), "\n")
    rows = exchanges.select(*keys, F.posexplode(frames).alias("seq", "frame")).withColumn("data", data).where("data not in ('', '[DONE]')")
    return rows.select(*keys, "seq", F.when(is_json(F.col("data")), F.col("data")).alias("json"))


def merge_usage(events: DataFrame, keys: list[str]) -> DataFrame:
    """Usage of streams: the first input, write and read that are not zero, the largest output; how much is known."""
    u = events.where("json is not null").withColumn("u", usage_of(F.col("json")))
    first = lambda name: F.coalesce(F.min_by(F.when(F.col(f"u.{name}") > 0, F.col(f"u.{name}")), F.when(F.col(f"u.{name}") > 0, F.col("seq"))), F.max(f"u.{name}"))
    merged = u.groupBy(*keys).agg(first("input_tokens").alias("input_tokens"), F.max("u.output_tokens").alias("output_tokens"), first("cache_write").alias("cache_write"), first("cache_read").alias("cache_read"), first("cache_write_1h").alias("cache_write_1h"))
    known = F.when(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull(), "known").when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), "partial").otherwise("unavailable")
    return merged.withColumn("usage_status", known)


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of tokens by key, and the share of prompts that came from the cache."""
    prompt = F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_write", "cache_read")]
    return usage.groupBy(*keys).agg(*sums, F.round(F.sum("cache_read") / F.sum(prompt), 6).alias("read_share"))


REASONS = ("stop_reason", "delta.stop_reason", "choices[0].finish_reason", "response.incomplete_details.reason", "message.stop_reason")


def _stop_reason(found: Column) -> Column:
    return F.when((F.length(found) > 40) | found.rlike(r"[^\x20-\x7E]"), "unknown").otherwise(found)


def stop_reason_of(json: Column) -> Column:
    """The first reason of five places that is not empty; long or unprintable ones are unknown."""
    return _stop_reason(F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{p}"), F.lit("")) for p in REASONS]))


def model_id(model: Column) -> Column:
    """A model's name without ``-latest`` and a date."""
    return F.regexp_replace(model, r"-(?:latest|[0-9]{8})$", "")


def price_join(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with ``cost`` in dollars: the row of its model with the highest fitting ``min_prompt``; null if unpriced.

    ``prices``: ``model_id, min_prompt, input, write, write_1h, read, output`` in
    dollars a million tokens; a table of the job, a row or two a model.
    """
    rates = ("min_prompt", "input", "write", "write_1h", "read", "output")
    # One row a model with all its steps, so the choice is made in the row of the usage.
    p = prices.groupBy(F.col("model_id").alias("_model")).agg(F.collect_list(F.struct(*rates)).alias("_steps"))
    prompt = F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")
    step = F.array_max(F.filter("_steps", lambda s: s["min_prompt"] <= prompt))
    joined = usage.join(p, F.col("model_id") == F.col("_model"), "left").withColumn("_p", step)
    fresh = (F.col("cache_write") - F.col("cache_write_1h")) * F.col("_p.write")
    cost = (F.col("input_tokens") * F.col("_p.input") + fresh + F.col("cache_write_1h") * F.col("_p.write_1h") + F.col("cache_read") * F.col("_p.read") + F.col("output_tokens") * F.col("_p.output")) / 1e6
    return joined.select(*usage.columns, cost.alias("cost"))


def cache_rewrites(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``requests`` with ``rewrite``: a warm request that reads under nine tenths of what came before it and writes.

    A request smaller than the one before starts a new chain; a chain is warm
    once a request before has read from the cache.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    shrinks = F.coalesce((F.col("request_bytes") < F.lag("request_bytes").over(by)).cast("int"), F.lit(0))
    chained = requests.withColumn("_shrinks", shrinks).withColumn("chain", F.sum("_shrinks").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "chain").orderBy(*order)
    warm = F.coalesce(F.max(F.col("cache_read") > 0).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    total = F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")
    before = F.lag(total).over(inside)
    rewrite = warm & (F.col("cache_read") * 10 < before * 9) & (F.col("cache_write") > 0)
    return chained.withColumn("rewrite", F.coalesce(rewrite, F.lit(False))).drop("_shrinks")


def duplicates_in_flight(requests: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``requests`` with ``duplicate``: begun while an equal one (same keys) before it is unanswered."""
    by = Window.partitionBy(*keys).orderBy("started", *order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("duplicate", F.coalesce(F.col("started") < F.max("ended").over(by), F.lit(False)))


def prefix_study(requests: DataFrame, session: list[str], order: list[str]) -> DataFrame:
    """One row a session, up to its first shrinking request: requests, cold ones at the start, whether reads never
    fall and follow the prompt, tokens created after the first request, and their upper median."""
    by = Window.partitionBy(*session).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("input_tokens") + F.col("cache_write") + F.col("cache_read")
    rows = requests.withColumn("_before", F.lag("request_bytes").over(by)).withColumn("_shrunk", F.max(F.coalesce(F.col("request_bytes") < F.col("_before"), F.lit(False))).over(upto))
    kept = rows.where(~F.col("_shrunk"))
    seen = (
        kept.withColumn("_no", F.row_number().over(by))
        .withColumn("_warm", F.max(F.col("cache_read") > 0).over(upto))
        .withColumn("_falls", F.coalesce(F.col("cache_read") < F.lag("cache_read").over(by), F.lit(False)))
        .withColumn("_low", F.coalesce((F.col("cache_read") > 0) & (F.col("cache_read") * 10 < F.lag(total).over(by) * 9), F.lit(False)))
    )
    later = F.when(F.col("_no") > 1, F.col("cache_write"))
    by_session = seen.groupBy(*session).agg(
        F.count("*").alias("n_requests"),
        F.count_if(~F.col("_warm")).alias("n_cold"),
        (~F.max("_falls")).alias("reads_grow"),
        (~F.max("_low")).alias("reads_follow"),
        F.coalesce(F.sum(later), F.lit(0)).alias("created_after_first"),
    )
    created = seen.select(*session, later.alias("_created")).where("_created is not null")
    middle = values_at(created, session, "_created", {"median_created": F.floor(F.col("n") / 2)}).drop("n")
    same = F.lit(True)
    for k in session:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}"))
    return by_session.alias("s").join(middle.alias("m"), same, "left").select("s.*", "m.median_created")


def attribute_tokens(sections: DataFrame, keys: list[str], total: str) -> DataFrame:
    """``sections`` (``name, bytes``) with ``tokens``: a total split by bytes, the rest to the largest (by name on ties)."""
    everything = Window.partitionBy(*keys)
    largest = F.row_number().over(everything.orderBy(F.desc("bytes"), "name")) == 1
    shared = sections.withColumn("_all", F.sum("bytes").over(everything)).withColumn("_largest", largest)
    # Whole-number division, so that no rounding of doubles comes in.
    shared = shared.withColumn("_share", F.expr(f"case when _all > 0 then ({total} * bytes) div _all else 0 end"))
    rest = F.col(total) - F.sum("_share").over(everything)
    return shared.withColumn("tokens", F.col("_share") + F.when(F.col("_largest"), rest).otherwise(0)).drop("_all", "_share", "_largest")


def image_tokens(width: Column, height: Column, edge: int = 1568, most: int = 1568, patch: int = 28) -> Column:
    """Tokens of an image: scaled to the edge of its tier, counted in patches, capped."""
    scale = F.least(F.lit(1.0), edge / F.greatest(width, height))
    across = F.ceil(F.floor(width * scale) / patch)
    down = F.ceil(F.floor(height * scale) / patch)
    return F.when((width > 0) & (height > 0), F.least(F.greatest(across, F.lit(1)) * F.greatest(down, F.lit(1)), F.lit(most)))


def tool_result_carry(results: DataFrame) -> DataFrame:
    """One row a tool use: its largest result and the requests that carried it at that size."""
    most = F.max("bytes").over(Window.partitionBy("session_id", "tool_use_id"))
    return results.withColumn("most", most).groupBy("session_id", "tool_use_id").agg(F.max("most").alias("bytes"), F.count_if(F.col("bytes") == F.col("most")).alias("carried"))


def compare_directions(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Entity counts of requests against those of responses."""
    a = requests.groupBy("entity").agg(F.sum("n").alias("in_requests"))
    b = responses.groupBy("entity").agg(F.sum("n").alias("in_responses"))
    joined = a.join(b, "entity", "full_outer")
    return joined.select("entity", F.coalesce("in_requests", F.lit(0)).alias("in_requests"), F.coalesce("in_responses", F.lit(0)).alias("in_responses"))


def scan_status(scans: DataFrame, keys: list[str]) -> DataFrame:
    """``known``, ``partial`` or ``unavailable`` for the scans of each key (``measured`` boolean)."""
    status = F.when(F.every("measured"), "known").when(F.some("measured"), "partial").otherwise("unavailable")
    return scans.groupBy(*keys).agg(status.alias("status"), F.count_if(~F.col("measured")).alias("n_unmeasured"))


def merge_stop_reasons(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last stop reason among the events of a stream."""
    reason = stop_reason_of(F.col("json"))
    return events.where("json is not null").withColumn("_r", reason).groupBy(*keys).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("seq"))).alias("stop_reason"))


def sse_texts(events: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block, kind, text``: the deltas of a stream put together again by block: text, thinking, tool input.

    A value that is split over deltas is whole in the text of its block.
    """
    at = lambda *paths: F.coalesce(*[F.get_json_object("json", p) for p in paths])
    text = at("$.delta.text", "$.choices[0].delta.content")
    thinking = at("$.delta.thinking", "$.choices[0].delta.reasoning_content")
    tool = at("$.delta.partial_json", "$.choices[0].delta.tool_calls[0].function.arguments")
    kind = F.when(text.isNotNull(), "text").when(thinking.isNotNull(), "thinking").when(tool.isNotNull(), "tool_input")
    block = F.coalesce(at("$.index", "$.choices[0].index").cast("int"), F.lit(0))
    parts = events.where("json is not null").select(*keys, "seq", block.alias("block"), kind.alias("kind"), F.coalesce(text, thinking, tool).alias("part")).where("kind is not null")
    joined = parts.groupBy(*keys, "block", "kind").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("parts"))
    return joined.select(*keys, "block", "kind", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


_COUNTS = (
    "struct<input_tokens:string,prompt_tokens:string,output_tokens:string,completion_tokens:string,cache_creation_input_tokens:string,cache_read_input_tokens:string,"
    "input_tokens_details:struct<cached_tokens:string>,prompt_tokens_details:struct<cached_tokens:string>,cache_creation:struct<ephemeral_1h_input_tokens:string>>"
)
#: All that is read of an event or response.
_EVENT = (
    f"struct<type:string,index:string,delta:struct<type:string,text:string,thinking:string,partial_json:string,stop_reason:string>,usage:{_COUNTS},stop_reason:string,"
    f"choices:array<struct<finish_reason:string>>,message:struct<usage:{_COUNTS},stop_reason:string>,response:struct<usage:{_COUNTS},incomplete_details:struct<reason:string>>>"
)


def fold_responses(exchanges: DataFrame, most: int = MOST_CHARACTERS) -> DataFrame:
    """``exchanges`` (``response, content_type``) with ``usage, usage_status, response_status, stop_reason, n_bad, blocks``.

    Everything is in the row of the exchange: a streamed response is cut into frames, and the texts of its
    deltas are put together by ``(kind, index)`` in ``blocks``, at most ``most`` characters in the order
    of the stream. ``response_status`` is unavailable for other content or without a good frame, partial
    with a bad frame, one that does not end, or texts that were cut, else known. ``usage_status`` is known with
    input and output counts, partial with one of them, or if a frame was bad after the last
    counts, else unavailable. A null response has no frames. Each frame is parsed once; of a key
    that it repeats the last counts.
    """
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    plain, supported = kind == "application/json", kind.isin("application/json", "text/event-stream")
    whole, frames = F.coalesce("response", F.lit("")), F.col("_frames")
    exchanges = exchanges.withColumn("_frames", F.split(F.regexp_replace(whole, "\r\n", "\n"), "\n\n+"))
    data = lambda frame: F.array_join(F.transform(F.filter(F.split(frame, "\n"), lambda line: line.startswith("data:")), lambda line: F.regexp_replace(line, "^data: ?", "")), "\n")
    # What stands after the last blank line is a frame that did not end.
    ended = F.transform(F.slice(frames, F.lit(1), F.size(frames) - 1), data)
    texts = F.when(plain, F.array(whole)).when(supported, F.filter(ended, lambda d: ~d.isin("", "[DONE]"))).otherwise(F.expr("cast(array() as array<string>)"))
    open_end = supported & ~plain & (F.element_at(frames, -1) != "")
    judged = F.transform(texts, lambda d: F.struct(d.alias("json"), is_json(d).alias("good")))
    told = F.transform(judged, lambda x: F.struct(x["json"].alias("json"), x["good"].alias("good"), (x["good"] & x["json"].rlike(r"^\s*\{")).alias("object")))
    # A frame is parsed once; the steps after it each take from the one before, so that nothing is evaluated twice.
    parsed = F.transform(told, lambda x: F.struct(x["good"].alias("good"), x["object"].alias("object"), F.contains(x["json"], F.lit("content_block_delta")).alias("said"), F.when(x["object"], F.from_json(x["json"], _EVENT)).alias("e")))

    def read(x: Column) -> Column:
        e = x["e"]
        usages = F.filter(F.array(*[_field(e, f"{root}usage") for root in ROOTS]), lambda u: u.isNotNull())
        reasons = F.filter(F.array(*[_field(e, p) for p in REASONS]), lambda r: r != "")
        return F.struct(
            x["good"].alias("good"), x["object"].alias("object"), F.get(reasons, F.lit(0)).alias("reason"), F.when(x["said"], e["delta"]).alias("delta"), e["index"].alias("index"),
            F.transform(usages, lambda u: F.struct(*[c.alias(name) for name, c in _counts(lambda p: _field(u, p)).items()])).alias("counts"),
        )

    def said(x: Column) -> Column:
        at = lambda name: F.coalesce(*[F.get(x["counts"], F.lit(i))[name] for i in range(len(ROOTS))])
        u = F.when(F.size(x["counts"]) > 0, _usage(at))
        d = x["delta"]
        name = F.when(d["type"] == "text_delta", "text").when(d["type"] == "thinking_delta", "thinking").when(d["type"] == "input_json_delta", "partial_json")
        text = F.when(d["type"] == "text_delta", d["text"]).when(d["type"] == "thinking_delta", d["thinking"]).when(d["type"] == "input_json_delta", d["partial_json"])
        return F.struct((~x["good"]).alias("bad"), x["object"].alias("object"), u.alias("u"), _stop_reason(x["reason"]).alias("stop"), name.alias("kind"), x["index"].alias("index"), text.alias("text"))

    rows = exchanges.withColumns({"_said": F.transform(F.transform(parsed, read), said), "_open": open_end, "_supported": supported})

    rows = rows.withColumn("_counted", F.transform(F.filter("_said", lambda x: x["u"].isNotNull()), lambda x: x["u"]))
    of = lambda name: F.filter(F.transform("_counted", lambda u: u[name]), lambda v: v.isNotNull())
    first = lambda name: F.coalesce(F.get(F.filter(of(name), lambda v: v > 0), F.lit(0)), F.array_max(of(name)))
    usage = F.struct(first("input_tokens").alias("input_tokens"), F.array_max(of("output_tokens")).alias("output_tokens"), first("cache_write").alias("cache_write"), first("cache_read").alias("cache_read"), first("cache_write_1h").alias("cache_write_1h"))
    # The last frame that is bad or has counts says whether the counts are to be relied on.
    telling = F.filter("_said", lambda x: x["bad"] | x["u"]["input_tokens"].isNotNull() | x["u"]["output_tokens"].isNotNull())
    broken = F.col("_open") | F.coalesce(F.get(telling, F.size(telling) - 1)["bad"], F.lit(False))
    n_bad, n_good = F.size(F.filter("_said", lambda x: x["bad"])), F.size(F.filter("_said", lambda x: x["object"]))

    deltas = F.transform(F.filter("_said", lambda x: F.coalesce(F.length(x["text"]) > 0, F.lit(False))), lambda x: F.struct(x["kind"].alias("kind"), x["index"].alias("index"), x["text"].alias("text")))
    rows = rows.withColumn("_deltas", deltas)

    def bounded(before: Column) -> Column:
        return F.zip_with("_deltas", before, lambda d, at: F.struct(d["kind"].alias("kind"), d["index"].alias("index"), F.substring(d["text"], F.lit(1), F.greatest(F.lit(most) - at, F.lit(0))).alias("text")))

    total = F.aggregate("_deltas", F.lit(0), lambda n, d: n + F.length(d["text"]))
    rows = rows.withColumn("_total", total)
    cut = F.filter(let(running_sums(F.transform("_deltas", lambda d: F.length(d["text"]))), bounded), lambda d: d["text"] != "")
    # Running sums are only needed where something is cut.
    rows = rows.withColumns({"_kept": F.when(F.col("_total") > most, cut).otherwise(F.col("_deltas")), "_capped": F.col("_total") >= most})
    places = F.array_distinct(F.transform("_kept", lambda d: F.struct(d["kind"].alias("kind"), d["index"].alias("index"))))
    joined = lambda p: F.array_join(F.transform(F.filter("_kept", lambda d: (d["kind"] == p["kind"]) & d["index"].eqNullSafe(p["index"])), lambda d: d["text"]), "")
    blocks = F.transform(places, lambda p: F.struct(p["kind"].alias("kind"), p["index"].alias("index"), joined(p).alias("text")))
    unframed = F.col("_open") | (n_bad > 0)
    response_status = F.when(~F.col("_supported"), "unavailable").when(unframed, F.when(n_good > 0, "partial").otherwise("unavailable")).when(F.col("_capped"), "partial").otherwise("known")
    rows = rows.withColumns({"usage": usage, "response_status": response_status, "n_bad": n_bad, "blocks": blocks, "_broken": broken, "stop_reason": F.get(F.filter(F.transform("_said", lambda x: x["stop"]), lambda s: s.isNotNull()), F.lit(0))})
    both, any_ = F.col("usage.input_tokens").isNotNull() & F.col("usage.output_tokens").isNotNull(), F.col("usage.input_tokens").isNotNull() | F.col("usage.output_tokens").isNotNull()
    usage_status = F.when(~any_, "unavailable").when(~both | F.col("_broken"), "partial").otherwise("known")
    return rows.withColumn("usage_status", usage_status).drop("_frames", "_open", "_supported", "_said", "_counted", "_deltas", "_kept", "_total", "_capped", "_broken")


def spend_basis(usage: DataFrame, keys: list[str]) -> DataFrame:
    """By key: dollars of priced exchanges, whose account they went to, and the models without a price.

    ``usage``: ``model, cost`` (null if unpriced) and ``auth_route``. The basis is that of all priced
    exchanges if they have one (api-key or subscription), mixed for several, unknown where one
    says nothing or none is priced.
    """
    routes = F.collect_set(F.when(F.col("cost").isNotNull(), F.coalesce("auth_route", F.lit(""))))
    basis = F.when((F.size("_routes") == 1) & F.get("_routes", F.lit(0)).isin("api-key", "subscription"), F.get("_routes", F.lit(0))).when((F.size("_routes") == 0) | F.array_contains("_routes", ""), "unknown").otherwise("mixed")
    unpriced = F.array_sort(F.collect_set(F.when(F.col("cost").isNull() & (F.col("model") != ""), F.col("model"))))
    grouped = usage.groupBy(*keys).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("cost").alias("n_priced"), unpriced.alias("unpriced"), routes.alias("_routes"))
    return grouped.withColumn("basis", basis).drop("_routes")
