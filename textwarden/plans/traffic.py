"""Queries of spans, traffic, records and policy over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import policy, records, spans, traffic, transcripts
from textwarden.plans.registry import query
from textwarden.sources.tables import read_table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of their order."""
    start = F.col("l_partkey") % 1000
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"), F.lit("CUSTOM").alias("entity"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("label"))


SPANS_SQL = "select l_orderkey as k, l_partkey % 1000 as s, (l_partkey % 1000 + l_quantity)::bigint as e from lineitem"


@query(f"""
with s as ({SPANS_SQL}),
m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from s),
i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as island from m)
select k, min(s)::bigint as "start", max(e)::bigint as "end", count(*)::bigint as n from i group by k, island
""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.islands(_lines(spark, sf_dir), ["k"]).groupBy("k", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


@query(f"""
with s as (select distinct k, s, e from ({SPANS_SQL}))
select k, s::bigint as "start", e as "end" from s a
where not exists (select 1 from s b where a.k = b.k and b.s <= a.s and a.e <= b.e and (b.s, b.e) <> (a.s, a.e))
""")
def contained_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.not_contained(_lines(spark, sf_dir).select("k", "start", "end").distinct(), ["k"])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model requests: a user is a conversation, the type a model, the value gives sizes and reads."""
    cents = F.floor(F.col("value") * 100).cast("long")
    return read_table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("conversation"), F.col("event_type").alias("model_id"),
        F.pmod(cents, F.lit(997)).alias("request_bytes"), F.pmod(cents, F.lit(89)).alias("input_tokens"), F.pmod(cents, F.lit(53)).alias("output_tokens"),
        (F.pmod(cents, F.lit(7)) * 10).alias("cache_write"), F.when(cents % 3 == 0, 0).otherwise(F.pmod(cents, F.lit(131))).cast("long").alias("cache_read"), F.pmod(cents, F.lit(7)).alias("cache_write_1h"),
    )


REQUESTS_SQL = """
select event_id, ts, user_id as conversation, event_type as model_id, c % 997 as request_bytes, c % 89 as input_tokens, c % 53 as output_tokens,
  (c % 7) * 10 as cache_write, case when c % 3 = 0 then 0 else c % 131 end as cache_read, c % 7 as cache_write_1h
from (select *, floor(value * 100)::bigint as c from events)
"""


@query(f"""
with r as ({REQUESTS_SQL}),
a as (select *, lag(request_bytes) over w as before from r window w as (partition by model_id, conversation order by ts, event_id)),
c as (select *, sum(case when request_bytes < before then 1 else 0 end) over (partition by model_id, conversation order by ts, event_id rows unbounded preceding) as chain from a),
t as (select *, coalesce(max((cache_read > 0)::int) over (partition by model_id, conversation, chain order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as warm,
  lag(input_tokens + cache_write + cache_read) over (partition by model_id, conversation, chain order by ts, event_id) as total from c)
select model_id, conversation, count(*)::bigint as n_requests, count(*) filter (where warm = 1 and cache_read * 10 < total * 9 and cache_write > 0)::bigint as n_rewrites from t group by all
""")
def cache_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = traffic.cache_rewrites(_requests(spark, sf_dir), ["model_id", "conversation"], ["ts", "event_id"])
    return marked.groupBy("model_id", "conversation").agg(F.count("*").alias("n_requests"), F.count_if("rewrite").alias("n_rewrites"))


@query(f"""
with r as ({REQUESTS_SQL}),
a as (select *, lag(request_bytes) over (partition by conversation order by ts, event_id) as before from r),
s as (select *, max(case when request_bytes < before then 1 else 0 end) over (partition by conversation order by ts, event_id rows unbounded preceding) as shrunk from a),
k as (select *, row_number() over w as no, max((cache_read > 0)::int) over (partition by conversation order by ts, event_id rows unbounded preceding) as warm,
  lag(cache_read) over w as last_read, lag(input_tokens + cache_write + cache_read) over w as last_total
  from s where shrunk = 0 window w as (partition by conversation order by ts, event_id))
select conversation, count(*)::bigint as n_requests, count(*) filter (where warm = 0)::bigint as n_cold,
  coalesce(max((cache_read < last_read)::int), 0) = 0 as reads_grow,
  coalesce(max((cache_read > 0 and cache_read * 10 < last_total * 9)::int), 0) = 0 as reads_follow,
  coalesce(sum(cache_write) filter (where no > 1), 0)::bigint as created_after_first,
  (list(cache_write order by cache_write) filter (where no > 1))[(count(*) filter (where no > 1)) // 2 + 1]::bigint as median_created
from k group by conversation
""")
def prefix_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.prefix_study(_requests(spark, sf_dir), ["conversation"], ["ts", "event_id"])


@query("""
with e as (select event_id, user_id, event_type, ts as started, ts + to_seconds((floor(value)::int) * 60) as ended from events)
select event_type, count(*)::bigint as n, count(*) filter (where exists (
  select 1 from e b where b.user_id = a.user_id and b.event_type = a.event_type and (b.started, b.event_id) < (a.started, a.event_id) and a.started < b.ended))::bigint as n_duplicates
from e a group by event_type
""")
def duplicates_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("started"), (F.col("ts") + F.make_interval(mins=F.floor("value").cast("int"))).alias("ended"))
    marked = traffic.duplicates_in_flight(events, ["user_id", "event_type"], ["event_id"])
    return marked.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("duplicate").alias("n_duplicates"))


@query("""
with l as (select l_orderkey as k, l_linenumber::varchar as name, floor(l_extendedprice)::bigint as bytes, floor(o_totalprice)::bigint as total from lineitem join orders on l_orderkey = o_orderkey),
s as (select *, case when sum(bytes) over (partition by k) > 0 then (total * bytes // sum(bytes) over (partition by k))::bigint else 0 end as share, row_number() over (partition by k order by bytes desc, name) as place from l)
select k, name, (share + case when place = 1 then total - sum(share) over (partition by k) else 0 end)::bigint as tokens from s
""")
def attribute_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sections = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("name"), F.floor("l_extendedprice").alias("bytes"), F.floor("o_totalprice").alias("total"))
    return traffic.attribute_tokens(sections, ["k"], "total").select("k", "name", "tokens")


PRICES = "(values ('click', 0, 3.0, 3.75, 6.0, 0.3, 15.0), ('click', 150, 6.0, 7.5, 12.0, 0.6, 22.5), ('view', 0, 1.0, 1.25, 2.0, 0.1, 5.0)) as t(model_id, min_prompt, input, write, write_1h, read, output)"


@query(f"""
with r as ({REQUESTS_SQL}), p as (select model_id as priced, min_prompt, input, write, write_1h, read, output from {PRICES}),
j as (select r.*, p.*, row_number() over (partition by r.event_id order by p.min_prompt desc nulls last) as nth
  from r left join p on r.model_id = p.priced and r.input_tokens + r.cache_write + r.cache_read >= p.min_prompt)
select model_id, count(*)::bigint as n, count(min_prompt)::bigint as n_priced,
  round(sum((input_tokens * input + (cache_write - cache_write_1h) * write + cache_write_1h * write_1h + cache_read * read + output_tokens * output) / 1e6)::double, 6) as cost
from j where nth = 1 group by model_id
""")
def spend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.sql(f"select model_id, min_prompt, cast(input as double) input, cast(write as double) write, cast(write_1h as double) write_1h, cast(read as double) read, cast(output as double) output from {PRICES}")
    priced = traffic.price_join(_requests(spark, sf_dir), prices)
    return priced.groupBy("model_id").agg(F.count("*").alias("n"), F.count("cost").alias("n_priced"), F.round(F.sum("cost"), 6).alias("cost"))


@query("""
with e as (select user_id % 50 as session_id, case when event_type in ('purchase') then 'masked' when event_type = 'click' then 'unmasked' when event_type = 'view' then 'warned' else 'blocked' end as done, event_type = 'view' as model_output, event_type as entity, floor(value)::int as n from events)
select session_id::varchar as session_id, done, model_output, entity, sum(n)::bigint as n from e group by all
""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "mask").when(F.col("event_type") == "click", "allow").when(F.col("event_type") == "view", "report").otherwise("deny")
    rows = events.select((F.col("user_id") % 50).cast("string").alias("session_id"), action.alias("action"), F.when(F.col("event_type") == "view", "model_output").otherwise("inbound").alias("direction"), F.create_map("event_type", F.floor("value").cast("int")).alias("entities"))
    return records.session_summary(rows)


@query("""
with r as (select user_id, value, row_number() over (partition by user_id order by value) as no, count(*) over (partition by user_id) as n from events where value >= 0)
select user_id, any_value(n)::bigint as n, median(value) as median, max(value) filter (where no = round_even(0.95 * (n - 1), 0)::int + 1) as p95 from r group by user_id
""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.latency_stats(read_table(spark, sf_dir, "events"), ["user_id"], "value")


@query("""
with v as (select value, row_number() over (order by value) - 1 as r, count(*) over () as n from events where value >= 0)
select 'all' as fleet, any_value(n)::bigint as n, max(value) filter (r = (n - 1) // 2) * 0.5 + max(value) filter (r = n // 2) * 0.5 as median, max(value) filter (r = round_even(0.95 * (n - 1), 0)) as p95 from v
""")
def fleet_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over all events as one key, by narrowing histograms."""
    rows = read_table(spark, sf_dir, "events").withColumn("fleet", F.lit("all"))
    return records.latency_stats(rows, ["fleet"], "value", most_sorted=1000)


@query("select date_trunc('day', ts)::date as day, count(*)::bigint as n_events from events group by 1")
def ledger_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ledger_by_day(read_table(spark, sf_dir, "events"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from g)
select user_id, min(ts) as "start", max(ts) + interval 30 minute as "end", count(*)::bigint as n_events from s group by user_id, no
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.session_windows(read_table(spark, sf_dir, "events"), ["user_id"], "ts")


@query("""
with r as (select l_orderkey as k, l_linenumber as line, l_extendedprice as price, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as place from lineitem)
select k, line, price from r where place = 1
""")
def largest_and_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct(F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price")), F.struct("l_extendedprice", -F.col("l_linenumber")))
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(best.alias("b")).select("k", "b.line", "b.price")


@query("""
with e as (select event_type as tool_name, case when event_id % 4 = 0 then 'prompt' when event_id % 4 = 1 then 'result' else 'call' end as event from events),
d as (select *, case when event = 'prompt' then 'prompt' when event = 'result' then 'inbound' when tool_name = 'click' then 'local' when tool_name = 'view' then 'executable' else 'outbound' end as direction from e),
m as (select *, case direction when 'prompt' then 'enforce' when 'inbound' then 'warn' when 'local' then 'observe' when 'executable' then 'warn' else 'enforce' end as mode from d)
select direction, mode, case when mode = 'observe' then 'allow' when mode = 'warn' then 'report' when direction in ('prompt', 'executable') then 'deny' else 'mask' end as action, count(*)::bigint as n from m group by all
""")
def direction_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.when(F.col("event_id") % 4 == 0, "prompt").when(F.col("event_id") % 4 == 1, "result").otherwise("call")
    events = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("tool_name"), event.alias("event"))
    tools = spark.createDataFrame([("click", "local"), ("view", "executable")], "tool string, direction string")
    placed = policy.direction_of(events, tools).withColumn("mode", policy.mode_of(F.col("direction"), F.col("tool_name"), F.col("event"), {"result": "warn"}))
    return placed.withColumn("action", policy.action_of(F.col("direction"), F.col("mode"), F.lit(True))).groupBy("direction", "mode", "action").agg(F.count("*").alias("n"))


@query("""
with w as (select role, unnest(string_split(lower(text), ' ')) as entity from conversations),
a as (select entity, count(*) as n from w where role = 'user' and entity <> '' group by entity), b as (select entity, count(*) as n from w where role = 'assistant' and entity <> '' group by entity)
select coalesce(a.entity, b.entity) as entity, coalesce(a.n, 0)::bigint as in_requests, coalesce(b.n, 0)::bigint as in_responses from a full join b on a.entity = b.entity
""")
def compare_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "conversations").select("role", F.explode(F.split(F.lower("text"), " ")).alias("entity")).where("entity != ''")
    counts = words.groupBy("role", "entity").agg(F.count("*").alias("n"))
    return traffic.compare_directions(counts.where("role = 'user'"), counts.where("role = 'assistant'"))


@query("""
select case role when 'user' then 'reached' when 'assistant' then 'output' else 'system' end as kind, role as door, count(*)::bigint as n, sum(strlen(text))::bigint as bytes from conversations group by all
""")
def conversation_doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "reached").when(F.col("role") == "assistant", "output").otherwise("system")
    return read_table(spark, sf_dir, "conversations").groupBy(kind.alias("kind"), F.col("role").alias("door")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("select conv_id::varchar as session_id, turn from conversations where conv_id not in (select doc_id from documents where source = 'src3')")
def forget_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn")
    purge = read_table(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").cast("string").alias("session_id"))
    return transcripts.forget_sessions(history, purge)


@query("""
with c as (select l.doc_id as case_id, case when quality = 1 then 'good' else 'bad' end as category from labels l),
p as (select doc_id as case_id, case when n_chars >= 400 then 'good' else 'bad' end as category from documents where doc_id in (select doc_id from labels)),
b as (select coalesce(c.category, p.category) as category, c.case_id as a, p.case_id as b from c full join p on c.case_id = p.case_id and c.category = p.category),
s as (select category, count(*) filter (where a is not null and b is not null)::bigint as tp, count(*) filter (where a is null)::bigint as fp, count(*) filter (where b is null)::bigint as fn from b group by rollup (category))
select category, tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp), 6) end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) end as recall from s
""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    cases = labels.select(F.col("doc_id").alias("case_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("category"))
    documents = read_table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    predicted = documents.select(F.col("doc_id").alias("case_id"), F.when(F.col("n_chars") >= 400, "good").otherwise("bad").alias("category"))
    return records.scorecard(cases, predicted)
