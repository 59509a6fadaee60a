"""Queries of records, issued numbers, results and usage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import policy, records, requests, spans, traffic, transcripts
from textwarden.plans.registry import query
from textwarden.plans.traffic import REQUESTS_SQL, _requests
from textwarden.sources.tables import read_table


@query(f"""
select model_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cache_write)::bigint as cache_write, sum(cache_read)::bigint as cache_read,
  round(sum(cache_read) / sum(input_tokens + cache_write + cache_read), 6) as read_share
from ({REQUESTS_SQL}) group by model_id
""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.usage_totals(_requests(spark, sf_dir), ["model_id"])


@query("""
with r as (select (l_orderkey % 100)::varchar as session_id, (l_partkey % 50)::varchar as tool_use_id, l_quantity::bigint as bytes from lineitem),
m as (select session_id, tool_use_id, max(bytes) as most from r group by all)
select r.session_id, r.tool_use_id, any_value(most) as bytes, count(*) filter (where r.bytes = most)::bigint as carried from r join m on r.session_id = m.session_id and r.tool_use_id = m.tool_use_id group by all
""")
def tool_result_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).cast("string").alias("session_id"), (F.col("l_partkey") % 50).cast("string").alias("tool_use_id"), F.col("l_quantity").cast("bigint").alias("bytes"))
    return traffic.tool_result_carry(results)


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    written = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 97).cast("string").alias("session_id"), F.col("o_orderstatus").alias("entity"), (F.col("o_orderkey") % 60).alias("number"))
    first = F.col("l_partkey") % 50
    issued = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).cast("string").alias("session_id"), F.col("l_linestatus").alias("entity"), first.alias("first"), (first + F.col("l_suppkey") % 3).alias("last"))
    return written, issued.distinct()


WRITTEN_SQL = "select o_orderkey, (o_custkey % 97)::varchar as session_id, o_orderstatus as entity, o_orderkey % 60 as number from orders"
ISSUED_SQL = 'select distinct (l_orderkey % 97)::varchar as session_id, l_linestatus as entity, l_partkey % 50 as "first", l_partkey % 50 + l_suppkey % 3 as "last" from lineitem'


@query(f"""
select * from ({WRITTEN_SQL}) w where exists (select 1 from ({ISSUED_SQL}) i where i.session_id = w.session_id and i.entity = w.entity and w.number between i."first" and i."last")
""")
def write_back_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.write_back_check(*_written(spark, sf_dir))


@query(f"""
with i as ({ISSUED_SQL}), n as (select session_id, entity, number as "first", number + 1 as "last" from ({WRITTEN_SQL}))
select * from n where not exists (select 1 from i where i.session_id = n.session_id and i.entity = n.entity and i."first" <= n."first" and n."last" <= i."last")
""")
def issue_new_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, issued = _written(spark, sf_dir)
    return policy.issue_new_runs(written.select("session_id", "entity", F.col("number").alias("first"), (F.col("number") + 1).alias("last")), issued)


TYPED_SQL = """select l_orderkey as k, case l_returnflag when 'A' then 'EMAIL' when 'N' then 'PHONE' else 'SECRET' end as entity, l_partkey % 200 as s, (l_partkey % 200 + l_quantity)::bigint as e, l_discount as score, l_linestatus as label,
  case l_returnflag when 'A' then 4 when 'N' then 8 else 0 end as priority from lineitem"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 200
    entity = F.when(F.col("l_returnflag") == "A", "EMAIL").when(F.col("l_returnflag") == "N", "PHONE").otherwise("SECRET")
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), entity.alias("entity"), start.alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"), F.col("l_discount").alias("score"), F.col("l_linestatus").alias("label"))


@query(f"""
with t as (select *, row_number() over (partition by k, entity, s, e order by score desc, label) as nth from ({TYPED_SQL}))
select k, entity, s as "start", e as "end", score, label from t where nth = 1
""")
def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedupe_spans(_typed(spark, sf_dir), ["k"])


@query(f"""
with t as (select distinct k, entity, s, e, score, label, priority from ({TYPED_SQL})),
m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from t),
i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by k order by s, e rows unbounded preceding) as island from m),
w as (select *, row_number() over (partition by k, island order by priority, s - e, entity, s, e, -score, label) as place, min(s) over (partition by k, island) as lo, max(e) over (partition by k, island) as hi from i)
select k, entity, lo as "start", hi as "end", score, label, s as value_start, e as value_end from w where place = 1
""")
def merge_typed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge_spans(_typed(spark, sf_dir).distinct(), ["k"])


@query("""
with t as (select l_orderkey as k, l_linestatus as side, l_partkey % 200 as s, (l_partkey % 200 + l_quantity)::bigint as e from lineitem)
select distinct k, s as "start", e as "end" from t a where side = 'F' and not exists (select 1 from t b where b.side = 'O' and a.k = b.k and b.s <= a.s and a.e <= b.e)
""")
def spans_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one kind that lie in none of another, as card numbers in account numbers."""
    typed = _typed(spark, sf_dir).select("k", "start", "end", "label")
    return spans.outside(typed.where("label = 'F'").select("k", "start", "end").distinct(), typed.where("label = 'O'"), ["k"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decision records."""
    e = read_table(spark, sf_dir, "events")
    n = F.floor("value").cast("int")
    action = F.when(F.col("event_type") == "purchase", "mask").when(F.col("event_type") == "click", "allow").when(F.col("event_type") == "view", "report").otherwise("odd")
    return e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("session_id"), "ts", F.col("event_id").alias("file_pos"), action.alias("action"), F.col("event_type").alias("tool_name"),
        F.concat(F.lit("/a/b"), (F.col("event_id") % 5).cast("string"), F.lit(".txt")).alias("target"), F.when(F.col("event_id") % 6 == 0, "prompt").otherwise("inbound").alias("direction"),
        F.when(n % 2 == 0, F.create_map("event_type", n)).otherwise(F.expr("cast(map() as map<string,int>)")).alias("entities"),
        F.when(F.col("event_id") % 11 == 0, "not inspected: late").when(F.col("event_id") % 13 == 0, "partial").alias("note"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.lit("json"))).otherwise(F.expr("cast(array() as array<string>)")).alias("transforms"), (n + 10).alias("in_bytes"), (n % 7).alias("out_bytes"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.lit("hidden_text"), F.lit("hidden_text"))).otherwise(F.expr("cast(array() as array<string>)")).alias("markers"),
    )


RECORDS_SQL = """
select 's' || (user_id % 40)::varchar as session_id, ts, event_id as file_pos, case event_type when 'purchase' then 'mask' when 'click' then 'allow' when 'view' then 'report' else 'odd' end as action, event_type as tool_name,
  'b' || (event_id % 5)::varchar || '.txt' as base, case when event_id % 6 = 0 then 'prompt' else 'inbound' end as direction, floor(value)::int % 2 = 0 as has_entities,
  case when event_id % 11 = 0 then 'not inspected: late' when event_id % 13 = 0 then 'partial' end as note, event_id % 3 = 0 as changed, floor(value)::int + 10 as in_bytes, floor(value)::int % 7 as out_bytes, event_id % 4 = 0 as marked
from events
"""


@query(f"""
select session_id, action, case when direction = 'prompt' then 'your prompt' else tool_name || ' ' || base end as place, count(*)::bigint as n from ({RECORDS_SQL}) group by all
""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.source_counts(_records(spark, sf_dir))


@query(f"select session_id, 'hidden_text' as marker, count(*)::bigint as n from ({RECORDS_SQL}) where marked group by session_id")
def marker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.marker_totals(_records(spark, sf_dir))


@query(f"""
select session_id, sum(case when changed then greatest(in_bytes - out_bytes, 0) else 0 end)::bigint as bytes_saved, (sum(case when changed then greatest(in_bytes - out_bytes, 0) else 0 end)::bigint // 4)::bigint as tokens_saved from ({RECORDS_SQL}) group by session_id
""")
def bytes_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.bytes_saved(_records(spark, sf_dir), ["session_id"])


@query(f"""
select session_id, count(*) filter (where note like 'not inspected%' or (action = 'odd' and has_entities))::bigint as n_uninspected, count(*) filter (where note = 'partial')::bigint as n_partial from ({RECORDS_SQL}) group by session_id
""")
def uninspected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.uninspected_counts(_records(spark, sf_dir))


@query(f"""
with o as (select *, row_number() over (partition by session_id order by ts, file_pos) as ordinal from ({RECORDS_SQL})),
h as (select *, 'sent-unmasked' as rule from o where action = 'allow' and has_entities union all select *, 'not-inspected' from o where note like 'not inspected%' union all select *, 'injection-markers' from o where marked)
select session_id, rule, min(ts) as first_seen, max(ts) as last_seen, count(*)::bigint as occurrences, list_slice(list(ordinal::int order by ordinal), 1, 20) as evidence from h group by session_id, rule
""")
def session_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.session_findings(_records(spark, sf_dir)).drop("finding_id")


@query(f"""
with s as (select distinct session_id from ({RECORDS_SQL})),
m as (select substr(sha256(session_id), 1, 32) as session_key, file_pos % 2 as side, count(*) as n from ({RECORDS_SQL}) where action = 'mask' group by all)
select s.session_id, greatest(coalesce((select n from m where m.session_key = substr(sha256(s.session_id), 1, 32) and side = 0), 0), coalesce((select n from m where m.session_key = substr(sha256(s.session_id), 1, 32) and side = 1), 0))::bigint as masked from s
""")
def masked_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("session_id", records.session_key(F.col("session_id")).alias("session_key"), "action", F.lit(1).alias("n"), "file_pos")
    out = transcripts.masked_per_session(rows.select("session_id").distinct(), rows.where("file_pos % 2 = 0"), rows.where("file_pos % 2 = 1"))
    return out.select("session_id", "masked")


@query(f"select max_by(session_id, (ts, session_id)) as session_id from ({RECORDS_SQL})")
def newest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest_session(_records(spark, sf_dir))


@query("""
with i as (select p_partkey, (p_partkey * 37) % 4000 as w, (p_partkey * 91) % 3000 as h from part),
s as (select *, least(1.0::double, 1568 / greatest(w, h)::double) as scale from i where w > 0 and h > 0)
select p_partkey, least(greatest(ceil(floor(w * scale) / 28), 1) * greatest(ceil(floor(h * scale) / 28), 1), 1568)::bigint as tokens from s
""")
def image_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read_table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 37) % 4000).alias("w"), ((F.col("p_partkey") * 91) % 3000).alias("h"))
    return sizes.select("p_partkey", traffic.image_tokens(F.col("w"), F.col("h")).cast("bigint").alias("tokens")).where("tokens is not null")


@query(f"""
with r as (select conversation % 30 as session_id, event_id as seq, case when event_id % 5 = 0 then null else input_tokens + 3 * output_tokens end as cost, request_bytes from ({REQUESTS_SQL})),
c as (select session_id, count(cost) as n_priced, max_by(seq, (cost, -seq)) filter (where cost is not null) as costliest, max(cost) as cost, max_by(seq, (request_bytes, -seq)) as largest_seq, max(request_bytes) as request_bytes from r group by session_id)
select session_id, case when n_priced > 1 then costliest end as costliest_seq, case when n_priced > 1 then cost end as cost, largest_seq, request_bytes from c
""")
def costliest_and_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.when(F.col("event_id") % 5 != 0, F.col("input_tokens") + 3 * F.col("output_tokens"))
    priced = _requests(spark, sf_dir).select((F.col("conversation") % 30).alias("session_id"), F.col("event_id").alias("seq"), cost.alias("cost"), "request_bytes")
    return requests.costliest_and_largest(priced, ["session_id"])


@query(r"""
select conv_id, turn, case when len(t) > 120 then '…' || right(right(t, 512), 120) else t end as target
from (select conv_id, turn, regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g') as t from conversations)
""")
def scrubbed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textwarden.operators.labels import scrub_target

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\p{Cntrl}]", " ").alias("target"))
    return scrub_target(turns)


@query("""
with t as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as before from conversations)
select conv_id, turn, coalesce((select max_by(u.role, u.turn) from conversations u where u.conv_id = t.conv_id and u.turn < t.turn and u.role = 'user'), 'unknown tool') as tool from t where role = 'assistant'
""")
def named_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the latest earlier call of their conversation: the as-of join of tool results."""
    turns = read_table(spark, sf_dir, "conversations")
    block = F.when(F.col("role") == "user", F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("id"), F.col("role").alias("name"), F.lit(None).cast("string").alias("tool_use_id"))).otherwise(F.struct(F.lit("tool_result").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("x").alias("tool_use_id")))
    blocks = turns.where("role in ('user', 'assistant')").select(F.col("conv_id").alias("file"), F.col("turn").alias("line_no"), F.lit(0).alias("block_no"), block.alias("b"))
    return transcripts.name_tool_results(blocks).select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "tool")
