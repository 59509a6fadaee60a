"""Queries of sessions: summaries by turn, and writes against numbers issued before, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import policy, records
from textwarden.plans.registry import query
from textwarden.sources import logs
from textwarden.sources.tables import read_table, scratch_path

#: Events of sessions in order, with the life of the session that each belongs to.
LIVES_SQL = """
  o as (select *, row_number() over w as pos, lag(ts) over w as before, lag(kind) over w as kind_before, lead(ts) over w as after from e window w as (partition by session_id order by ts, seq)),
  l as (select *, sum(case when before is null or kind_before = 'session_end' or ts > before + interval {pause} then 1 else 0 end) over (partition by session_id order by pos) as life,
    kind <> 'session_end' and (after is null or after > ts + interval {pause}) as is_over from o)
"""


@query(rf"""
with e as (
  select 's' || (user_id % 40)::varchar as session_id, ts, event_id as seq, case when event_id % 10 = 0 then 'turn_end' when event_id % 37 = 0 then 'session_end' else 'record' end as kind,
    case event_type when 'purchase' then 'masked' when 'click' then 'unmasked' else 'warned' end as done, event_type as entity, floor(value)::bigint as n from events
), {LIVES_SQL.format(pause="'30 minutes'")},
  c as (select *, sum(case when kind = 'record' then 1 else 0 end) over (partition by session_id, life order by pos) as n_records from l),
  m as (
    select session_id, life, pos, n_records, ts as at, 'turn' as reason, 0 as rank from c where kind = 'turn_end'
    union all select session_id, life, pos, n_records, ts + interval '30 minutes', 'idle', 1 from c where is_over),
  s as (select *, n_records - coalesce(lag(n_records) over (partition by session_id, life order by pos, rank), 0) as n_new from m),
  t as (
    select s.session_id, s.life, s.pos, s.reason, r.done, r.entity, sum(r.n) as n from s join l r on r.session_id = s.session_id and r.life = s.life and r.pos <= s.pos where r.kind = 'record' and r.n % 2 = 0 group by all)
select s.session_id, s.at, s.reason, s.n_records::bigint as n_records, s.n_new::bigint as n_new,
  coalesce((select string_agg(t.done || ':' || t.entity || ':' || t.n::bigint, ',' order by t.done, t.entity) from t where t.session_id = s.session_id and t.life = s.life and t.pos = s.pos and t.reason = s.reason), '') as totals
from s where n_new > 0
""")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the stream of summaries."""
    e, n = read_table(spark, sf_dir, "events"), F.floor("value").cast("int")
    kind = F.when(F.col("event_id") % 10 == 0, records.TURN_END).when(F.col("event_id") % 37 == 0, records.SESSION_END).otherwise(records.RECORD)
    done = F.when(F.col("event_type") == "purchase", "masked").when(F.col("event_type") == "click", "unmasked").otherwise("warned")
    entities = F.when(n % 2 == 0, F.create_map("event_type", n)).otherwise(F.expr("cast(map() as map<string,int>)"))
    events = e.select(F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("session_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), done.alias("done"), entities.alias("entities"))
    said = F.array_join(F.transform("totals", lambda t: F.concat_ws(":", t["done"], t["entity"], t["n"].cast("string"))), ",")
    return records.session_summaries(events, 30).withColumn("totals", said)


@query(rf"""
with e as (
  select (l_orderkey % 97)::varchar as session_id, l_shipdate as ts, l_orderkey * 10 + l_linenumber as seq, 'issue' as kind, l_linestatus as entity, (l_partkey % 50) * 20 as "first",
    case when l_orderkey % 211 = 0 then null else (l_partkey % 50) * 20 + l_suppkey % 3 * 70 end as "last" from lineitem
  union all select (o_custkey % 97)::varchar, o_orderdate, -o_orderkey, case when o_orderkey % 90 = 0 then 'session_end' else 'write' end, o_orderstatus, o_orderkey % 1300, null from orders
), {LIVES_SQL.format(pause="'43200 minutes'")},
  w as (select * from l where kind = 'write'),
  d as (select session_id, life, min(pos) as damaged from l where kind = 'issue' and "last" is null group by all)
select w.session_id, w.seq, w.ts as at, w.entity, w."first" as number,
  case when d.damaged < w.pos then 'unchecked'
    when exists (select 1 from l i where i.kind = 'issue' and i.session_id = w.session_id and i.life = w.life and i.entity = w.entity and i.pos < w.pos and w."first" between i."first" and i."last") then 'refused' else 'free' end as verdict
from w left join d on w.session_id = d.session_id and w.life = d.life
""")
def refused_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the stream that checks writes against numbers issued before."""
    first = (F.col("l_partkey") % 50) * 20
    issues = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 97).cast("string").alias("session_id"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("issue").alias("kind"),
        F.col("l_linestatus").alias("entity"), first.alias("first"), F.when(F.col("l_orderkey") % 211 != 0, first + F.col("l_suppkey") % 3 * 70).alias("last"),
    )
    writes = read_table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 97).cast("string").alias("session_id"), F.col("o_orderdate").alias("ts"), (-F.col("o_orderkey")).alias("seq"), F.when(F.col("o_orderkey") % 90 == 0, records.SESSION_END).otherwise("write").alias("kind"),
        F.col("o_orderstatus").alias("entity"), (F.col("o_orderkey") % 1300).alias("first"), F.lit(None).cast("long").alias("last"),
    )
    return policy.refusals(issues.unionByName(writes), 30 * 24 * 60)


@query("""
select (conv_id % 7)::varchar as project, (row_number() over (partition by conv_id % 7 order by conv_id, turn) - 1)::bigint as line_no, conv_id, turn from conversations
""")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as lines of one file a project and read again with their numbers, whatever splits they are read in."""
    path = scratch_path(spark, "transcripts")
    turns = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("project"), "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("line"))
    # A project's lines in order are one file.
    turns.repartition("project").sortWithinPartitions("project", "conv_id", "turn").select("project", "line").write.partitionBy("project").text(path)
    lines = logs.read_transcripts(spark, path, pattern="*.txt")
    said = F.from_json("raw", "conv_id long, turn long")
    return lines.select(F.regexp_extract("file", r"project=([0-9]+)/", 1).alias("project"), "line_no", said["conv_id"].alias("conv_id"), said["turn"].alias("turn"))
