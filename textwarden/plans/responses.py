"""Queries of streamed responses that are whole, broken or too long, and of what spend rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import traffic
from textwarden.plans.registry import query
from textwarden.sources.tables import over_cores, read_table


@query("""
with o as (select o_orderkey, o_orderkey % 6 as kind, o_orderkey % 500 + 1 as i, o_custkey % 300 + 2 as o from orders)
select o_orderkey, case when kind <> 5 then i end as input_tokens, case when kind = 5 then null when kind = 3 then 1 else o end::bigint as output_tokens,
  case when kind = 5 then 'unavailable' when kind in (2, 3) then 'partial' else 'known' end as usage_status,
  case when kind = 5 then 'unavailable' when kind in (1, 2, 3, 4) then 'partial' else 'known' end as response_status,
  case when kind in (1, 2) then 1 else 0 end as n_bad,
  case when kind = 5 then '' when kind = 4 then 'thinking:0:hm ' || ',text:1:' || repeat('a', 1000) || repeat('b', 197) else 'thinking:0:hm ' || ',text:1:card 4' || o_orderkey end as blocks
from o
""")
def folded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that are good, hold a bad frame before or after the last counts, break off, are too long, or no stream."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # An order becomes a response of many times its size, so few partitions of orders are much work each.
    orders = over_cores(orders, orders)
    kind = F.col("o_orderkey") % 6
    said = lambda index, type_, name, text: F.concat(F.lit(f'data: {{"type":"content_block_delta","index":{index},"delta":{{"type":"{type_}","{name}":"'), text, F.lit('"}}\n\n'))
    counts = F.concat(F.lit('data: {"delta":{"stop_reason":"end_turn"},"usage":{"output_tokens":'), (F.col("o_custkey") % 300 + 2).cast("string"), F.lit("}}"))
    bad = F.lit("data: {oops\n\n")
    stream = F.concat(
        F.lit('event: a\ndata: {"message":{"usage":{"input_tokens":'), (F.col("o_orderkey") % 500 + 1).cast("string"), F.lit(',"output_tokens":1}}}\n\n'),
        said(0, "thinking_delta", "thinking", F.lit("hm ")),
        said(1, "text_delta", "text", F.when(kind == 4, F.repeat(F.lit("a"), F.lit(1000))).otherwise(F.lit("card 4"))),
        F.when(kind == 1, bad).otherwise(F.lit("")),
        said(1, "text_delta", "text", F.when(kind == 4, F.repeat(F.lit("b"), F.lit(1000))).otherwise(F.col("o_orderkey").cast("string"))),
        counts, F.when(kind == 3, F.lit("")).otherwise(F.lit("\r\n\r\n")), F.when(kind == 2, bad).otherwise(F.lit("")),
    )
    rows = orders.select("o_orderkey", stream.alias("response"), F.when(kind == 5, "text/plain").otherwise("Text/Event-Stream; charset=utf-8").alias("content_type"))
    out = traffic.fold_responses(rows, most=1200)
    blocks = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["kind"], b["index"], b["text"])), ",")
    return out.select("o_orderkey", "usage.input_tokens", "usage.output_tokens", "usage_status", "response_status", "n_bad", blocks.alias("blocks"))


@query("""
with u as (
  select o_custkey % 400 as session, o_orderpriority as model, case when o_orderpriority <> '1-URGENT' then floor(o_totalprice) end as cost,
    case o_orderkey % 5 when 0 then 'api-key' when 1 then 'subscription' when 2 then case when o_custkey % 400 < 300 then 'api-key' else '' end when 3 then case when o_custkey % 400 < 200 then 'api-key' end else 'api-key' end as route,
    o_orderkey % 5 = 1 and o_custkey % 400 < 350 as skipped from orders where o_orderstatus = 'P'
)
select session, coalesce(sum(cost), 0)::double as cost, count(cost)::bigint as n_priced, coalesce(string_agg(distinct model, ',' order by model) filter (cost is null), '') as unpriced,
  case when count(distinct coalesce(route, '')) filter (cost is not null) = 1 and max(coalesce(route, '')) filter (cost is not null) <> '' then max(route) filter (cost is not null)
    when count(cost) = 0 or bool_or(coalesce(route, '') = '') filter (cost is not null) then 'unknown' else 'mixed' end as basis
from u where not skipped group by session
""")
def spend_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    session, nth = F.col("o_custkey") % 400, F.col("o_orderkey") % 5
    route = F.when(nth.isin(0, 4), "api-key").when(nth == 1, "subscription").when(nth == 2, F.when(session < 300, "api-key").otherwise("")).otherwise(F.when(session < 200, "api-key"))
    cost = F.when(F.col("o_orderpriority") != "1-URGENT", F.floor("o_totalprice").cast("double"))
    usage = o.where(~((nth == 1) & (session < 350))).select(session.alias("session"), F.col("o_orderpriority").alias("model"), cost.alias("cost"), route.alias("auth_route"))
    return traffic.spend_basis(usage, ["session"]).withColumn("unpriced", F.array_join("unpriced", ","))
