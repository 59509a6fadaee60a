"""Queries of reshaping, injection flags and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators import injection, payload, reshape
from textwarden.plans.registry import query
from textwarden.sources.tables import read_table


@query(r"""
select doc_id, len(text)::int as n_before, len(regexp_replace(regexp_replace(text, '[ \t]+\n', E'\n', 'g'), '[ \t]+$', ''))::int as n_after from documents
""")
def line_rstrip_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n_before"), F.length(reshape.line_rstrip(F.col("text"))).alias("n_after"))


@query()
def shrink_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    done = reshape.shrink(pages, "text", ["page_id"])
    return done.select("page_id", F.length("text").alias("n_chars"), "applied")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.html_text(read_table(spark, sf_dir, "pages"), "html", ["page_id"])


@query(r"""
with t as (
  select 'documents' as origin, doc_id as id, text from documents union all select 'pages', page_id, html from pages union all select 'conversations', conv_id * 1000 + turn, text from conversations
), f as (select origin, id, translate(lower(text), 'ışğüöç', 'isguoc') as x, len(text) as n from t)
select origin, id,
  n >= 24 and regexp_matches(x, '\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|prior|earlier|above)\b.{0,30}\b(?:instruction|prompt|rule|message)') as override_seen,
  n >= 24 and regexp_matches(x, '\b(?:do not|don''t|never) (?:tell|mention|reveal|show)\b.{0,30}\b(?:user|anyone|human)') as secrecy_seen
from f
""")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    pages = read_table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    seen = documents.unionByName(pages).unionByName(turns).select("origin", "id", injection.detect_injection(F.col("text")).alias("m"))
    return seen.select("origin", "id", F.array_contains("m", "instruction_override").alias("override_seen"), F.array_contains("m", "secrecy_request").alias("secrecy_seen"))


@query("""
with p as (select event_id, json_extract_string(props, '$') as x, props from events where props is not null and json_valid(props) and json_type(props) = 'OBJECT'),
k as (select event_id, unnest(json_keys(props)) as key, props from p)
select key, count(*)::bigint as n from k group by key
""")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each top-level key occurs in the payloads of events."""
    walked = payload.walk_payload(read_table(spark, sf_dir, "events"), "props", ["event_id"])
    return walked.where("is_key and size(path) = 1").groupBy(F.col("text").alias("key")).agg(F.count("*").alias("n"))
