"""Queries of report totals, logs, transcripts, configuration and small expressions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.functions import checks
from textwarden.functions.detectors import ScanConfig
from textwarden.operators import events as tool_events
from textwarden.operators import labels, payload, policy, records, redact, requests, totals, traffic, transcripts
from textwarden.plans.registry import query
from textwarden.plans.traffic import REQUESTS_SQL, _requests
from textwarden.sources import logs
from textwarden.sources.tables import read_table, scratch_path


def _orders(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def _lines(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(c) for c, e in columns.items()])


# ---- totals ----

SECTION = "case l_linenumber % 3 when 0 then 'tools' when 1 then 'system' else 'messages' end"


@query(f"""
with s as (select l_suppkey % 50 as session, {SECTION} as name, l_quantity::bigint as bytes from lineitem), t as (select session, name, sum(bytes)::bigint as bytes, count(*)::bigint as n_requests from s group by all)
select *, round(bytes / sum(bytes) over (partition by session), 6) as share from t
""")
def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.section_totals(_lines(spark, sf_dir, session="l_suppkey % 50", name=SECTION, bytes="cast(l_quantity as bigint)"), ["session"])


@query(f"select {SECTION} as section, l_returnflag as entity, sum(l_quantity)::bigint as n from lineitem group by all")
def entity_section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.entity_section_totals(_lines(spark, sf_dir, section=SECTION, entity="l_returnflag", n="cast(l_quantity as bigint)"), [])


KIND = "case l_linenumber % 3 when 0 then 'text' when 1 then 'thinking' else 'tool_input' end"


@query(f"select l_suppkey % 20 as session, {KIND} as kind, l_returnflag as entity, sum(l_quantity)::bigint as n from lineitem group by all")
def response_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.response_totals(_lines(spark, sf_dir, session="l_suppkey % 20", kind=KIND, entity="l_returnflag", n="cast(l_quantity as bigint)"), ["session"])


@query("select o_orderstatus as project, label, sum(n)::bigint as n from (select o_orderstatus, 'ticket' as label, o_orderkey % 5 as n from orders union all select o_orderstatus, 'client', o_custkey % 3 from orders) group by all")
def custom_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.custom_totals(_orders(spark, sf_dir, project="o_orderstatus", custom="map('ticket', o_orderkey % 5, 'client', o_custkey % 3)"), ["project"])


STOP = "case o_orderkey % 7 when 0 then 'max_tokens' when 1 then 'length' when 2 then 'end_turn' when 3 then 'tool_use' when 4 then 'max_output_tokens' when 5 then 'stop' end"


@query(f"select o_orderpriority as model, stop_reason, count(*)::bigint as n from (select o_orderpriority, {STOP} as stop_reason from orders) where stop_reason is not null group by all")
def stop_reason_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.stop_reason_totals(_orders(spark, sf_dir, model="o_orderpriority", stop_reason=STOP), ["model"])


@query(f"""
select model, count(*)::bigint as n_known, count(*) filter (where stop_reason in ('max_tokens', 'length', 'max_output_tokens'))::bigint as n_truncated, round(count(*) filter (where stop_reason in ('max_tokens', 'length', 'max_output_tokens')) / count(*), 6) as truncated_share
from (select o_custkey % 11 as model, {STOP} as stop_reason from orders) where stop_reason is not null group by model
""")
def truncated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.truncated_share(_orders(spark, sf_dir, model="o_custkey % 11", stop_reason=STOP), ["model"])


@query("select o_custkey % 40 as session_id, coalesce(sum(o_orderkey % 9) filter (where o_orderkey % 4 <> 0), 0)::bigint as bare_numbers from orders group by all")
def bare_number_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.bare_number_totals(_orders(spark, sf_dir, session_id="o_custkey % 40", direction="case when o_orderkey % 4 = 0 then 'model_output' else 'inbound' end", bare_numbers="o_orderkey % 9"), ["session_id"])


@query("""
select lang as project, doc_id % 30 as session, min(doc_id)::bigint as first_ts, max(doc_id)::bigint as last_ts, count(*)::bigint as n_texts, coalesce(sum(strlen(text)), 0)::bigint as bytes, sum(doc_id % 3)::bigint as skipped, count(*) filter (where doc_id % 5 = 0)::bigint as uninspected
from documents group by all
""")
def audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "documents").select(F.col("lang").alias("project"), (F.col("doc_id") % 30).alias("session"), F.col("doc_id").alias("ts"), "text", (F.col("doc_id") % 3).alias("skipped"), (F.col("doc_id") % 5 != 0).alias("inspected"))
    return totals.audit_bounds(texts, ["project", "session"])


@query("with t as (select c_nationkey % 25 as project, count(*)::bigint as n from customer group by all) select *, row_number() over (order by n desc, project)::int as place from t")
def projects_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.projects_by_total(read_table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 25).alias("project"), F.lit(1).cast("long").alias("n")))


@query("""
with c as (select o_orderstatus as action, 'tool' || (o_custkey % 9) as place_name, count(*) as n from orders group by all),
r as (select *, row_number() over (partition by action order by n desc, place_name) as no, count(*) over (partition by action) as total from c)
select action, string_agg(place_name, ', ' order by no) filter (where no <= 3) || case when max(total) > 3 then ', +' || (max(total) - 3) || ' more' else '' end as sources from r group by action
""")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _orders(spark, sf_dir, action="o_orderstatus", place_name="concat('tool', o_custkey % 9)").groupBy("action", "place_name").agg(F.count("*").alias("n"))
    return totals.top_sources(counts, ["action"])


LEDGER = {"session_id": "o_custkey % 60", "ts": "o_orderdate", "file": "o_orderkey % 3", "file_pos": "o_orderkey"}
LEDGER_SQL = "select o_custkey % 60 as session_id, o_orderdate as ts, o_orderkey % 3 as file, o_orderkey as file_pos from orders"


@query(f"select session_id, file_pos, row_number() over (partition by session_id order by ts, file, file_pos)::int as ordinal from ({LEDGER_SQL})")
def ledger_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.in_ledger_order(_orders(spark, sf_dir, **LEDGER), ["session_id"]).select("session_id", "file_pos", "ordinal")


@query(f"select session_id, file_pos, coalesce(ts < max(ts) over (partition by session_id order by file, file_pos rows between unbounded preceding and 1 preceding), false) as late from ({LEDGER_SQL})")
def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.late_records(_orders(spark, sf_dir, **LEDGER), ["session_id"]).select("session_id", "file_pos", "late")


@query(f"""
with r as (select session_id, file_pos, row_number() over (partition by session_id order by ts, file, file_pos)::int as ordinal from ({LEDGER_SQL}))
select * from r where ordinal > coalesce((select max(mark) from (select session_id as s, ordinal as mark from r where file_pos % 40 = 7) m where m.s = r.session_id), 0)
""")
def new_since_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = totals.in_ledger_order(_orders(spark, sf_dir, **LEDGER), ["session_id"]).select("session_id", "file_pos", "ordinal")
    return totals.new_since_summary(placed, placed.where("file_pos % 40 = 7").select("session_id", F.col("ordinal").alias("mark")), ["session_id"])


@query("""select l_orderkey as doc_id, l_linenumber, row_number() over (partition by l_orderkey order by l_partkey % 50, l_partkey % 50 + l_quantity::bigint, l_returnflag || l_linenumber)::int as no from lineitem""")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir, doc_id="l_orderkey", l_linenumber="l_linenumber", start="l_partkey % 50", end="l_partkey % 50 + cast(l_quantity as bigint)", entity="concat(l_returnflag, l_linenumber)")
    return totals.in_finding_order(found, ["doc_id"]).select("doc_id", "l_linenumber", "no")


@query("select doc_id, coalesce(strlen(text), 0)::int as in_bytes, coalesce(strlen(replace(text, ' ', '')), 0)::int as out_bytes from documents")
def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", totals.payload_bytes(F.col("text"), F.replace("text", F.lit(" "), F.lit(""))).alias("b")).select("doc_id", "b.*")


@query("""
with f as (select o_orderstatus as project, 's' || (o_custkey % 8) as session, case o_orderkey % 2 when 0 then 'EMAIL' else 'IBAN' end as entity, (o_orderkey % 5 + 1) as n from orders),
s as (select project, session, sum(n) as n, string_agg('"' || entity || '":' || k, ',' order by entity) as e from (select project, session, entity, sum(n)::bigint as n, sum(n)::bigint as k from f group by all) group by all)
select project, sum(n)::bigint as n, '{"sessions":[' || string_agg('{"session":"' || session || '","n":' || n || ',"entities":{' || e || '}}', ',' order by session) || ']}' as document from s group by project
""")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir, project="o_orderstatus", session="concat('s', o_custkey % 8)", entity="case o_orderkey % 2 when 0 then 'EMAIL' else 'IBAN' end", n="o_orderkey % 5 + 1")
    return totals.report(found)


@query(f"""
select conversation as session_id, case when bool_and(m) then 'known' when bool_or(m) then 'partial' else 'unavailable' end as status, count(*) filter (where not m)::bigint as n_unmeasured from (select conversation % 300 as conversation, request_bytes % 3 <> 0 as m from ({REQUESTS_SQL})) group by all
""")
def scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = _requests(spark, sf_dir).select((F.col("conversation") % 300).alias("session_id"), (F.col("request_bytes") % 3 != 0).alias("measured"))
    return traffic.scan_status(scans, ["session_id"])


@query("select o_orderkey, case when o_orderkey % 4 > 0 then 'findings' when o_custkey % 2 + o_orderkey % 3 > 0 then 'incomplete' else 'safe' end as verdict from orders")
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", transcripts.verdict(F.col("o_orderkey") % 4, F.col("o_custkey") % 2, F.col("o_orderkey") % 3).alias("verdict"))


# ---- logs and transcripts ----

RECORD_SQL = "select (o_custkey % 50)::varchar as session_id, o_orderkey, o_orderdate as ts, o_orderkey % 100 as in_bytes from orders"


def _ledger(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "ledger")
    logs.write_ledger(_orders(spark, sf_dir, session_id="cast(o_custkey % 50 as string)", ts="cast(o_orderdate as timestamp)", note="cast(o_orderkey as string)", in_bytes="o_orderkey % 100"), path)
    return path


@query(f"select strftime(ts, '%Y-%m') as month, count(*)::bigint as n, sum(in_bytes)::bigint as in_bytes from ({RECORD_SQL}) where ts >= '1995-06-15' group by all")
def read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger written by month and read again from a day on."""
    return logs.read_ledger(spark, _ledger(spark, sf_dir), "1995-06-15").groupBy("month").agg(F.count("*").alias("n"), F.sum("in_bytes").alias("in_bytes"))


@query(f"select session_id, count(*)::bigint as n from ({RECORD_SQL}) where last_day(ts) + 1 + interval 30 day > date '1997-01-10' group by all")
def prune_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.kept_months(logs.read_ledger(spark, _ledger(spark, sf_dir)), "1997-01-10").groupBy("session_id").agg(F.count("*").alias("n"))


@query("select case o_orderkey % 4 when 0 then '/v1/messages' when 1 then '/v1/responses' else '/v1/chat/completions' end as path, count(*)::bigint as n, sum(o_orderkey % 1000)::bigint as request_bytes from orders where o_orderkey % 4 <> 3 group by all")
def read_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges written as JSON lines and read again; other paths than those of models are left out."""
    path = scratch_path(spark, "exchanges")
    _orders(spark, sf_dir, session_id="cast(o_custkey as string)", seq="o_orderkey", request_bytes="o_orderkey % 1000", path="case o_orderkey % 4 when 0 then '/v1/messages' when 1 then '/v1/responses' when 2 then '/v1/chat/completions' else '/health' end").write.json(path)
    return logs.read_exchanges(spark, path).groupBy("path").agg(F.count("*").alias("n"), F.sum("request_bytes").alias("request_bytes"))


@query("select o_orderkey, o_orderstatus as entity from orders where o_orderkey % 3 = 0")
def write_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "findings")
    logs.write_findings(_orders(spark, sf_dir, o_orderkey="o_orderkey", entity="o_orderstatus").where("o_orderkey % 3 = 0"), path)
    return spark.read.schema("o_orderkey long, entity string").json(path)


def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of transcripts: one conversation a file; every fifth line is broken."""
    turns = read_table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct(F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("type"), F.concat(F.lit("/p"), (F.col("conv_id") % 3).cast("string"), F.lit("/x")).alias("cwd"), F.concat(F.lit("2025-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit("T00:00:00Z")).alias("timestamp"), F.struct(F.col("role"), F.col("text").alias("content")).alias("message")))
    raw = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat(record, F.lit("}"))).otherwise(record)
    session = F.col("conv_id").cast("string")
    return turns.select(session.alias("session_id"), session.alias("file"), F.lit(False).alias("is_subagent"), F.col("turn").alias("line_no"), raw.alias("raw"))


TURNS = "select conv_id::varchar as session_id, turn as line_no, case when role = 'assistant' then 'assistant' else 'user' end as type, role, text, conv_id, (conv_id + turn) % 5 = 0 as bad from conversations"


@query(f"select session_id, count(*)::bigint as skipped from ({TURNS}) where bad group by all")
def parse_jsonl_counting_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_lines(_transcript(spark, sf_dir))[1].select("session_id", "skipped")


@query(f"""
select session_id, line_no, case when type = 'user' then 'reached' else 'output' end as kind, case when type = 'user' then 'your prompt' else 'model output' end as door, md5(text) as digest
from ({TURNS}) where not bad and text is not null and text <> '' and not regexp_matches(text, '^\\s*\\[')
""")
def extract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcripts.extract_texts(transcripts.parse_lines(_transcript(spark, sf_dir))[0])
    return found.select("session_id", "line_no", "kind", "door", F.md5("text").alias("digest"))


@query(f"select session_id, line_no from ({TURNS}) where not bad and conv_id % 3 = 1")
def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.project_filter(transcripts.parse_lines(_transcript(spark, sf_dir))[0], "/p1/").select("session_id", "line_no")


@query(f"select session_id, line_no from ({TURNS}) where not bad and line_no % 9 + 1 >= 3")
def since_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = transcripts.since_filter(transcripts.parse_lines(_transcript(spark, sf_dir))[0], "2025-01-03T00:00:00Z")
    return kept.select("session_id", "line_no")


# ---- events, policy, names ----

@query("select o_orderkey, case o_orderkey % 4 when 0 then '/a/' || o_custkey when 1 then 'https://h/' || o_custkey when 2 then '/n/' || o_custkey end as target from orders")
def target_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("to_json(case o_orderkey % 4 when 0 then map('url', 'x', 'file_path', concat('/a/', o_custkey)) when 1 then map('file_path', '', 'url', concat('https://h/', o_custkey)) when 2 then map('notebook_path', concat('/n/', o_custkey)) else map('other', 'x') end)")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tool_events.target_of(given).alias("target"))


@query("select o_orderkey from orders where not (o_orderkey % 4 = 0 and o_custkey % 2 = 0) and not (o_orderkey % 4 = 1 and o_custkey % 2 = 1)")
def opaque_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _orders(spark, sf_dir, o_orderkey="o_orderkey", path="array('content', case o_orderkey % 4 when 0 then 'data' when 1 then 'signature' else 'text' end)", text="o_orderpriority", sibling_type="case o_custkey % 2 when 0 then 'base64' else 'thinking' end")
    return tool_events.opaque(leaves).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey % 2 = 0 and o_custkey % 3 in (0, 1) and o_orderkey % 5 <> 0 and o_custkey % 7 <> 0")
def shrinkable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, o_orderkey="o_orderkey", direction="case o_orderkey % 2 when 0 then 'inbound' else 'outbound' end", tool_name="case o_custkey % 3 when 0 then 'mcp__x' when 1 then 'WebFetch' else 'Read' end", mode="case o_orderkey % 5 when 0 then 'observe' else 'enforce' end", can_rewrite="o_custkey % 7 <> 0")
    return tool_events.shrinkable(rows).select("o_orderkey")


@query("select o_orderkey, md5(o_orderkey::varchar) as value from orders where o_orderkey % 2 = 0")
def key_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that only its key makes a secret."""
    leaves = _orders(spark, sf_dir, o_orderkey="o_orderkey", name="case o_orderkey % 2 when 0 then 'password' else 'colour' end", text="md5(cast(o_orderkey as string))")
    found = tool_events.scan_with_keys(leaves, ["o_orderkey"], ScanConfig(entities=("SECRET",)))
    return found.select("o_orderkey", F.expr("substring(md5(cast(o_orderkey as string)), start + 1, end - start)").alias("value"))


@query("select o_orderkey from orders where case when o_custkey % 3 = 0 then o_orderkey % 3 = 0 when o_custkey % 5 = 0 then o_orderkey % 3 = 1 else o_orderkey % 3 in (0, 2) end")
def entity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir, o_orderkey="o_orderkey", tool_name="case when o_custkey % 3 = 0 then 'Bash' else 'Read' end", event="case when o_custkey % 5 = 0 then 'prompt' else 'result' end", entity="case o_orderkey % 3 when 0 then 'EMAIL' when 1 then 'IBAN' else 'SSN' end")
    scopes = spark.createDataFrame([("tool", "Bash", ["EMAIL"]), ("event", "prompt", ["IBAN"])], "kind string, name string, entities array<string>")
    return policy.entity_scope(found, scopes, ["EMAIL", "SSN"]).select("o_orderkey")


@query("select p_partkey, case when length(trim(p_name)) = 0 or p_name is null then 'unknown' else p_name end as label from part")
def display_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select("p_partkey", labels.display_label(F.col("p_name")).alias("label"))


@query("select page_id, case when url like '%://%' then url else url end as name, regexp_extract(regexp_replace('/x/' || replace(url, '://', '/'), '[/\\\\]+$', ''), '([^/\\\\]*)$', 1) as base from pages")
def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/x/"), F.replace("url", F.lit("://"), F.lit("/")))
    return read_table(spark, sf_dir, "pages").select("page_id", labels.base_name(F.col("url")).alias("name"), labels.base_name(path).alias("base"))


@query("select o_orderkey, 'run ' || case when o_orderkey % 2 = 0 then '<EMAIL_1>' else 'plain' end as label from orders")
def scrub_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _orders(spark, sf_dir, o_orderkey="o_orderkey", label="concat('run ', case when o_orderkey % 2 = 0 then concat('user', o_custkey, '@example.com') else 'plain' end)")
    return labels.scrub(named, "label", ScanConfig(entities=("EMAIL",)))


@query("select o_orderkey, right('4' || lpad((o_orderkey * 31)::varchar, 15, '0'), 4) as tail from orders")
def reveal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.expr("regexp_replace(concat('4', lpad(cast(o_orderkey * 31 as string), 15, '0')), '(....)', '$1 ')")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", redact.reveal_tail(spaced, 4).alias("tail"))


@query("select o_orderkey, 'EMAIL' as entity, (o_orderkey % 1000)::int as number from orders union all select o_orderkey, 'IBAN', (o_custkey % 1000)::int from orders")
def placeholder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('a <EMAIL_', o_orderkey % 1000, '> b <IBAN_', o_custkey % 1000, ':1234> c <b> <Mail_1>')")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.explode(redact.placeholder_names(text)).alias("p")).select("o_orderkey", "p.*")


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'empty' when 1 then 'ref' else 'set' end as state, case when o_orderkey % 6 = 2 then 1 else 0 end as n_entities from orders")
def env_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _orders(spark, sf_dir, path="'x.env'", line="cast(o_orderkey as int)", name="'MAIL'", value="case o_orderkey % 3 when 0 then '' when 1 then concat('$', '{OTHER}') else case o_orderkey % 6 when 2 then concat('u', o_orderkey, '@example.com') else 'plain' end end")
    done = tool_events.env_state(entries, ScanConfig(entities=("EMAIL",)))
    return done.select(F.col("line").cast("long").alias("o_orderkey"), "state", F.size("entities").alias("n_entities"))


@query("select o_orderkey, case o_orderkey % 2 when 0 then strlen(o_orderpriority) + 3 else strlen(o_orderstatus) end::int as bytes from orders")
def tool_result_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.expr("case o_orderkey % 2 when 0 then to_json(array(named_struct('type', 'text', 'text', o_orderpriority), named_struct('type', 'text', 'text', 'abc'))) else concat('\"', o_orderstatus, '\"') end")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", tool_events.tool_result_size(content).alias("bytes"))


@query("select o_custkey, (2 * count(*))::bigint as n_files, (sum(strlen('Called the Read tool ' || o_orderkey)) + sum(strlen('Result of calling the Read tool')))::bigint as bytes from orders group by o_custkey")
def at_file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('hi <system-reminder>Called the Read tool ', o_orderkey, '</system-reminder> and <system-reminder>other</system-reminder><system-reminder>Result of calling the Read tool</system-reminder>')"
    return tool_events.at_file_totals(_orders(spark, sf_dir, o_custkey="o_custkey", text=text), ["o_custkey"])


@query("select conv_id as session_id, 'EMAIL' as entity, count(*)::bigint as n, bool_or(length('m a' || turn || '@example.com ' || coalesce(text, '')) > 1000) as truncated from conversations group by conv_id")
def model_output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("m a"), F.col("turn").cast("string"), F.lit("@example.com "), F.translate(F.coalesce("text", F.lit("")), "@", " "))
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", text.alias("text"))
    return tool_events.model_output_counts(turns, ScanConfig(entities=("EMAIL",)), most=1000)


# ---- exchanges ----

@query("""
select o_orderkey, o_orderkey % 500 as input_tokens, o_custkey % 300 as output_tokens, case when o_orderkey % 2 = 0 then o_custkey % 70 end as cache_read, case when o_orderkey % 2 = 0 then 'end_turn' else 'stop' end as stop_reason from orders
""")
def usage_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage and stop reason in two naming schemes."""
    body = F.expr("case o_orderkey % 2 when 0 then concat('{\"usage\":{\"input_tokens\":', o_orderkey % 500, ',\"output_tokens\":', o_custkey % 300, ',\"cache_read_input_tokens\":', o_custkey % 70, '},\"stop_reason\":\"end_turn\"}') else concat('{\"usage\":{\"prompt_tokens\":', o_orderkey % 500, ',\"completion_tokens\":', o_custkey % 300, '},\"choices\":[{\"finish_reason\":\"stop\"}]}') end")
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", traffic.usage_of(body).alias("u"), traffic.stop_reason_of(body).alias("stop_reason"))
    return rows.select("o_orderkey", "u.input_tokens", "u.output_tokens", "u.cache_read", "stop_reason")


@query("select o_orderkey, o_orderkey % 500 + 1 as input_tokens, o_custkey % 300 + 2 as output_tokens, 'known' as usage_status, 3::bigint as n_events, 'end_turn' as stop_reason from orders")
def merge_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage and stop reason merged over the events of streamed responses."""
    stream = "concat('event: a\\ndata: {\"message\":{\"usage\":{\"input_tokens\":', o_orderkey % 500 + 1, ',\"output_tokens\":1}}}\\n\\ndata: {\"type\":\"ping\"}\\n\\ndata: {\"delta\":{\"stop_reason\":\"end_turn\"},\"usage\":{\"output_tokens\":', o_custkey % 300 + 2, '}}\\n\\ndata: [DONE]\\n\\n')"
    found = traffic.sse_events(_orders(spark, sf_dir, o_orderkey="o_orderkey", response=stream), ["o_orderkey"])
    merged = traffic.merge_usage(found, ["o_orderkey"]).select("o_orderkey", "input_tokens", "output_tokens", "usage_status")
    counts = found.groupBy("o_orderkey").agg(F.count("*").alias("n_events"))
    return merged.join(counts, "o_orderkey").join(traffic.merge_stop_reasons(found, ["o_orderkey"]), "o_orderkey")


@query("select o_orderkey, kind, text from (select o_orderkey, 'text' as kind, 'card 4' || lpad((o_orderkey)::varchar, 15, '0') as text from orders union all select o_orderkey, 'thinking', 'hm ' || o_custkey from orders)")
def sse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are split over the deltas of a stream are whole again."""
    stream = "concat('data: {\"index\":0,\"delta\":{\"type\":\"thinking_delta\",\"thinking\":\"hm \"}}\\n\\ndata: {\"index\":1,\"delta\":{\"type\":\"text_delta\",\"text\":\"card 4\"}}\\n\\ndata: {\"index\":0,\"delta\":{\"type\":\"thinking_delta\",\"thinking\":\"', o_custkey, '\"}}\\n\\ndata: {\"index\":1,\"delta\":{\"type\":\"text_delta\",\"text\":\"', lpad(cast(o_orderkey as string), 15, '0'), '\"}}\\n\\n')"
    found = traffic.sse_events(_orders(spark, sf_dir, o_orderkey="o_orderkey", response=stream), ["o_orderkey"])
    return traffic.sse_texts(found, ["o_orderkey"]).select("o_orderkey", "kind", "text")


@query("select o_orderkey, name, bytes::bigint as bytes from (select o_orderkey, 'tools' as name, 2 + 3 as bytes from orders union all select o_orderkey, 'system', 2 + strlen(o_orderpriority) from orders union all select o_orderkey, 'messages', 2 from orders union all select o_orderkey, 'rest', strlen('{\"tools\":,\"system\":,\"messages\":,\"model\":\"m\"}') from orders)")
def section_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('{\"tools\": [\"t\"], \"system\": \"', o_orderpriority, '\", \"messages\": [], \"model\": \"m\"}')"
    return requests.section_bytes(_orders(spark, sf_dir, o_orderkey="o_orderkey", body=body), ["o_orderkey"])


@query("select c, count(*)::bigint as n_orders from (select o_custkey % 97 as c from orders) group by c")
def conversation_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a conversation share the key of its first message."""
    body = "concat('{\"messages\":[{\"role\":\"user\",\"content\":\"hello ', o_custkey % 97, '\"},{\"role\":\"assistant\",\"content\":\"', o_orderkey, '\"}]}')"
    keyed = _orders(spark, sf_dir, c="o_custkey % 97", body=body).select("c", requests.conversation_key(F.col("body")).alias("key"))
    return keyed.groupBy("key").agg(F.min("c").alias("c"), F.max("c").alias("d"), F.count("*").alias("n_orders")).where("c = d").select("c", "n_orders")


@query("select o_orderkey, 0::int as no, 'f' || (o_custkey % 10) as name, 'line two' as content from orders where o_orderkey % 2 = 0 union all select o_orderkey, 0, 'f' || (o_custkey % 10), 'line one' || chr(10) || 'line two' || chr(10) || 'line three' from orders where o_orderkey % 2 = 1")
def attach_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _orders(spark, sf_dir, o_orderkey="o_orderkey", cwd="'/w'", prompt="concat('see @f', o_custkey % 10, case o_orderkey % 2 when 0 then '#L2' else '' end, ' please @missing')")
    files = _orders(spark, sf_dir, cwd="'/w'", name="concat('f', o_custkey % 10)", content="'line one\\nline two\\nline three'").distinct()
    return requests.attach_mentions(prompts, files, ["o_orderkey"])


@query("""
select 'cache-rewrite' as rule, o_custkey % 20 as session_id, 'm' as subject, count(*)::bigint as occurrences from orders where o_orderkey % 3 = 0 group by all
union all select 'duplicate-request', o_custkey % 20, '/v1/messages', count(*) from orders where o_orderkey % 5 = 0 group by all
union all select 'large-result', s, 't' || k, c from (select o_custkey % 20 as s, o_orderkey as k, (o_orderkey % 7)::bigint as c, row_number() over (partition by o_custkey % 20 order by o_orderkey % 30000 desc, 't' || o_orderkey) as no from orders where o_orderkey % 30000 > 25000) where no = 1
""")
def traffic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rewrites = _orders(spark, sf_dir, session_id="o_custkey % 20", model_id="'m'", rewrite="o_orderkey % 3 = 0")
    duplicates = _orders(spark, sf_dir, session_id="o_custkey % 20", path="'/v1/messages'", duplicate="o_orderkey % 5 = 0")
    results = _orders(spark, sf_dir, session_id="o_custkey % 20", tool_use_id="concat('t', o_orderkey)", bytes="o_orderkey % 30000", carried="o_orderkey % 7")
    return requests.traffic_findings(rewrites, duplicates, results)


# ---- checks and keys ----

@query("select o_orderkey, ((o_orderkey * 1000000 + 131400 + 37) % 97)::int as rest, md5(o_orderkey::varchar) as digest, substr(sha256(o_orderkey::varchar), 1, 32) as key from orders")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remainder of account numbers, and digests of texts and sessions."""
    account = F.expr("concat('DE37', cast(o_orderkey as string))")
    key = F.col("o_orderkey").cast("string")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", checks.mod97(account).cast("int").alias("rest"), F.md5(key).alias("digest"), records.session_key(key).alias("key"))


@query("""
with d as (select o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('rule|session|' || o_orderkey)) as x from orders)
select o_orderkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(x, 17, 1))::int + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) as id from d
""")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", records.finding_id(F.lit("rule"), F.lit("session"), F.col("o_orderkey").cast("string")).alias("id"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m') as month, datediff('day', o_orderdate, timestamp '1996-01-01') > 90 as stale from orders")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and months of moments, and whether prices of that day are out of date."""
    ts = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy-MM").alias("month"), totals.prices_stale(ts, F.lit("1996-01-01").cast("date")).alias("stale"))


@query("select o_orderkey, 5::bigint as n_leaves, 2::bigint as n_keys, o_orderpriority as text from orders")
def walk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaves of nested payloads: keys, strings and numbers at every depth."""
    body = "concat('{\"a\":[\"', o_orderpriority, '\",', o_orderkey, '],\"b\":\"x\"}')"
    found = payload.walk_payload(_orders(spark, sf_dir, o_orderkey="o_orderkey", body=body), "body", ["o_orderkey"])
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n_leaves"), F.count_if("is_key").alias("n_keys"), F.max(F.when(F.array_join("path", "/") == "a/0", F.col("text"))).alias("text"))


@query("select o_orderkey, '{\"a\":[\"<X_' || (o_orderkey % 9) || '>\",1],\"b\":\"x\"}' as body from orders")
def replace_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir, o_orderkey="o_orderkey", body="concat('{\"a\": [\"', o_orderpriority, '\", 1], \"b\": \"x\"}')")
    changes = _orders(spark, sf_dir, o_orderkey="o_orderkey", path="array('a', '0')", text="concat('<X_', o_orderkey % 9, '>')")
    return payload.replace_leaves(rows, "body", changes, ["o_orderkey"])
