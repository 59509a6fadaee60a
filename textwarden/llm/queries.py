"""The operators' queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from textwarden.llm import fim, licenses, mixing, neighbours, ngram_join, packing, paragraphs, pii, quality, repeats, topk, trie, urls
from textwarden.llm.tables import read_table


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    none = F.lit(-1).cast("long")
    first, last = F.coalesce("first_slot", none), F.coalesce(F.array_max("slots"), none)
    return mix.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_slot"), last.alias("last_slot"))


OP4_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as source_no from sized group by source
), weighed as (
  select *, [3, 1, 2][(source_no - 1) % 3 + 1] as weight, (2 * source_size)::double as cap, (2 * source_size)::double / [3, 1, 2][(source_no - 1) % 3 + 1] as need from sources
), levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by need, source_no rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by need, source_no rows between current row and unbounded following) as level
  from weighed
), dealt as (
  select *, (select level from levels where level < need order by need, source_no limit 1) as deal from levels
), targets as (
  select source, source_size, case when deal is null or need <= deal then cap else deal * weight end as target from dealt
), lines as (
  select *, least(floor(target + 0.5)::bigint, 2 * source_size) as line_words,
    greatest(1, least(1024, floor(1.5::double * sum(source_size) over () / 65536)))::bigint as block_words, row_number() over (order by source nulls last) as source_no
  from targets
), counted as (
  select *, ceil(line_words / block_words)::bigint as n_slots from lines
), placed as (
  select *, coalesce(sum(n_slots) over (order by source_no rows between unbounded preceding and 1 preceding), 0)::bigint as first_place, sum(n_slots) over ()::bigint as points from counted
), points as (
  select source_no, block_words, line_words, unnest(range(first_place, first_place + n_slots)) as place, greatest(0, ceil(log2(greatest(points, 1))))::bigint as bits from placed where n_slots > 0
), slots as (
  select source_no, block_words, line_words, coalesce(list_sum(list_transform(range(bits), lambda b: ((place >> b) & 1) << (bits - 1 - b))), 0)::bigint as slot from points
), ranked as (
  select *, row_number() over (partition by source_no order by slot) - 1 as rank from slots
), line as (
  select row_number() over () as r, s.doc_id, s.size, t.source_no, t.source_size, t.target, t.line_words, t.block_words,
    coalesce(sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.size rows between unbounded preceding and 1 preceding), 0)::bigint as begins
  from sized s join placed t on s.source is not distinct from t.source
), stretches as (
  select r, k, source_no, block_words, begins + k * source_size as a, least(begins + k * source_size + size, line_words) as z from line, range(2) as rounds(k) where size > 0
), blocks as (
  select *, unnest(range(a // block_words, (z - 1) // block_words + 1)) as rank from stretches where a < z
), found as (
  select b.r, b.k, sum(least(b.z, (b.rank + 1) * s.block_words, s.line_words) - greatest(b.a, b.rank * s.block_words))::bigint as taken, min(s.slot) as slot
  from blocks b join ranked s on b.source_no = s.source_no and b.rank = s.rank group by b.r, b.k
), taken as (
  select r, sum(taken)::bigint as taken, min(slot) as first_slot, max(slot) as last_slot from found group by r
)
select doc_id, size, source_size, target, coalesce(t.taken, 0)::bigint as taken, coalesce(first_slot, -1)::bigint as first_slot, coalesce(last_slot, -1)::bigint as last_slot
from line left join taken t on line.r = t.r
"""

def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select * from ranked where rank <= 20
"""


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read_table(spark, sf_dir, "documents"))


OP2_SQL = """
with d as (
  select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents
), w as (
  select r, i, md5(substr(x, 2 * i + 1, 800)) as h from (select r, x, unnest(range(0, len(x) // 2 - 399)) as i from d)
), again as (
  select r, i from (select r, i, count(*) over (partition by h) as c from w) where c > 1
), run as (
  select r, i, sum(new) over (partition by r order by i rows unbounded preceding) as g
  from (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as new from again)
), span as (
  select r, min(i) as a, max(i) + 400 as b from run group by r, g
), gap as (
  select r, coalesce(lag(b) over (partition by r order by a), 0) as p, a as q from span
  union all select r, max(b), null from span group by r
), kept as (
  select d.r, string_agg(substr(x, (2 * p + 1)::bigint, (2 * (coalesce(q, len(x) // 2) - p))::bigint), '' order by p) as x from gap join d on gap.r = d.r group by d.r
), sums as (
  select r, sum(b - a) as n_removed, count(*) as n_spans from span group by r
)
select doc_id, (len(d.x) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256
from d left join sums on d.r = sums.r left join kept on d.r = kept.r
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(read_table(spark, sf_dir, "documents"), n=4, percent=85).drop("row_key")


OP3_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(lower_az, '[^\x20\x09-\x0D]+') as w
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_az from documents)
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [list_aggregate(w, 'string_agg', ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i:i + 3], 'string_agg', ' '))) end as s
  from worded
), members as (
  select doc_id, len(s) as n, unnest(s) as m from sets
), shared as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
  from members a join members b on a.m = b.m and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by all
), links as (
  select a, b from shared where 100 * k >= 85 * (na + nb - k)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from sets
  union
  select r.a, l.b from reach r join both_ways l on r.b = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, r.component_id
from sets s join (select a, min(b) as component_id from reach group by a) r on s.doc_id = r.a
"""


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, read_table(spark, sf_dir, "labels")))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(read_table(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a, min(b) as component_id from reach group by a
)
select e.vec_id, (select count(*) from links where a = e.vec_id)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least on e.vec_id = least.a
"""


def planted_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of op8 over all vectors and a changed copy of every fifth, so that there are links to find."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    changed = F.transform("embedding", lambda x, i: (x.cast("double") * (1 + F.lit(0.3) * ((i + 1) % 3 - 1))).cast("float"))
    copies = rows.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), changed.alias("embedding"))
    return neighbours.near_duplicates(rows.union(copies))


PLANTED_SQL = (
    """
with recursive embeddings as (
  select vec_id, embedding from main.embeddings
  union all select vec_id + 1000000000, list_transform(embedding, lambda x, i: (x::double * (1 + 0.3::double * (i % 3 - 1)))::float) from main.embeddings where vec_id % 5 = 0
), """
    + OP8_SQL.split("with recursive ")[1]
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(read_table(spark, sf_dir, "conversations"))


OP11_SQL = """
with t as (
  select conv_id::bigint as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as x
  from conversations where conv_id is not null
), own as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, x) as i from t
), drawn as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 as h
  from (select distinct conv_id from t)
), parts as (
  select d.conv_id, 0 as part, i, x, length(text) as chars from drawn d join own on own.conv_id = d.base and i <= h
  union all select d.conv_id, 1, i, x, length(text) from drawn d join own on own.conv_id = d.conv_id and i > h
), seq as (
  select *, row_number() over (partition by conv_id order by part, i) as d from parts
), prefixes as (
  select conv_id, d, md5(string_agg(x, '') over (partition by conv_id order by d)) as p, chars from seq
  union all select conv_id, 0, '', 0 from drawn
), linked as (
  select *, lag(p) over (partition by conv_id order by d) as up, d = max(d) over (partition by conv_id) as is_end from prefixes
), nodes as (
  select p, d, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars, any_value(up) as up, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '') as ends from linked group by p, d
), kids as (
  select up, count(*) as n_children from nodes where up is not null group by up
), full_nodes as (
  select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids on n.p = kids.up
), subtree as (
  select a.p, count(*) filter (v.n_children = 0) as n_leaves, sum((v.n - 1) * v.chars) as saved from full_nodes v join prefixes a on a.conv_id = v.conv_id and a.d <= v.d group by a.p
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n::bigint as n_convs, n.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join subtree s on n.p = s.p left join nodes u on n.up = u.p
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(read_table(spark, sf_dir, "documents"))


OP12_SQL = """
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), k as (
  select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d
), c as (
  select *, len(w)::bigint as n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) as a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k
), cut as (
  select doc_id, t, n, form, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as s from c
)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from cut
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_repeats": op2_repeats,
    "op3_ngram_join": op3_ngram_join,
    "op4_mix_sources": op4_mix_sources,
    "op5_best_fit": op5_best_fit,
    "op6_quality": op6_quality,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_near_vectors": op8_near_vectors,
    "planted_near_vectors": planted_near_vectors,
    "op9_url_filter": op9_url_filter,
    "op10_personal_data": op10_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_license_scan": op13_license_scan,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op1_top_k": OP1_SQL, "op2_repeats": OP2_SQL, "op8_near_vectors": OP8_SQL, "planted_near_vectors": PLANTED_SQL, "op3_ngram_join": OP3_SQL, "op4_mix_sources": OP4_SQL, "op11_prefix_trie": OP11_SQL, "op12_fill_in_middle": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
