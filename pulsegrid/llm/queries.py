"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import embeddings, html, licenses, lines, mixing, neardup, packing, quality, tokens, warc
from .common import table


def op1_quality_rules(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"))


def op2_embedding_neardup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    """The mix in training order; positions in millionths of the schedule, null where nothing is taken."""
    plan = mixing.in_order(mixing.assign(table(spark, sf_dir, "documents")))
    millionths = lambda p: F.floor(p * 1000000).cast("long")
    positions = F.transform("copies", lambda c: millionths(c["position"]))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.get(positions, F.lit(0)).alias("first_at"), F.try_element_at(positions, F.lit(-1)).alias("last_at"))


def op7_line_dedup(spark, sf_dir):
    return lines.summary(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    captures = warc.round_trip(table(spark, sf_dir, "pages"))
    r = F.col("response")
    return captures.select("page_id", r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["warc_type"].alias("record_type"), r["refers_to"].cast("long").alias("refers_to"))


def op9_token_counts(spark, sf_dir):
    """Counts of every document before and after two edits in it: five characters
    replaced at a third of the text, and a remark put in at two thirds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    edit = lambda offset, removed, inserted: F.struct(offset.alias("offset"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(F.floor(n / 3), 5, " [edited] "), edit(F.floor(2 * n / 3), 0, "\n(see note 12)\n"))
    return tokens.count_tokens(docs.withColumn("edits", edits))


def op10_html_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict:
    found = {f.__name__: f for f in (op1_quality_rules, op2_embedding_neardup, op3_packing, op4_minhash_neardup, op5_license_scan, op6_mixing, op7_line_dedup, op8_warc, op9_token_counts, op10_html_text)}
    return found


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINE_SPLIT = r"string_split(text, chr(10))"

OP1 = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
b as (
  select doc_id, text, w, len(w)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines
  from d),
win as (
  select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as g
  from (select doc_id, w, unnest(range(1, n_words - 1)) as p from b where n_words >= 3)),
rep as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct q)::bigint as n_repeat_words from (select doc_id, unnest([p, p + 1, p + 2]) as q from rep) group by doc_id),
f as (
  select b.*, coalesce(n_repeat_words, 0) as n_repeat_words,
    (n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words) as base_failed,
    length(text) - length(replace(text, '!', '')) as bangs, length(text) - length(replace(text, chr(10), '')) as breaks,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as capitals,
    len(list_filter(w, lambda x: not regexp_matches(x, '\pL'))) as letterless
  from b left join cov using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words
    or 10 * n_dup_lines > 3 * (1 + breaks) or 10 * bangs > 3 * n_words or 2 * capitals > word_chars or 5 * letterless > n_words) as kept
from f
"""

OP2 = """
with recursive v as (
  select vec_id, label, embedding::double[] as x,
    label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
      and len(list_filter(embedding, lambda e: e <> 0)) > 0 as good
  from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where a.good and b.good and list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a, min(b) as component_id from reach group by a),
deg as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join comp on comp.a = vec_id left join deg on deg.a = vec_id
"""

OP6 = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as h from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rk from s),
w as (select *, case rk % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, (source_size * 3)::double as bound from r),
q as (select *, bound / weight as ratio from w),
lv as (
  select *, (sum(source_size::double) over () - coalesce(sum(bound) over (order by ratio, rk rows between unbounded preceding and 1 preceding), 0.0))
     / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, rk rows between unbounded preceding and 1 preceding), 0.0)) as level
  from q),
water as (select arg_min(level, (ratio, rk)) as lam from lv where level <= ratio),
t as (select source, source_size, rk, coalesce(least(lam * weight, bound), 0.0) as target from lv, water),
o as (
  select d.*, source_size, target, rk, coalesce(sum(size) over (partition by d.source order by h rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source),
c as (
  select *, case rk % 3 when 0 then -0.5 when 1 then 0.0 else 0.5 end::double as slope, list_filter([start, start + source_size, start + 2 * source_size],
    lambda a: size > 0 and a < round(target)::bigint and 2 * (round(target)::bigint - a) >= size) as a from o),
p as (
  select *, list_transform(a, lambda x: floor((case when slope = 0 then x::double / target
    else (sqrt((1 - slope) * (1 - slope) + 4 * slope * (x::double / target)) - (1 - slope)) / (2 * slope) end) * 1000000)::bigint) as spots from c)
select doc_id, size, source_size, target, (len(a) * size)::bigint as taken, spots[1] as first_at, spots[-1] as last_at from p
"""

OP7 = rf"""
with l as (
  select doc_id, text, unnest({_LINE_SPLIT}) as line, generate_subscripts({_LINE_SPLIT}, 1) as no from documents where text is not null),
n as (select *, row_number() over (order by doc_id, no) as id from l),
tok as (select distinct id, unnest(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+')) as w from n),
df as (select w, count(*) as f from tok group by w),
rk as (select id, w, row_number() over (partition by id order by f, w) as i, count(*) over (partition by id) as n from tok join df using (w)),
pre as (select * from rk where i <= n - ceil(0.8 * n - 1e-9) + 1),
cand as (select distinct a.id as early, b.id as late, a.n as na, b.n as nb from pre a join pre b on a.w = b.w and a.id < b.id and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
ver as (select early, late, any_value(na) + any_value(nb) as total, count(*) as shared from cand join tok x on x.id = early join tok y on y.id = late and y.w = x.w group by early, late),
gone as (select distinct late as id from ver where shared >= 0.8 * (total - shared) - 1e-9),
kept as (select n.*, gone.id is not null as is_gone from n left join gone using (id)),
agg as (select doc_id, count(*) as n_lines, sum(is_gone::int)::bigint as n_removed, coalesce(string_agg(line, chr(10) order by no) filter (not is_gone), '') as t from kept group by doc_id)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, case when d.text is not null then md5(t) end as text_md5
from documents d left join agg using (doc_id)
"""

OP8 = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, octet_length(encode(body))::bigint as payload_bytes, upper(sha1(body)) as x from p),
b as (
  select page_id, payload_bytes, x,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(x, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1, 1)), '') as payload_digest
  from h),
m as (select *, max(page_id) over (partition by x) as last from b)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id <> last then last end as refers_to
from m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_embedding_neardup": OP2, "op6_mixing": OP6, "op7_line_dedup": OP7, "op8_warc": OP8}
