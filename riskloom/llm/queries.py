"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ann, bpe, chat, filters, licenses, minhash, mixing, phrases, quality, rules, secrets, simhash, suffix
from riskloom.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document once for each of its copies; shares go with the root of source size."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", F.col("__copy").alias("copy_no"))


ORACLE["op4_mix_sources"] = """
with sized as (select source, sum(coalesce(length(text), 0) + 1)::double as held from documents group by source),
total as (select sum(held) as held, sum(pow(held, 0.5)) as want from sized),
rates as (select s.source, pow(s.held, 0.5) * (t.held / t.want) / s.held as rate from sized s, total t),
parted as (select source, greatest(ceil(rate / 400), 1)::int as parts, rate / greatest(ceil(rate / 400), 1) as mean from rates),
terms as (select source, parts, k, exp(-mean + case when k = 0 then 0 else k * ln(mean) end - lgamma(k + 1.0)) as term
  from (select *, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 30)::int + 1)) as k from parted)),
tables as (select source, parts, list(c order by k) as cdf from
  (select source, parts, k, sum(term) over (partition by source order by k) as c from terms) group by source, parts),
drawn as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, t.cdf,
  unnest(range(1, t.parts + 1)) as part from documents d join tables t on d.source is not distinct from t.source),
counted as (select doc_id, text, lang, source, n_chars, sum(len(list_filter(cdf, lambda c:
  c <= ('0x' || substr(md5(concat_ws('|', '42', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')), part::varchar)), 1, 13))::bigint
       / 4503599627370496.0))) as n
  from drawn group by all)
select doc_id, source, lang, n_chars, text, unnest(range(1, n::int + 1))::int as copy_no from counted
"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    decoded = bpe.decode(encoded, path, pattern)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_turns(read(spark, sf_dir, "conversations"))


ORACLE["op9_chat_format"] = """
with recursive said as (
  select conv_id, turn, role, text, case when role = 'user' then turn else turn - 1 end as id from conversations where role in ('user', 'assistant')),
told as (select conv_id, turn, role, text, id, count(*) as n from said group by all),
used as (
  select *, dense_rank() over (partition by conv_id, role, id order by turn, text nulls first) as use from told),
linked as (
  select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.id, b.id) as id, coalesce(a.use, b.use) as use,
    a.turn as call_turn, a.text, b.turn as reply_turn, b.text as reply, coalesce(a.n, 0) as n_calls, coalesce(b.n, 0) as n_results,
    a.conv_id is not null as asked, b.conv_id is not null as answered
  from (select * from used where role = 'user') a full join (select * from used where role = 'assistant') b
    on a.conv_id = b.conv_id and a.id = b.id and a.use = b.use),
placed as (
  select l.*, asked and exists (select 1 from linked p where p.conv_id = l.conv_id and p.use = 1 and p.id = l.id - 2) as has_back from linked l),
chain as (
  select conv_id, id, use, 0 as depth from placed where not has_back
  union all
  select p.conv_id, p.id, p.use, chain.depth + 1 from chain join placed p
    on p.conv_id = chain.conv_id and p.has_back and chain.use = 1 and p.id - 2 = chain.id)
select p.conv_id, p.id::varchar as call_id, coalesce(call_turn, reply_turn) as turn, depth::bigint as depth,
  case when not answered then 'no_result' when not asked then 'no_call' else 'linked' end as status,
  n_calls, n_results, case when asked then text is not null end as valid,
  to_json({'arguments': case when asked then {'text': text} end, 'call_id': p.id::varchar, 'depth': depth::bigint,
    'name': case when asked then 'reply' end, 'result': reply})::varchar as line, p.use::bigint as use
from placed p join chain on chain.conv_id = p.conv_id and chain.id = p.id and chain.use = p.use
union all
select conv_id, null, turn, null, 'message', 0, 0, null, to_json({'content': text, 'role': role, 'turn': turn})::varchar, null
from conversations where role is null or role not in ('user', 'assistant')
"""


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"))


@query
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


ORACLE["op11_minhash"] = """
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
grams as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as g from split),
sets as (select dense_rank() over (order by list_sort(g)) as node, doc_id, g, len(g) as n from grams),
nodes as (select node, any_value(g) as g, any_value(n) as n from sets where n > 0 group by node),
members as (select node, n, unnest(g) as s from nodes),
shared as (
  select x.node as a, y.node as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as common
  from members x join members y on x.s = y.s and x.node < y.node
    and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by x.node, y.node),
links as (select a, b from shared where 100 * common >= 80 * (n + m - common)),
edges as (select a, b from links union select b, a from links),
reach as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
ids as (select node, min(doc_id) as first from sets where n > 0 group by node),
least_ids as (
  select i.node, least(min(i.first), min(j.first)) as component_id
  from ids i left join reach r on r.a = i.node left join ids j on j.node = r.b group by i.node),
grouped as (
  select s.doc_id, s.n::bigint as n_shingles, case when s.n = 0 then s.doc_id else l.component_id end as component_id
  from sets s left join least_ids l on l.node = s.node)
select doc_id, n_shingles, component_id, doc_id is not distinct from component_id as kept from grouped
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = """
with split as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
known as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
failed as (
  select part, coalesce(k.good, 0) as good, coalesce(k.toxic, 0) as toxic, {
    'A': len(w) < 100,
    'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(s.doc_id > min(s.doc_id) over (partition by text), false)} as f
  from split s left join known k on k.doc_id = s.doc_id),
cells as (select part, f, count(*) as c, sum(good) as good, sum(toxic) as toxic from failed group by part, f),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select filter_order, step, filter_order[step] as l, filter_order[1:step - 1] as before from orders, range(1, 6) t(step)),
hits as (
  select part, c, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: case x when 'A' then f.A when 'B' then f.B
    when 'C' then f.C when 'D' then f.D else f.E end) as fails from cells),
walked as (
  select part, filter_order, step, l, c, good, toxic, list_contains(fails, l) as fails_it, len(fails) as n_fails,
    len(list_filter(fails, lambda x: contains(before, x))) > 0 as gone from hits, steps),
counted as (
  select part, filter_order, step::int as step, l,
    sum(case when not gone and not fails_it then c else 0 end)::bigint as kept,
    sum(case when not gone and fails_it then c else 0 end)::bigint as removed,
    sum(case when gone and fails_it then c else 0 end)::bigint as redundant,
    sum(case when fails_it and n_fails = 1 then c else 0 end)::bigint as unique_fails,
    sum(case when not gone and fails_it then good else 0 end)::bigint as good_lost,
    sum(case when not gone and fails_it then toxic else 0 end)::bigint as toxic_lost
  from walked group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, l))::bigint as shapley from counted
"""


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLE["op13_phrase_mining"] = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
split as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
grams as (
  select lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as phrase
  from split, range(1, 5) t(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 30),
totals as (select lang, sum(len(w))::bigint as n from split group by lang),
many as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (
  select m.lang, m.phrase, m.a, cut, x.f as l, y.f as r, ((2000000::hugeint * m.a) // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, k)) as cut from many) m
  join f x on x.lang = m.lang and x.phrase = array_to_string(m.w[1:cut], ' ')
  join f y on y.lang = m.lang and y.phrase = array_to_string(m.w[cut + 1:], ' ')),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ones as (
  select lang, a, array_to_string(w[i:i + m - 1], ' ') as phrase
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from many where k > 2))),
over_ones as (select lang, phrase, max(a) as most from inner_ones group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank
  from scored s left join over_ones o on o.lang = s.lang and o.phrase = s.phrase
  where o.most is null or 100::hugeint * o.most < 80::hugeint * s.a)
select r.lang, rank::bigint as rank, r.phrase, r.a, r.l, r.r, t.n, r.score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""
