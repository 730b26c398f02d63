"""The queries ``opN_<name>`` and the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, embedding_dedup, fill_middle, minhash_forest, mixing, neighbours, packing, quality, suffix_dedup, token_counts, token_shards, toxicity
from .common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("times")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_token_output, op2_minhash_dedup, op3_token_counts, op4_toxicity, op5_packing, op6_suffix_dedup, op7_embedding_dedup, op8_quality, op9_neighbours, op10_mixing,
    op11_fill_middle, op12_divergence, op13_decontamination,
)}

SQL = {
    "op2_minhash_dedup": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
each as (select doc_id, unnest(s) as g, len(s) as n from sets),
links as (
  select x.doc_id as a, y.doc_id as b from each x join each y on x.g = y.g and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join (select a, min(b) as component_id from reach group by a) c on s.doc_id = c.a""",
    "op7_embedding_dedup": r"""
with recursive good as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select x.vec_id as a, y.vec_id as b from good x join good y
  on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))) >= 0.93),
reach as (
  select vec_id as a, vec_id as b from embeddings
  union select r.a, l.b from reach r join links l on r.b = l.a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a, min(b) as component_id from reach group by a) c on e.vec_id = c.a
left join (select a, count(*) as n from links group by a) n on e.vec_id = n.a""",
    "op10_mixing": r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, '')) || ':17') as k
  from documents),
by_source as (
  select source, cast(sum(size) as bigint) as source_size,
         cast(1 + (row_number() over (order by source nulls last) - 1) % 3 as double) as weight
  from sized group by source),
levels as (
  select *, 3.0::double * source_size as cap,
         ((select sum(source_size) from by_source)::double - coalesce(sum(3.0::double * source_size) over (
            order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as lev
  from by_source),
goals as (
  select source, source_size, least((select max(lev) from levels where lev * weight <= cap) * weight, cap) as target from levels),
parts as (
  select s.*, g.source_size, g.target,
         case when g.source_size > 0 then cast(floor(g.target / g.source_size) as bigint) else 0 end as whole,
         sum(s.size) over (partition by s.source order by s.k rows between unbounded preceding and current row) as upto
  from sized s join goals g on s.source is not distinct from g.source),
needs as (select *, target - whole * source_size as need from parts),
picked as (
  select *, need > 0 and (upto <= need or (upto - size < need and upto - need < need - (upto - size))) as extra from needs)
select doc_id, size, source_size, target, cast(size * (whole + case when extra then 1 else 0 end) as bigint) as taken
from picked""",
    "op11_fill_middle": r"""
with drawn as (
  select doc_id, coalesce(text, '') as t, cast(length(coalesce(text, '')) as bigint) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
cuts as (
  select doc_id, t, n, least(cast('0x' || h[1:8] as bigint) % (n + 1), cast('0x' || h[9:16] as bigint) % (n + 1)) as a,
         greatest(cast('0x' || h[1:8] as bigint) % (n + 1), cast('0x' || h[9:16] as bigint) % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 90 then 'plain'
              when cast('0x' || h[25:32] as bigint) % 100 < 20 then 'spm' else 'psm' end as form
  from drawn),
parts as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1, n - b) as suf from cuts)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from parts""",
    "op12_divergence": r"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
each as (select d, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as c from each group by lang, term having count(distinct d) >= 3),
cells as (select e.lang, e.source, e.term, count(*) as c from each e join kept k on e.lang = k.lang and e.term = k.term group by all),
groups as (select distinct lang, source from docs),
sizes as (select g.lang, g.source, coalesce(sum(c.c), 0)::hugeint as n from groups g left join cells c on c.lang = g.lang and c.source = g.source group by all),
langs as (select l.lang, count(k.term)::hugeint as v, coalesce(sum(k.c), 0)::hugeint as n from (select distinct lang from groups) l left join kept k on k.lang = l.lang group by all),
p as (select s.lang, s.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)::hugeint) // (s.n + l.v) as p,
    1 + (1000000000 * (k.c + 1)::hugeint) // (l.n + l.v) as q
  from sizes s join langs l on s.lang = l.lang join kept k on k.lang = s.lang left join cells c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select g.lang, g.source, h.source as item, coalesce(x.value, 0) as value from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
  on x.lang = g.lang and x.source = g.source and x.item = h.source),
terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from p where c > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 200)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked""",
    "op13_decontamination": r"""
with words as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (
  select distinct item, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0)),
grams as (
  select d, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select d, w, k, unnest(range(1, len(w) - k + 2)) as i from words cross join (select distinct k from wins) where len(w) >= k)),
met as (select g.d, g.i, g.k, w.item from grams g join wins w on g.g = w.g and g.k = w.k),
hit as (select d, count(distinct p) as n_hit from (select d, unnest(range(i, i + k)) as p from (select distinct d, i, k from met)) group by d),
named as (select d, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct d, item from met) group by d)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(n.n_items, 0) as n_items, sha256(coalesce(n.s, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from words w left join hit h on w.d = h.d left join named n on w.d = n.d""",
}
