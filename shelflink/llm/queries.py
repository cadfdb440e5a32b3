"""The numbered queries over the driver tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, hard_negatives, html_render, language, licenses, mixing, ngram_jaccard, pieces, quality_pu, rules, secret_scan, simhash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP6 = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(doc_id::varchar) as digest from documents
), s as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source
), r as (
  select *, 3 * source_size as cap, (3 * source_size)::double / weight::double as ratio, sum(source_size) over () as budget from s
), l as (
  select *, row_number() over o as place,
    (budget::double - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
      / (sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following))::double as level
  from r window o as (order by ratio, source nulls last)
), f as (
  select min(place) as place, arg_min(level, place) as level from l where ratio >= level
), t as (
  select l.source, source_size, budget, case when f.place is null or l.place < f.place then cap::double else weight * f.level end as target from l, f
), c as (
  select d.*, t.source_size, t.target, t.budget, sum(size) over (partition by d.source order by digest, doc_id)::bigint as served
  from d join t on d.source is not distinct from t.source
), p as (
  select doc_id, size, budget, (served + e * source_size)::double / target as finish from c, (values (0), (1), (2)) as v(e) where size > 0
), u as (
  select finish, sum(size) over (order by finish) <= budget as fits from p
), k as (
  select max(finish) as cut from u where fits
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target, coalesce(size * (
  ((served)::double / target <= cut)::int + ((served + source_size)::double / target <= cut)::int
  + ((served + 2 * source_size)::double / target <= cut)::int), 0)::bigint as taken
from c, k
"""


@query("op6_mix_sources", _OP6)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row")
    ).drop("_row")


_OP10 = r"""
with d as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    string_split(coalesce(text, ''), chr(10)) as every
  from documents
), g as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)
), r as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g
), q as (
  select doc_id, count(distinct i + k) as n_repeat_words from r, (values (0), (1), (2)) as v(k) where n > 1 group by doc_id
), m as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    length(regexp_replace(body, '[^\p{Lu}]+', '', 'g')) * 10 > 6 * length(regexp_replace(body, '[^\p{L}]+', '', 'g')) as shouting,
    len(list_filter(every, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) * 10 > 9 * len(every) as bullets,
    len(list_filter(every, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) * 10 > 3 * len(every) as ellipsis,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 10 < 6 * len(w) as letters, len(lines) as n_lines
  from d left join q on d.doc_id = q.doc_id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > 3 * n_words or word_chars < 2 * n_words
    or word_chars > 20 * n_words or 10 * n_dup_lines > 5 * n_lines or shouting or bullets or ellipsis or letters) as kept
from m
"""


@query("op10_quality_rules", _OP10)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents")).drop("broken")


_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_OP7 = r"""
with d as (
  select doc_id, coalesce(source, '') as source, coalesce(text, '') as body from documents
), m as (
  select doc_id, source, body, 'assign' as kind, 0 as rank, 6 as least, regexp_extract_all(body, '@KEY@["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as m,
    regexp_extract_all(body, '@KEY@["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) as v, string_split_regex(body, '@KEY@["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as p from d
  union all select doc_id, source, body, 'access', 1, 20, regexp_extract_all(body, 'AKIA[A-Z0-9]+'), regexp_extract_all(body, 'AKIA[A-Z0-9]+'), string_split_regex(body, 'AKIA[A-Z0-9]+') from d
  union all select doc_id, source, body, 'hex', 2, 24, regexp_extract_all(body, '[0-9a-f]+'), regexp_extract_all(body, '[0-9a-f]+'), string_split_regex(body, '[0-9a-f]+') from d
  union all select doc_id, source, body, 'owned', 3, 20, regexp_extract_all(body, '[A-Za-z0-9+/_-]+'), regexp_extract_all(body, '[A-Za-z0-9+/_-]+'), string_split_regex(body, '[A-Za-z0-9+/_-]+') from d
), lengths as (
  select doc_id, source, kind, rank, least, unnest(m) as m, unnest(v) as v, unnest(p[1:len(m)]) as p, unnest(range(1, len(m) + 1)) as i from m
), placed as (
  select doc_id, source, kind, rank, v, length(v) >= least as long,
    (sum(length(p) + length(m)) over (partition by doc_id, kind order by i) - length(m))::int as s, (sum(length(p) + length(m)) over (partition by doc_id, kind order by i))::int as e
  from lengths
), base as (
  select * from placed where long and rank < 3
), extra as (
  select x.* from placed x where long and rank = 3 and length(translate(v, '0123456789', '')) <= length(v) - 4
    and length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 4
    and not exists (select 1 from base b where b.doc_id = x.doc_id and b.s < x.e and x.s < b.e)
), every as (
  select * from base union all select * from extra
), held as (
  select v, count(distinct source) as owners from every group by v
), judged as (
  select every.*, owners > 2 as example from every join held using (v) where rank < 3 or owners <= 2
), per as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, e, rank) filter (rank < 3), '') as b,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, e, rank) as spans,
    count(*) filter (not example) as n_live, count(*) filter (example) as n_example
  from judged group by doc_id
)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example
from d left join per using (doc_id)
""".replace("@KEY@", _KEY)


@query("op7_secret_scan", _OP7)
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_OP8 = r"""
with given(license, text) as (values @ROWS@
), words as (
  select license, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from given
), known as (
  select license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as t from words
), d as (
  select doc_id, coalesce(text, '') as body from documents
), units as (
  select doc_id, unnest(string_split(body, chr(10))) as u from d
  union all select doc_id, unnest(string_split_regex(body, '\n[^\p{L}\p{N}\n]*\n')) from d
  union all select doc_id, body from d
), split as (
  select doc_id, regexp_extract_all(lower(u), '[\p{L}\p{N}]+') as w from units
), sets as (
  select distinct doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as b from split where len(w) > 1
), near as (
  select doc_id, b, license, 2.0::double * len(list_intersect(b, t)) / (len(b) + len(t)) as dice from sets join known on len(b) <= len(t) * 1.5 and len(t) <= len(b) * 1.5
), first as (
  select doc_id, b, min((-dice, license)) as x from near where dice >= 0.8::double group by doc_id, b
), per as (
  select doc_id, min(x) as x, count(*) as n, string_agg(x[2] || ':' || (round(-x[1], 4)::decimal(5,4)), ',' order by x[2] || ':' || (round(-x[1], 4)::decimal(5,4))) as matches from first group by doc_id
)
select d.doc_id, x[2] as license, -x[1] as dice, coalesce(n, 0)::bigint as n_matches, coalesce(matches, '') as matches from d left join per using (doc_id)
""".replace("@ROWS@", ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, v in licenses.TEMPLATES.items() for t in v))


@query("op8_license_scan", _OP8)
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


_OP1 = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""


@query("op1_exact_dedup", _OP1)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract_text(table(spark, sf_dir, "pages"))


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_components(table(spark, sf_dir, "documents"), words=4, threshold=Fraction(85, 100)).drop("set_key", "text_hash", "root")


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_pu.score_documents(docs, quality_pu.train_or_prior(docs, table(spark, sf_dir, "labels")))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language.train(docs))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"), words=4, seed=42, bits=4)


_OP12 = r"""
with d as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || doc_id) as x from documents
), h as (
  select doc_id, body, u, len(u) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from h
), c as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix from f
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then body when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(body) as restored_sha256
from c
"""


@query("op12_fill_in_middle", _OP12)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(text).alias("restored_sha256"))


_OP13 = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, positive_id, (row_number() over w)::int as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify row_number() over w <= 10
"""


@query("op13_hard_negatives", _OP13)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)
