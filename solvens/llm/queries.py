"""The registered queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvens.llm import exact_dedup, filter_audit, html_extract, lsh_forest, ngram_join, packing, quality, sentencepiece_bpe, suffix_dedup, topk, toxicity, url_rules, vector_codes
from solvens.llm.common import table
from solvens.session import ship_package

#: Rules of the query on urls: host and path, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.token_digests(docs, tokenizer_path()).drop("text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, is_query=F.col("vec_id") % 50 == 0)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text`` is what is left without passages of more than 50 words that occur again, too; the other columns are of 400 bytes only."""
    return suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"), besides=(suffix_dedup.PASSAGES,))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {
    q.__name__: _shipped(q)
    for q in [
        op1_html,
        op2_packing,
        op3_near_dedup,
        op4_sentencepiece,
        op5_quality,
        op6_exact_dedup,
        op7_topk,
        op8_suffix_dedup,
        op9_url_filter,
        op10_toxicity,
        op11_vector_codes,
        op12_filter_audit,
        op13_ngram_join,
    ]
}

#: One round on codebooks ``b`` and parts ``p``: the nearest entry of each part, then the floored means.
CODE_ROUND = """
n{i} as (
  select vec_row, part, min_by(entry, (d, entry)) as entry from (
    select p.vec_row, p.part, b.entry,
           list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from p join b{i} b on b.part = p.part) group by vec_row, part),
m{i} as (
  select part, entry, list(x order by place) as x from (
    select part, entry, place, cast(floor(sum(c) / count(*)) as bigint) as x from (
      select n.part, n.entry, unnest(p.x) as c, generate_subscripts(p.x, 1) as place
      from n{i} n join p on p.vec_row = n.vec_row and p.part = n.part) group by part, entry, place) group by part, entry),
b{j} as (select b.part, b.entry, coalesce(m.x, b.x) as x from b{i} b left join m{i} m on m.part = b.part and m.entry = b.entry),"""

ORACLES = {
    "op6_exact_dedup": r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op7_topk": r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, v.vec_id,
         cast(coalesce(list_sum(list_transform(list_zip(q.c, v.c), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5""",
    "op9_url_filter": r"""
with r as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc) as place
  from s left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from m where place = 1""",
    "op11_vector_codes": r"""
with v as (
  select row_number() over (order by vec_id, embedding) as vec_row, vec_id, label,
         list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as c from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_row, part, c[part * (len(c) // 4) + 1:(part + 1) * (len(c) // 4)] as x from v, range(4) r(part)),
b0 as (select part, vec_row - 1 as entry, x from p where vec_row <= 256),"""
    + "".join(CODE_ROUND.format(i=i, j=i + 1) for i in range(4))
    + r"""
f as (
  select vec_row, part, min_by(entry, (d, entry)) as entry, min(d) as d from (
    select p.vec_row, p.part, b.entry,
           list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from p join b4 b on b.part = p.part) group by vec_row, part),
e as (
  select vec_row, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, cast(sum(d) as bigint) as error from f group by vec_row),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b4)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from v join e using (vec_row), h""",
    "op12_filter_audit": r"""
with t as (
  select doc_id, coalesce(text, '') as text, coalesce(source, '') as part,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         (case when len(words) < 50 then 1 else 0 end)
         + (case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end)
         + (case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) then 4 else 0 end)
         + (case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end)
         + (case when t.doc_id > min(t.doc_id) over (partition by text) then 16 else 0 end) as mask
  from t left join l on t.doc_id = l.doc_id),
m as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, mask),
v(name, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from v a, v b, v c, v d, v e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (
  select filter_order, cast(step as integer) as step, bits[step] as bit, cast(list_sum(bits[1:step - 1]) as integer) as earlier
  from o, range(1, 6) r(step)),
c as (
  select part, filter_order, step, bit,
         sum(case when mask & (coalesce(earlier, 0) | bit) = 0 then n else 0 end) as kept,
         sum(case when mask & coalesce(earlier, 0) = 0 and mask & bit > 0 then n else 0 end) as removed,
         sum(case when mask & coalesce(earlier, 0) > 0 and mask & bit > 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & coalesce(earlier, 0) = 0 and mask & bit > 0 then good else 0 end) as good_lost,
         sum(case when mask & coalesce(earlier, 0) = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from m, s group by part, filter_order, step, bit)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley from c""",
}
