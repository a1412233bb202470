"""Registered queries of the subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.llm import pipeline as corpus_pipeline
from routelab.llm.audit import audit_filters
from routelab.llm.common import scratch, table
from routelab.llm.exact_dedup import exact_duplicates
from routelab.llm.jaccard import near_duplicates
from routelab.llm.merkle import fingerprint_edits
from routelab.llm.mixing import mix
from routelab.llm.negatives import hard_negatives
from routelab.llm.quality import score_quality
from routelab.llm.repeats import cut_repeats
from routelab.llm.segment import encoding_digests
from routelab.llm.simple8b import document_index, write_ids
from routelab.llm.toxicity import score_toxicity
from routelab.llm.url_rules import RULES, judge_urls
from routelab.llm.vocabularies import vocabulary_path
from routelab.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_toxicity")
def op1_toxicity(spark, d):
    return score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op2_repeated_passages")
def op2_repeated_passages(spark, d):
    return cut_repeats(table(spark, d, "documents")).drop("spans")


@query("op3_merkle_fingerprint")
def op3_merkle_fingerprint(spark, d):
    return fingerprint_edits(table(spark, d, "documents"))


@query("op4_url_rules", r"""
with r as (select page_id, case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
rules(h, pre, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hits as (select p.page_id, p.host, p.path, h || pre as rule, verdict,
                row_number() over (partition by p.page_id order by length(h) desc nulls last, length(pre) desc nulls last) as rn
         from p left join rules on (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, pre))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hits where rn = 1
""")
def op4_url_rules(spark, d):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, d, "pages"), rules)


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark, d):
    return near_duplicates(table(spark, d, "documents"))


@query("op6_sentencepiece_draws")
def op6_sentencepiece_draws(spark, d):
    return encoding_digests(table(spark, d, "documents"), vocabulary_path("piece_bpe_32k.model"))


@query("op7_source_mix")
def op7_source_mix(spark, d):
    return mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_exact_dedup", r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
       doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from n
""")
def op8_exact_dedup(spark, d):
    return exact_duplicates(table(spark, d, "documents"))


@query("op10_quality")
def op10_quality(spark, d):
    return score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op9_simple8b_ids")
def op9_simple8b_ids(spark, d):
    path = scratch(spark, "token-ids")
    write_ids(table(spark, d, "documents"), path, vocabulary_path("word_bpe_49k.json"))
    return document_index(spark, path)


@query("op11_warc_archives", r"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
g as (select *, max(page_id) over (partition by body) as last from p)
select page_id, strlen(body)::bigint as payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 5 * (i // 4)::int + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1) for i in range(32)], 'string_agg', '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from g
""")
def op11_warc_archives(spark, d):
    path = scratch(spark, "warc")
    write_archives(table(spark, d, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_filter_audit", r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select part, doc_id, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by t))::int as fails from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
c as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from x left join l using (doc_id) group by 1, 2),
f as (select unnest(range(5))::int as f),
o as (select a.f as f1, b.f as f2, c.f as f3, d.f as f4, e.f as f5 from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select list_aggregate([substr('ABCDE', (i + 1)::int, 1) for i in [f1, f2, f3, f4, f5]], 'string_agg', '') as filter_order, step::int as step, [f1, f2, f3, f4, f5][step] as f,
                 coalesce(list_sum([(1 << i) for i in [f1, f2, f3, f4, f5][1:step - 1]]), 0)::int as earlier from o, range(1, 6) r(step)),
lines as (select part, filter_order, step, f, sum(case when fails & (earlier | (1 << f)) = 0 then n else 0 end)::bigint as kept,
                 sum(case when fails & earlier = 0 and fails & (1 << f) <> 0 then n else 0 end)::bigint as removed,
                 sum(case when fails & earlier <> 0 and fails & (1 << f) <> 0 then n else 0 end)::bigint as redundant,
                 sum(case when fails = (1 << f) then n else 0 end)::bigint as unique_fails,
                 sum(case when fails & earlier = 0 and fails & (1 << f) <> 0 then good else 0 end)::bigint as good_lost,
                 sum(case when fails & earlier = 0 and fails & (1 << f) <> 0 then toxic else 0 end)::bigint as toxic_lost
          from steps, c group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, f)::bigint as shapley from lines
""")
def op12_filter_audit(spark, d):
    return audit_filters(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op13_hard_negatives", r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, [floor(256 * x::double) for x in embedding] as v
           from embeddings where label is not null and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), embedding is not null)),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * score and score <= positive_score qualify rank <= 5
""")
def op13_hard_negatives(spark, d):
    label = F.col("label").cast("bigint")
    moved = table(spark, d, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)
