"""Queries over pair, negative and response sampling and source mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import training as T
from routelab.plans import views as V
from routelab.plans.catalog import query
from routelab.plans.queries_shapes import SAMPLES, samples

_RANKED = """, a AS (SELECT dataset_id, prompt, round(count(*) FILTER (score > 0) / count(*), 9) AS accuracy FROM dense GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, accuracy ORDER BY md5(concat_ws('|', '42', dataset_id, prompt)), prompt) AS rn FROM a)"""


@query("positive_pairs", "dense", _RANKED + """ SELECT x.dataset_id, x.accuracy, x.prompt AS anchor, y.prompt AS positive, CAST(y.rn - x.rn AS INT) AS "offset" FROM r x JOIN r y
 ON x.dataset_id = y.dataset_id AND x.accuracy = y.accuracy AND y.rn BETWEEN x.rn + 1 AND x.rn + 2""")
def _(spark, d):
    return T.positive_pairs(T.prompt_accuracy(T.to_prompt_models(V.dense(spark, d))), 2)


_OWN = _RANKED + """, c AS (SELECT x.dataset_id, x.prompt AS anchor, x.accuracy AS anchor_accuracy, y.prompt AS negative, y.accuracy AS negative_accuracy,
  row_number() OVER (PARTITION BY x.dataset_id, x.prompt ORDER BY round(abs(x.accuracy - y.accuracy), 9), y.accuracy, y.rn) - 1 AS pos, count(*) OVER (PARTITION BY x.dataset_id, x.prompt) AS total
  FROM r x JOIN r y ON x.dataset_id = y.dataset_id AND x.accuracy <> y.accuracy),
 k AS (SELECT DISTINCT dataset_id, anchor, total, least(8, total) AS k, CAST(ceil(total * 0.5) AS BIGINT) AS c1, CAST(ceil(total * CAST(0.8 AS DOUBLE)) AS BIGINT) AS c2 FROM c),
 st AS (SELECT dataset_id, anchor, total, k, s.s, CASE s.s WHEN 0 THEN 0 WHEN 1 THEN c1 ELSE c2 END AS lo, CASE s.s WHEN 0 THEN c1 WHEN 1 THEN c2 ELSE total END AS hi,
  CASE s.s WHEN 0 THEN CAST(floor(k * 0.5) AS BIGINT) WHEN 1 THEN CAST(floor(k * CAST(0.3 AS DOUBLE)) AS BIGINT) ELSE k - CAST(floor(k * 0.5) AS BIGINT) - CAST(floor(k * CAST(0.3 AS DOUBLE)) AS BIGINT) END AS want FROM k, (VALUES (0), (1), (2)) s(s)),
 tk AS (SELECT *, least(want, hi - lo) AS take, CASE WHEN hi > lo THEN CAST('0x' || substr(md5(concat_ws('|', '42', CAST(s AS VARCHAR), dataset_id, anchor)), 1, 15) AS BIGINT) % (hi - lo) ELSE 0 END AS start FROM st),
 own AS (SELECT dataset_id, anchor, s, j, lo + (start + j) % (hi - lo) AS pos FROM tk, range(8) x(j) WHERE j < take)"""
_NEG = _OWN + """ SELECT c.dataset_id, c.anchor, c.negative, c.anchor_accuracy, c.negative_accuracy FROM own JOIN c USING (dataset_id, anchor, pos)"""


@query("stratified_negatives", "dense", _NEG)
def _(spark, d):
    p = T.prompt_accuracy(T.to_prompt_models(V.dense(spark, d)))
    return T.stratified_negatives(p, p, 8).drop("slot")


@query("to_triplets", "dense", _OWN + """, ng AS (SELECT c.dataset_id, c.anchor, string_agg(c.negative || '@' || CAST(c.negative_accuracy AS VARCHAR), ',' ORDER BY s, j) AS negatives FROM own JOIN c USING (dataset_id, anchor, pos) GROUP BY ALL)
SELECT x.dataset_id AS channel, x.prompt AS anchor, y.prompt AS positive, negatives FROM r x JOIN r y ON x.dataset_id = y.dataset_id AND x.accuracy = y.accuracy AND y.rn = x.rn + 1
 LEFT JOIN ng ON ng.dataset_id = x.dataset_id AND ng.anchor = x.prompt""")
def _(spark, d):
    t = T.to_triplets(T.to_prompt_models(V.dense(spark, d)), 8, 1)
    return t.select("channel", F.col("messages")[0]["content"].alias("anchor"), F.col("positive_messages")[0]["content"].alias("positive"),
                    F.array_join(F.transform("negative_messages", lambda x: F.concat(x["content"], F.lit("@"), x["accuracy"].cast("string"))), ",").alias("negatives"))


@query("best_of_n", "", SAMPLES + """, cnt AS (SELECT id, count(*) AS c FROM sx GROUP BY 1), n1 AS (SELECT id, c, s.s, p.p FROM cnt, range(1, 4) s(s), range(1, 4) p(p)),
 pk AS (SELECT id, s, p, CAST('0x' || substr(md5(concat_ws('|', '42', CAST(id AS VARCHAR), 'm0', CAST(s AS VARCHAR), CAST(p AS VARCHAR), CAST(i AS VARCHAR))), 1, 15) AS BIGINT) % c + 1 AS i2 FROM n1, range(1, 4) x(i) WHERE i <= s),
 b AS (SELECT pk.id, s, p, max(n % 5) AS top, CAST(sum(n) AS BIGINT) AS tokens FROM pk JOIN sx ON sx.id = pk.id AND sx.i = pk.i2 GROUP BY ALL),
 f AS (SELECT b.id, s, p, tokens, min(i) AS ch FROM b JOIN sx ON sx.id = b.id AND sx.n % 5 = b.top GROUP BY ALL)
SELECT f.id, 'm0' AS model, CAST(s AS INT) AS size, CAST(p AS INT) AS rep, CAST(ch - 1 AS INT) AS chosen, CAST(n % 7 AS DOUBLE) AS oracle_score, tokens FROM f JOIN sx ON sx.id = f.id AND sx.i = ch""")
def _(spark, d):
    return T.best_of_n(samples(spark, d), 3, 3)


@query("mix_sources", "", """, d AS (SELECT min(d.doc_id) AS id, text AS prompt FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 1 GROUP BY text),
 b AS (SELECT min(item_id) AS id, text AS prompt FROM benchmark GROUP BY text)
SELECT 'docs/' || CAST(id AS VARCHAR) AS id, md5(prompt) AS prompt_md5 FROM (SELECT * FROM d ORDER BY md5(concat_ws('|', '1', 'docs', CAST(id AS VARCHAR))), id LIMIT 20)
UNION ALL SELECT 'bench/' || CAST(id AS VARCHAR), md5(prompt) FROM b""")
def _(spark, d):
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("prompt"), (F.col("toxic") == 1).alias("keep"))
    bench = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return T.mix_sources([("docs", docs), ("bench", bench)], [20, None]).select("id", F.md5("prompt").alias("prompt_md5"))
