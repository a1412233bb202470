"""Queries over splits, orderings, set operations and window-like labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import splits as P
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.plans.summary import summary_long


def split_cte(view: str, ratio: float, seed: int = 42, ood: str = "false") -> str:
    return f""", sp AS (SELECT dataset_id, prompt, NOT ({ood}) AND row_number() OVER (PARTITION BY dataset_id
  ORDER BY md5(concat_ws('|', '{seed}', dataset_id, prompt)), prompt)
  <= floor(count(*) OVER (PARTITION BY dataset_id) * CAST({ratio} AS DOUBLE)) AS is_train
 FROM (SELECT DISTINCT dataset_id, prompt FROM {view}))"""


@query("split_by_prompt", "recs", split_cte("recs", 0.8, ood="dataset_id = '5-LOW'")
       + " SELECT dataset_id, prompt, model_name, run_no, is_train FROM recs JOIN sp USING (dataset_id, prompt)")
def _(spark, d):
    s = P.split_by_prompt(V.recs(spark, d), 0.8, 42, ["5-LOW"])
    return s.select("dataset_id", "prompt", "model_name", "run_no", "is_train")


@query("split_by_record", "latest", """SELECT dataset_id, split, record_index, model_name, row_number() OVER (PARTITION BY dataset_id
 ORDER BY md5(concat_ws('|', '42', dataset_id, split, CAST(record_index AS VARCHAR), model_name)), split, record_index, model_name)
 <= floor(count(*) OVER (PARTITION BY dataset_id) * CAST(0.8 AS DOUBLE)) AS is_train FROM latest""")
def _(spark, d):
    return P.split_by_record(V.latest(spark, d)).select("dataset_id", "split", "record_index", "model_name", "is_train")


_EDGES = """, edges AS (SELECT dataset_id AS task_id, record_index, prompt AS query, model_name AS llm, score AS effect, cost FROM dense)"""


def edges(spark, d):
    return V.dense(spark, d).select(F.col("dataset_id").alias("task_id"), "record_index", F.col("prompt").alias("query"),
                                    F.col("model_name").alias("llm"), F.col("score").alias("effect"), "cost")


@query("split_sequential", "dense", _EDGES + """, q AS (SELECT task_id, record_index, row_number() OVER (PARTITION BY task_id ORDER BY record_index) AS rn,
 count(*) OVER (PARTITION BY task_id) AS n FROM (SELECT DISTINCT task_id, record_index FROM edges))
SELECT task_id, record_index, llm, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
 WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part
FROM edges JOIN q USING (task_id, record_index)""")
def _(spark, d):
    return P.split_sequential(edges(spark, d)).select("task_id", "record_index", "llm", "part")


@query("split_shuffled_80_10_10", "", """, q AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '1', CAST(doc_id AS VARCHAR))), doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM q""")
def _(spark, d):
    return P.split_shuffled_80_10_10(V.table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("candidate_ranks", "latest", """SELECT dataset_id, record_index, model_name, row_number() OVER (PARTITION BY dataset_id, split, record_index
 ORDER BY score DESC, model_name DESC) - 1 AS rank FROM latest""")
def _(spark, d):
    r = P.candidate_ranks(V.latest(spark, d), "score", ["dataset_id", "split", "record_index"], "model_name")
    return r.select("dataset_id", "record_index", "model_name", "rank")


_POINTS = """, pts AS (SELECT model_name AS series, CAST(record_index % 1000 AS DOUBLE) AS x, avg(score) AS accuracy,
 sum(CAST(round(cost * 1e9) AS BIGINT)) / 1e9 AS cost FROM recs GROUP BY ALL),
 st AS (SELECT series, 'accuracy' AS metric, x, (accuracy - lag(accuracy) OVER w) / (x - lag(x) OVER w) AS slope FROM pts WINDOW w AS (PARTITION BY series ORDER BY x)
  UNION ALL SELECT series, 'cost', x, (cost - lag(cost) OVER w) / (x - lag(x) OVER w) FROM pts WHERE cost > 0 WINDOW w AS (PARTITION BY series ORDER BY x)),
 s AS (SELECT * FROM st WHERE slope IS NOT NULL)"""


def _steps(spark, d):
    from routelab.functions.money import sum_money
    pts = V.recs(spark, d).groupBy(F.col("model_name").alias("series"), (F.col("record_index") % 1000).alias("x")).agg(
        F.avg("score").alias("accuracy"), sum_money("cost").alias("cost"))
    return P.slopes(pts, "x", ["accuracy", "cost"], ["series"], positive=["cost"])


@query("slopes", "recs", _POINTS + """ SELECT series, metric, x, round(slope, 10) AS slope FROM s""")
def _(spark, d):
    return rounded(_steps(spark, d), 10)


@query("slope_summary", "recs", _POINTS + """ SELECT series, metric, count(*) AS n, round(avg(slope), 6) AS mean_slope, round(stddev_pop(slope), 6) AS std_slope,
 round(max(slope), 6) AS max_slope, round(min(slope), 6) AS min_slope,
 CASE WHEN avg(slope) > 0 THEN 'increasing' WHEN avg(slope) < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM s GROUP BY ALL""")
def _(spark, d):
    return rounded(P.slope_summary(_steps(spark, d), ["series"]), 6)


@query("stable_points", "recs", _POINTS + """, d AS (SELECT series, metric, stddev_pop(slope) AS sd FROM s GROUP BY ALL)
SELECT series, metric, count(*) AS n_stable, min(x) AS stable_from, max(x) AS stable_to FROM s JOIN d USING (series, metric)
WHERE abs(slope) < 0.5 * sd GROUP BY ALL""")
def _(spark, d):
    return P.stable_points(_steps(spark, d), ["series"])


@query("dedup_prompts_capped", "", """, f AS (SELECT text AS prompt, lang AS dataset_id, doc_id FROM documents
 QUALIFY row_number() OVER (PARTITION BY text ORDER BY lang, doc_id) = 1)
SELECT dataset_id, doc_id AS record_index, md5(prompt) AS prompt_md5 FROM f QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY doc_id) <= 50""")
def _(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("lang").alias("dataset_id"), F.lit("test").alias("split"),
                                                 F.col("doc_id").alias("record_index"), F.col("text").alias("prompt"))
    return P.dedup_prompts_capped(docs, 50).select("dataset_id", "record_index", F.md5("prompt").alias("prompt_md5"))


@query("upsample_minority", "", """, ev AS (SELECT event_id, event_type = 'click' AS minor, event_type <> 'click' AS major FROM events),
 big AS (SELECT count(*) AS n FROM ev WHERE major), small AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM ev WHERE minor),
 draws AS (SELECT CAST(('0x' || substr(md5('42|' || CAST(g.i AS VARCHAR)), 1, 15)) AS BIGINT) % (SELECT count(*) FROM small) + 1 AS rn
  FROM (SELECT unnest(range((SELECT n FROM big))) AS i) g)
SELECT event_id FROM ev WHERE major UNION ALL SELECT event_id FROM draws JOIN small USING (rn)""")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", (F.col("event_type") != "click").alias("major"),
                                           (F.col("event_type") == "click").alias("minor"))
    return P.upsample_minority(e, "major", "minor", "event_id").select("event_id")


@query("normalize_cost_by_task", "dense", _EDGES + """ SELECT task_id, record_index, llm, round(CASE WHEN max(cost) OVER w > min(cost) OVER w
 THEN (cost - min(cost) OVER w) / (max(cost) OVER w - min(cost) OVER w) ELSE 0 END, 9) AS cost_norm FROM edges WINDOW w AS (PARTITION BY task_id)""")
def _(spark, d):
    return rounded(P.normalize_cost_by_task(edges(spark, d)).select("task_id", "record_index", "llm", "cost_norm"))


@query("tie_labels", "dense", _EDGES + """ SELECT task_id, record_index, llm, CAST(abs(effect - max(effect) OVER w) <= 1e-8 + 1e-5 * abs(max(effect) OVER w) AS INT) AS is_best
 FROM edges WINDOW w AS (PARTITION BY task_id, record_index)""")
def _(spark, d):
    return P.tie_labels(edges(spark, d).withColumnRenamed("effect", "utility")).select("task_id", "record_index", "llm", "is_best")


@query("cost_percentile", "dense", """, a AS (SELECT label % 8 AS cluster_id, model_name, CAST(round(cost * 1e9) AS BIGINT) AS c FROM dense),
 m AS (SELECT cluster_id, model_name, avg(c) AS mean_c FROM a GROUP BY ALL)
SELECT m.cluster_id, m.model_name, round(100.0 * count(*) FILTER (a.c < mean_c) / count(*), 9) AS cost_percentile FROM m JOIN a USING (cluster_id) GROUP BY ALL""")
def _(spark, d):
    return rounded(P.cost_percentile(V.dense(spark, d).withColumn("cluster_id", F.col("label") % 8)))


@query("rank_models_in_cluster", "dense", """, s AS (SELECT label % 8 AS cluster_id, model_name, avg(score) AS mean_score, count(*) AS n FROM dense GROUP BY ALL)
SELECT cluster_id, model_name, round(mean_score, 9) AS mean_score, n, row_number() OVER (PARTITION BY cluster_id ORDER BY mean_score DESC, model_name) AS rank FROM s""")
def _(spark, d):
    return rounded(P.rank_models_in_cluster(V.dense(spark, d).withColumn("cluster_id", F.col("label") % 8), V.MODELS).drop("mean_cost"))


# ordering, limits, sets

@query("order_by_dataset_index", "recs", "SELECT DISTINCT dataset_id, record_index FROM recs")
def _(spark, d):
    return P.order_by_dataset_index(V.recs(spark, d).select("dataset_id", "record_index").distinct())


@query("top_k_experts", "latest", """SELECT dataset_id, record_index, model_name, row_number() OVER (PARTITION BY dataset_id, record_index
 ORDER BY score DESC, model_name) AS rank FROM latest QUALIFY rank <= 2""")
def _(spark, d):
    t = P.top_k_experts(V.latest(spark, d).withColumnRenamed("score", "expert_score"), 2)
    return t.select("dataset_id", "record_index", "model_name", "rank")


@query("top_models_by_cost", "recs", """SELECT model_name, round(sum(CAST(round(cost * 1e9) AS BIGINT)) / 1e9, 9) AS total_cost,
 round(sum(CAST(round(cost * 1e9) AS BIGINT)) * 100.0 / (SELECT sum(CAST(round(cost * 1e9) AS BIGINT)) FROM recs), 9) AS share FROM recs
 GROUP BY model_name ORDER BY sum(CAST(round(cost * 1e9) AS BIGINT)) DESC, model_name LIMIT 5""")
def _(spark, d):
    return rounded(P.top_models_by_cost(V.recs(spark, d), 5))


@query("edges_sorted_by_split", "dense", _EDGES + split_cte("dense", 0.7) + """ SELECT task_id, record_index, llm, NOT is_train AS is_test
 FROM edges JOIN sp ON task_id = dataset_id AND query = prompt""")
def _(spark, d):
    test = P.split_by_prompt(V.dense(spark, d), 0.7).where("not is_train")
    keys = test.select(F.col("dataset_id").alias("task_id"), "record_index")
    return P.edges_sorted_by_split(edges(spark, d), keys).select("task_id", "record_index", "llm", "is_test")


@query("demo_limit", "", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def _(spark, d):
    return P.demo_limit(V.table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 10)


@query("union_splits", "", "SELECT doc_id AS item_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def _(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return P.union_splits(docs, V.table(spark, d, "benchmark").select("item_id", "text"))


@query("ood_only_tasks", "runs", """SELECT DISTINCT model_name || '/' || dataset_id AS task_id FROM runs WHERE split <> 'P'
 EXCEPT SELECT model_name || '/' || dataset_id FROM runs WHERE split = 'P' AND demo""")
def _(spark, d):
    r = V.runs(spark, d).withColumn("task_id", F.concat_ws("/", "model_name", "dataset_id"))
    return P.ood_only_tasks(r.where("split = 'P' and demo"), r.where("split <> 'P'"))


@query("merge_splits_long", "dense", split_cte("dense", 0.7, ood="dataset_id = 'fr'") + """,
 w AS (SELECT dataset_id AS task, CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, record_index, prompt, model_name, score FROM dense JOIN sp USING (dataset_id, prompt)),
 q AS (SELECT part, task, record_index, row_number() OVER (PARTITION BY part ORDER BY task, record_index) - 1 AS global_index FROM (SELECT DISTINCT part, task, record_index FROM w))
SELECT CASE WHEN task = 'fr' THEN 'ood' ELSE part END AS target, global_index, task, prompt AS question, model_name, score, CAST(score > 0 AS INT) AS is_correct
FROM w JOIN q USING (part, task, record_index)""")
def _(spark, d):
    from routelab.operators.shapes import to_question_scores
    s = P.split_by_prompt(V.dense(spark, d), 0.7, 42, ["fr"])
    parts = [to_question_scores(s.where(F.col("is_train") == flag), V.MODELS).withColumn("part", F.lit(name))
             for flag, name in ((True, "train"), (False, "test"))]
    wide = P.union_splits(*parts).select(F.col("dataset").alias("task"), "part", "index", "question", "scores")
    return P.merge_splits_long(wide)


@query("available_vs_requested", "recs", """SELECT * FROM (VALUES ('m1'), ('m8'), ('m9')) t(model_name) WHERE model_name NOT IN (SELECT model_name FROM recs)""")
def _(spark, d):
    return P.available_vs_requested(V.recs(spark, d), ["m8", "m1", "m9"])


_TEST_SPLIT = split_cte("latest", 0.8) + """, t AS (SELECT latest.* FROM latest JOIN sp USING (dataset_id, prompt) WHERE NOT is_train),
 c AS (SELECT dataset_id || '/' || split AS key, model_name, avg(score) AS a FROM t GROUP BY ALL)
SELECT model_name AS row_name, key AS column_name, round(a, 9) AS value FROM c"""


@query("summary_test_mode", "latest", _TEST_SPLIT)
def _(spark, d):
    s = summary_long(V.latest(spark, d), test_mode=True)
    return rounded(s.where("section = 'main' and metric = 'performance' and column_name like '%/%'").select(
        "row_name", "column_name", "value"))
