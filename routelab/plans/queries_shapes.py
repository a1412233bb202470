"""Queries over reshaped facts: grids, ids, pairs, candidates, edges and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import shapes as G
from routelab.operators import stats as S
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.plans.queries_splits import split_cte

_GRID = """, g AS (SELECT q.dataset_id, q.prompt, q.record_index, m.model_name, l.score IS NULL AS filled, coalesce(l.score, 0.0) AS score,
  coalesce(l.cost, 0.0) AS cost, coalesce(l.prompt_tokens, 0) AS prompt_tokens, coalesce(l.completion_tokens, 0) AS completion_tokens
 FROM (SELECT dataset_id, prompt, min(record_index) AS record_index FROM latest GROUP BY ALL) q CROSS JOIN (SELECT DISTINCT model_name FROM latest) m
 LEFT JOIN latest l ON l.dataset_id = q.dataset_id AND l.prompt = q.prompt AND l.model_name = m.model_name)"""


@query("complete_grid", "latest", _GRID + """ SELECT dataset_id, prompt, record_index, model_name, filled, score, round(cost, 9) AS cost, prompt_tokens, completion_tokens FROM g""")
def _(spark, d):
    return rounded(G.complete_grid(V.latest(spark, d), models=V.MODELS))


@query("fill_report", "latest", _GRID + """ SELECT model_name, count(*) FILTER (filled) AS n_filled, count(*) AS n_cells FROM g GROUP BY 1
 HAVING count(*) FILTER (filled) > 0 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(spark, d):
    return S.fill_report(G.complete_grid(V.latest(spark, d), models=V.MODELS))


@query("encode_ids", "recs", """SELECT prompt, prompt_id, count(*) AS n FROM (SELECT prompt, dense_rank() OVER (ORDER BY prompt) - 1 AS prompt_id FROM recs) GROUP BY ALL""")
def _(spark, d):
    return G.encode_ids(V.recs(spark, d).select("prompt"), "prompt").groupBy("prompt", "prompt_id").agg(F.count("*").alias("n"))


@query("to_label_grid", "dense", """SELECT dense_rank() OVER (ORDER BY prompt) - 1 AS prompt_id, CAST(substr(model_name, 2) AS BIGINT) AS model_id,
 dataset_id AS category_id, score AS label, model_name, dataset_id AS category, prompt FROM dense""")
def _(spark, d):
    return G.to_label_grid(V.dense(spark, d))


@query("to_wide_prompts", "latest", _GRID + """ SELECT dataset_id AS dataset, prompt AS query, record_index AS index,
 string_agg(model_name || '=' || CAST(score AS VARCHAR), ',' ORDER BY model_name) AS records,
 CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM g GROUP BY ALL""")
def _(spark, d):
    w = G.to_wide_prompts(V.latest(spark, d), V.MODELS)
    zero = F.lit(0).cast("bigint")
    return w.select("dataset", "query", "index",
                    F.concat_ws(",", F.transform(F.map_entries("records"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("records"),
                    F.aggregate(F.map_values("usages"), zero, lambda a, u: a + u["prompt_tokens"]).alias("prompt_tokens"),
                    F.aggregate(F.map_values("usages"), zero, lambda a, u: a + u["completion_tokens"]).alias("completion_tokens"))


@query("to_question_scores", "latest", _GRID + """ SELECT dataset_id AS dataset, record_index AS index, prompt AS question, sum(score) AS total_score, count(*) AS n_models FROM g GROUP BY ALL""")
def _(spark, d):
    q = G.to_question_scores(V.latest(spark, d), V.MODELS)
    return q.select("dataset", "index", "question",
                    F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x).alias("total_score"),
                    F.size("scores").cast("bigint").alias("n_models"))


def descriptions(spark, d):
    return V.table(spark, d, "documents").select(F.col("lang").alias("task_id")).distinct().select(
        "task_id", F.concat(F.lit("questions in "), F.col("task_id")).alias("task_description"), F.lit("accuracy").alias("metric"))


@query("lookup_descriptions", "", """SELECT doc_id, lang AS task_id, 'questions in ' || lang AS task_description, 'accuracy' AS metric FROM documents""")
def _(spark, d):
    return G.lookup_descriptions(V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("task_id")), descriptions(spark, d), "task_id")


@query("to_edges", "dense", split_cte("dense", 0.7) + """ SELECT dataset_id AS task_id, prompt AS query, record_index, model_name AS llm, score AS effect,
 round(cost, 9) AS cost_usd, round((cost - min(cost) OVER w) / (max(cost) OVER w - min(cost) OVER w), 9) AS cost, NOT is_train AS is_test,
 'questions in ' || dataset_id AS task_description, 'accuracy' AS metric FROM dense JOIN sp USING (dataset_id, prompt) WINDOW w AS (PARTITION BY dataset_id)""")
def _(spark, d):
    return rounded(G.to_edges(V.dense(spark, d), descriptions(spark, d)))


_PAIRS = """ SELECT a.dataset_id, a.prompt, q.record_index, a.model_name AS model_a, b.model_name AS model_b, a.score AS score_model_a, round(a.cost, 9) AS cost_model_a,
  b.score AS score_model_b, round(b.cost, 9) AS cost_model_b, a.score = b.score AS is_tie,
  CASE WHEN a.score = b.score THEN 'tie' WHEN a.score > b.score THEN 'model_a' ELSE 'model_b' END AS winner
 FROM {v} a JOIN {v} b ON a.dataset_id = b.dataset_id AND a.prompt = b.prompt
 JOIN (SELECT dataset_id, prompt, min(record_index) AS record_index FROM {v} GROUP BY ALL) q ON q.dataset_id = a.dataset_id AND q.prompt = a.prompt
 WHERE a.model_name = 'm7' AND b.model_name = 'm2'"""


@query("pair_models", "latest", _PAIRS.format(v="latest"))
def _(spark, d):
    return rounded(G.pair_models(V.latest(spark, d), "m7", "m2", True))


@query("pair_models_decisive", "latest", _PAIRS.format(v="latest") + " AND a.score <> b.score")
def _(spark, d):
    return rounded(G.pair_models(V.latest(spark, d), "m7", "m2", False))


_TO_PAIRS = split_cte("latest", 0.8) + """, s AS (SELECT latest.*, is_train FROM latest JOIN sp USING (dataset_id, prompt)),
 p AS (""" + _PAIRS.format(v="s").replace("SELECT a.dataset_id", "SELECT a.is_train, a.dataset_id") + """ AND NOT (a.is_train AND a.score = b.score)),
 ids AS (SELECT dataset_id, prompt, record_index, row_number() OVER (ORDER BY dataset_id, record_index, prompt) - 1 AS idx FROM p)"""


@query("to_pairs_train", "latest", _TO_PAIRS + " SELECT idx, p.dataset_id, p.prompt, score_model_a, score_model_b, winner FROM p JOIN ids USING (dataset_id, prompt) WHERE is_train")
def _(spark, d):
    return G.to_pairs(V.latest(spark, d), "m7", "m2")[0].select("idx", "dataset_id", "prompt", "score_model_a", "score_model_b", "winner")


@query("to_pairs_test", "latest", _TO_PAIRS + " SELECT idx, p.dataset_id, p.prompt, score_model_a, score_model_b, winner FROM p JOIN ids USING (dataset_id, prompt) WHERE NOT is_train")
def _(spark, d):
    return G.to_pairs(V.latest(spark, d), "m7", "m2")[1].select("idx", "dataset_id", "prompt", "score_model_a", "score_model_b", "winner")


@query("prune_pairs", "latest", _TO_PAIRS + " SELECT dataset_id, prompt, record_index, idx FROM ids")
def _(spark, d):
    return G.to_pairs(V.latest(spark, d), "m7", "m2")[2]


@query("check_pair_coverage", "latest", """, both_ AS (SELECT dataset_id, prompt FROM latest WHERE model_name IN ('m7', 'm2') GROUP BY ALL HAVING count(DISTINCT model_name) = 2)
SELECT dataset_id, prompt FROM both_ b WHERE EXISTS (SELECT 1 FROM latest x, latest y WHERE x.prompt = b.prompt AND y.prompt = b.prompt AND x.dataset_id = b.dataset_id
 AND y.dataset_id = b.dataset_id AND x.model_name = 'm7' AND y.model_name = 'm2' AND x.score = y.score)""")
def _(spark, d):
    r = V.latest(spark, d)
    return G.check_pair_coverage(r, G.pair_models(r, "m7", "m2", False), "m7", "m2")


def _with_text(spark, d):
    return V.latest(spark, d).withColumn("prediction", F.concat(F.lit("answer of "), F.col("model_name"))).withColumn(
        "ground_truth", F.concat(F.lit("truth "), F.col("record_index").cast("string")))


@query("to_candidates", "latest", """, q AS (SELECT DISTINCT dataset_id, prompt, record_index FROM latest)
SELECT q.dataset_id || '/' || CAST(q.record_index AS VARCHAR) AS id, q.prompt AS input, 'truth ' || CAST(q.record_index AS VARCHAR) AS output,
 'm2' AS model_1, CASE WHEN a.score IS NULL THEN '' ELSE 'answer of m2' END AS text_1, coalesce(a.score, 0.0) AS score_1, coalesce(a.prompt_tokens, 0) AS tokens_1,
 'm7' AS model_2, coalesce(b.score, 0.0) AS score_2, round(coalesce(b.cost, 0.0), 9) AS cost_2
FROM q LEFT JOIN latest a ON a.dataset_id = q.dataset_id AND a.record_index = q.record_index AND a.model_name = 'm2'
 LEFT JOIN latest b ON b.dataset_id = q.dataset_id AND b.record_index = q.record_index AND b.model_name = 'm7'""")
def _(spark, d):
    c = G.to_candidates(_with_text(spark, d), ["m2", "m7"])
    a, b = F.col("candidates")[0], F.col("candidates")[1]
    return rounded(c.select("id", "input", "output", a["model"].alias("model_1"), a["text"].alias("text_1"),
                            a["scores"]["bartscore"].alias("score_1"), a["token_num_prompt"].alias("tokens_1"), b["model"].alias("model_2"),
                            b["scores"]["bartscore"].alias("score_2"), b["cost"][0].alias("cost_2")))


@query("filter_candidates", "dense", """SELECT record_index AS id, 'm5,m1' AS models, string_agg(CAST(score AS VARCHAR), ',' ORDER BY model_name DESC) AS scores FROM dense
 WHERE model_name IN ('m1', 'm5') GROUP BY record_index""")
def _(spark, d):
    c = V.dense(spark, d).groupBy(F.col("record_index").alias("id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("model_name").alias("model"), F.lit("greedy").alias("decoding_method"), "score"))).alias("candidates"))
    f = G.filter_candidates(c, ["m5", "m1"])
    return f.select("id", F.concat_ws(",", "candidates.model").alias("models"),
                    F.concat_ws(",", F.transform("candidates.score", lambda x: x.cast("string"))).alias("scores"))


@query("format_window", "dense", """SELECT record_index AS id, model_name AS model, repeat(CAST(score AS VARCHAR) || ',', 9) || CAST(score AS VARCHAR) AS scores,
 CAST(10 * (CASE WHEN model_name = 'm1' THEN 2 ELSE 1 END * prompt_tokens + CASE WHEN model_name = 'm1' THEN 4 ELSE 3 END * completion_tokens) AS DOUBLE) AS cost FROM dense""")
def _(spark, d):
    c = V.dense(spark, d).select(F.col("record_index").alias("id"), F.col("model_name").alias("model"),
                                 F.lit(None).cast("array<double>").alias("scores"), "score", F.col("prompt_tokens").alias("token_num_prompt"),
                                 F.lit(None).cast("array<double>").alias("response_tokens"), F.col("completion_tokens").alias("response_token"))
    w = G.format_window(c, [("m1", 2.0, 4.0), ("m", 1.0, 3.0)])
    return rounded(w.select("id", "model", F.concat_ws(",", F.transform("scores", lambda x: x.cast("string"))).alias("scores"),
                            F.aggregate("cost", F.lit(0.0), lambda a, x: a + x).alias("cost")))


@query("merge_responses", "dense", """SELECT record_index AS id, string_agg(model_name || ':' || CAST(score AS VARCHAR), ',' ORDER BY model_name) AS responses FROM dense GROUP BY ALL""")
def _(spark, d):
    r = V.dense(spark, d).select(F.col("record_index").alias("id"), F.col("model_name").alias("model"), F.col("score").cast("string").alias("response"))
    m = G.merge_responses(r.where("model = 'm0'"), [r.where(F.col("model") == x) for x in V.MODELS[1:]])
    return m.select("id", F.concat_ws(",", F.transform(F.map_entries("responses"), lambda e: F.concat_ws(":", e["key"], e["value"]))).alias("responses"))


@query("join_rule_and_fewshot", "", """, shots AS (SELECT p_partkey % 25 AS rule_id, p_partkey AS shot_no, p_name AS question, p_brand AS answer FROM part),
 s AS (SELECT rule_id, string_agg(question || chr(10) || answer, chr(10) ORDER BY shot_no) AS shots FROM shots GROUP BY 1)
SELECT c_custkey AS item_id, md5(n_name || chr(10) || shots || chr(10) || c_name) AS formatted_md5 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN s ON rule_id = c_nationkey""")
def _(spark, d):
    items = V.table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").cast("bigint").alias("rule_id"), F.col("c_name").alias("question"))
    rules = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("rule_id"), F.col("n_name").alias("rule_content"))
    shots = V.table(spark, d, "part").select((F.col("p_partkey") % 25).alias("rule_id"), F.col("p_partkey").alias("shot_no"),
                                             F.col("p_name").alias("question"), F.col("p_brand").alias("answer"))
    return G.digest_rule_and_fewshot(items, rules, shots).select("item_id", "formatted_md5")


@query("join_baseline_answers", "", """, s AS (SELECT * FROM (VALUES ('hard_prompt', 'm1'), ('AUTOMOBILE', 'm2')) t(category, baseline)),
 i AS (SELECT c_custkey AS uid, c_mktsegment AS category, coalesce(s.baseline, 'm1') AS baseline FROM customer LEFT JOIN s ON s.category = c_mktsegment),
 a AS (SELECT s_suppkey AS uid, 'm' || CAST(s_suppkey % 3 AS VARCHAR) AS model, s_name AS answer FROM supplier)
SELECT i.uid, i.category, i.baseline, a.answer AS baseline_answer, a.answer IS NOT NULL AS has_baseline FROM i LEFT JOIN a ON a.uid = i.uid AND a.model = i.baseline""")
def _(spark, d):
    items = V.table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("category"))
    settings = spark.createDataFrame([("hard_prompt", "m1"), ("AUTOMOBILE", "m2")], "category string, baseline string")
    answers = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("uid"), F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("model"),
                                                   F.col("s_name").alias("answer"))
    return G.join_baseline_answers(items, settings, answers)


@query("to_prompt_models", "latest", """SELECT dataset_id, prompt, min(record_index) AS record_index, string_agg(model_name || CASE WHEN score > 0 THEN '+' ELSE '-' END, '' ORDER BY model_name) AS models
FROM latest GROUP BY dataset_id, prompt""")
def _(spark, d):
    p = G.to_prompt_models(V.latest(spark, d))
    return p.select("dataset_id", "prompt", "record_index", F.array_join(F.transform("models", lambda m: F.concat(
        m["model_name"], F.when(m["correct"], "+").otherwise("-"))), "").alias("models"))


@query("split_difficulty", "latest", """SELECT dataset_id, prompt, CASE WHEN bool_and(score > 0) THEN 'all_correct' WHEN NOT bool_or(score > 0) THEN 'all_error' ELSE 'normal' END AS difficulty
FROM latest GROUP BY dataset_id, prompt""")
def _(spark, d):
    return G.split_difficulty(G.to_prompt_models(V.latest(spark, d))).select("dataset_id", "prompt", "difficulty")


@query("positives_negatives", "dense", """, r AS (SELECT dataset_id, record_index, model_name, score, row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY score DESC, model_name) AS up,
 row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY score, model_name) AS down FROM dense)
SELECT dataset_id AS dataset, record_index AS index, coalesce(string_agg(model_name, ',' ORDER BY up) FILTER (up <= 3 AND score > 0), '') AS positives,
 coalesce(string_agg(model_name, ',' ORDER BY down) FILTER (down <= 3 AND score <= 0.5), '') AS negatives FROM r GROUP BY ALL""")
def _(spark, d):
    p = G.positives_negatives(G.to_question_scores(V.dense(spark, d), V.MODELS), 3, 3)
    return p.select("dataset", "index", F.concat_ws(",", "positives").alias("positives"), F.concat_ws(",", "negatives").alias("negatives"))


def samples(spark, d):
    """Sampled responses per (conversation, model): every recorded turn of the conversation."""
    c = V.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "conv_id", "turn", F.length("text").alias("n"), F.md5("text").alias("h"))
    r = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "n", "h"))).alias("x"))
    return r.select("id", F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"), F.lit("m0").alias("model"),
                    F.transform("x", lambda s: s["h"]).alias("responses"), F.transform("x", lambda s: (s["n"] % 7).cast("double")).alias("scores"),
                    F.transform("x", lambda s: (s["n"] % 5).cast("double")).alias("proxy_scores"),
                    F.transform("x", lambda s: (s["n"] % 7).cast("double")).alias("oracle_scores"),
                    F.transform("x", lambda s: s["n"].cast("bigint")).alias("token_num_responses"))


SAMPLES = """, sx AS (SELECT conv_id AS id, md5(text) AS h, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text), md5(text)) AS i,
  count(*) OVER (PARTITION BY conv_id) AS cnt FROM conversations)"""


@query("preference_pairs", "", SAMPLES + """, so AS (SELECT id, h, n % 7 AS s, cnt, row_number() OVER (PARTITION BY id ORDER BY n % 7, i) AS r FROM sx),
 k AS (SELECT id, arg_min(h, r) AS lo_h, arg_max(h, r) AS hi_h, min(s) AS lo, max(s) AS hi, max(h) FILTER (r = cnt // 2 + 1) AS mid_h, max(s) FILTER (r = cnt // 2 + 1) AS mid FROM so GROUP BY id)
SELECT id, 'm0' AS model, 'middle_worst' AS kind, 'Human: prompt ' || id || ' Assistant: ' || mid_h AS chosen, 'Human: prompt ' || id || ' Assistant: ' || lo_h AS rejected FROM k WHERE lo < mid
UNION ALL SELECT id, 'm0', 'best_middle', 'Human: prompt ' || id || ' Assistant: ' || hi_h, 'Human: prompt ' || id || ' Assistant: ' || mid_h FROM k WHERE hi > mid""")
def _(spark, d):
    return G.preference_pairs(samples(spark, d))
