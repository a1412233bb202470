"""Queries over grouped statistics, the oracle, best single models, random choice and the summary table."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import stats as S
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.plans.summary import formatted_summary, summary_long, summary_table

HASH = "md5(concat_ws('|', '42', dataset_id, split, CAST(record_index AS VARCHAR), model_name, CAST(run_no AS VARCHAR)))"
REFS = ["m7"]
OOD = ["1-URGENT", "2-HIGH"]
IN_OOD = "dataset_id IN ('1-URGENT','2-HIGH')"
NANO = "CAST(round(cost * 1e9) AS BIGINT)"


@query("stats_by_dataset_model", "recs", f"""SELECT dataset_id, split, model_name, count(*) AS total_records,
 count(*) FILTER (score > 0) AS correct_records, round(avg(score), 9) AS avg_score, round(sum(score), 9) AS sum_score,
 round(sum({NANO}) / 1e9, 9) AS total_cost, round(sum({NANO}) / 1e9 / count(*), 9) AS avg_cost_per_record,
 CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
 round(avg(prompt_tokens), 9) AS avg_prompt_tokens, round(avg(completion_tokens), 9) AS avg_completion_tokens,
 CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens,
 round(count(*) FILTER (score > 0) / count(*), 9) AS accuracy FROM recs GROUP BY ALL""")
def _(spark, d):
    return rounded(S.stats_by_dataset_model(V.recs(spark, d)))


@query("stats_by_model", "recs", """, s AS (SELECT dataset_id, split, model_name, count(*) AS n, avg(score) AS a,
 count(*) FILTER (score > 0) AS c FROM recs GROUP BY ALL)
SELECT model_name, count(*) AS n_datasets, CAST(sum(n) AS BIGINT) AS total_records,
 string_agg(dataset_id || '/' || split || ':' || CAST(c AS VARCHAR), ',' ORDER BY dataset_id, split) AS datasets
FROM s GROUP BY model_name""")
def _(spark, d):
    s = S.stats_by_model(V.recs(spark, d))
    text = F.transform("datasets", lambda x: F.concat(x["dataset_id"], F.lit("/"), x["split"], F.lit(":"),
                                                      x["correct_records"].cast("string")))
    return s.withColumn("datasets", F.concat_ws(",", text))


@query("stats_by_dataset", "recs", """, s AS (SELECT dataset_id, split, model_name, count(*) AS n,
 count(*) FILTER (score > 0) AS c FROM recs GROUP BY ALL)
SELECT dataset_id, split, count(*) AS n_models, CAST(sum(n) AS BIGINT) AS total_records,
 string_agg(model_name || ':' || CAST(c AS VARCHAR), ',' ORDER BY model_name) AS models
FROM s GROUP BY dataset_id, split""")
def _(spark, d):
    s = S.stats_by_dataset(V.recs(spark, d))
    text = F.transform("models", lambda x: F.concat(x["model_name"], F.lit(":"), x["correct_records"].cast("string")))
    return s.withColumn("models", F.concat_ws(",", text))


@query("global_stats", "recs", f"""SELECT count(*) AS total_records, count(DISTINCT (dataset_id, split)) AS total_datasets,
 count(DISTINCT model_name) AS total_models, count(DISTINCT (dataset_id, split, record_index)) AS total_prompts,
 round(avg(score), 9) AS avg_score, round(sum({NANO}) / 1e9, 9) AS total_cost,
 round(sum({NANO}) / 1e9 / count(*), 9) AS avg_cost_per_record, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
 (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT dataset_id || '/' || split AS k FROM recs)) AS datasets,
 (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT model_name AS k FROM recs)) AS models FROM recs""")
def _(spark, d):
    g = S.global_stats(V.recs(spark, d))
    return rounded(g.withColumn("datasets", F.concat_ws(",", "datasets")).withColumn("models", F.concat_ws(",", "models")))


@query("oracle_accuracy", "recs", """, q AS (SELECT dataset_id, split, record_index, bool_or(score > 0) AS hit FROM recs
 WHERE model_name <> 'm7' GROUP BY ALL)
SELECT dataset_id, split, count(*) AS n_questions, round(avg(CAST(hit AS INT)), 9) AS oracle_accuracy FROM q GROUP BY ALL""")
def _(spark, d):
    return rounded(S.oracle_accuracy(V.recs(spark, d), REFS))


_ORACLE_COST = """, q AS (SELECT dataset_id, split, record_index, coalesce(min(n) FILTER (score > 0), min(n)) AS c
 FROM (SELECT *, CAST(round(cost * 1e9) AS BIGINT) AS n FROM recs WHERE model_name <> 'm7') GROUP BY ALL)
SELECT dataset_id, split, round(sum(c) / 1e9{per}, 9) AS oracle_cost FROM q GROUP BY ALL"""


@query("oracle_cost_total", "recs", _ORACLE_COST.format(per=""))
def _(spark, d):
    return rounded(S.oracle_cost(V.recs(spark, d), "total_cost", REFS))


@query("oracle_cost_per_record", "recs", _ORACLE_COST.format(per=" / count(*)"))
def _(spark, d):
    return rounded(S.oracle_cost(V.recs(spark, d), "avg_cost_per_record", REFS))


_BEST = f""", s AS (SELECT dataset_id, split, model_name, avg(score) AS a, sum({NANO}) / 1e9 AS c, count(*) AS n,
 sum(score) AS ss FROM recs WHERE model_name <> 'm7' GROUP BY ALL),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY dataset_id, split ORDER BY a DESC, model_name) = 1)"""


@query("max_expert_cost", "recs", _BEST + """ SELECT dataset_id, split, model_name, round(c, 9) AS max_expert_cost FROM b""")
def _(spark, d):
    return rounded(S.max_expert_cost(V.recs(spark, d), exclude_models=REFS))


@query("best_model_per_dataset", "recs", _BEST + """ SELECT dataset_id, split, model_name, n AS total_records,
 round(a, 9) AS avg_score FROM b""")
def _(spark, d):
    b = S.best_model_per_dataset(V.recs(spark, d), REFS)
    return rounded(b.select("dataset_id", "split", "model_name", "total_records", "avg_score"))


@query("dataset_oracle", "recs", _BEST + """ SELECT dataset_id, split, model_name, n AS total_records,
 round(a, 9) AS avg_score, round(c, 9) AS total_cost FROM b""")
def _(spark, d):
    return rounded(S.dataset_oracle(V.recs(spark, d), REFS))


_PICK = f""", p AS (SELECT * FROM recs WHERE model_name <> 'm7'
 QUALIFY row_number() OVER (PARTITION BY dataset_id, split, record_index ORDER BY {HASH}, run_no, score, cost) = 1)"""


@query("random_router", "recs", _PICK + f""" SELECT dataset_id, split, count(*) AS n_questions,
 round(avg(score), 9) AS random_accuracy, round(sum({NANO}) / 1e9, 9) AS random_cost FROM p GROUP BY ALL""")
def _(spark, d):
    return rounded(S.random_router(V.recs(spark, d), 42, REFS, tie=["run_no"]))


def _sample_sql(where: str) -> str:
    return f""", f AS (SELECT * FROM recs WHERE {where}), main AS (SELECT * FROM f WHERE model_name <> 'm7'),
 pm AS (SELECT m.model_name, coalesce((SELECT avg(score) FROM f WHERE f.model_name = m.model_name), 0.0) AS value
        FROM (SELECT DISTINCT model_name FROM recs) m),
 b AS (SELECT dataset_id, split, model_name, sum(score) AS ss, count(*) AS n FROM main GROUP BY dataset_id, split, model_name
       QUALIFY row_number() OVER (PARTITION BY dataset_id, split ORDER BY avg(score) DESC, model_name) = 1),
 p AS (SELECT * FROM main QUALIFY row_number() OVER (PARTITION BY dataset_id, split, record_index ORDER BY {HASH}, run_no, score, cost) = 1),
 q AS (SELECT bool_or(score > 0) AS hit FROM main GROUP BY dataset_id, split, record_index)
SELECT row_name, round(value, 9) AS value FROM (
 SELECT model_name AS row_name, value FROM pm
 UNION ALL SELECT 'AVG', avg(value) FROM pm WHERE model_name <> 'm7'
 UNION ALL SELECT 'Max Expert', sum(ss) / sum(n) FROM b
 UNION ALL SELECT 'Random Router', avg(score) FROM p
 UNION ALL SELECT 'Oracle', avg(CAST(hit AS INT)) FROM q)"""


@query("sample_level_avg", "recs", _sample_sql("true"))
def _(spark, d):
    return rounded(S.sample_level_avg(V.recs(spark, d), None, REFS, 42, ["run_no"]))


@query("sample_level_avg_filtered", "recs", _sample_sql(IN_OOD))
def _(spark, d):
    return rounded(S.sample_level_avg(V.recs(spark, d), OOD, REFS, 42, ["run_no"]))


_CELLS = f""", cells AS (SELECT dataset_id, dataset_id || '/' || split AS key, model_name, avg(score) AS a, sum(score) AS ss,
  count(*) AS n, sum({NANO}) / 1e9 AS c FROM recs GROUP BY dataset_id, split, model_name),
 main AS (SELECT * FROM cells WHERE model_name <> 'm7'),
 best AS (SELECT dataset_id, key, avg(a) AS avg_a, avg(c) AS avg_c, max(a) AS max_a, arg_max(c, (a, -CAST(substr(model_name, 2) AS INT))) AS bc,
   arg_max(ss, (a, -CAST(substr(model_name, 2) AS INT))) AS bss, arg_max(n, (a, -CAST(substr(model_name, 2) AS INT))) AS bn FROM main GROUP BY ALL),
 p AS (SELECT dataset_id, split, record_index, score, {NANO} AS nn FROM recs WHERE model_name <> 'm7'
   QUALIFY row_number() OVER (PARTITION BY dataset_id, split, record_index ORDER BY {HASH}, run_no, score, cost) = 1),
 q AS (SELECT dataset_id, split, record_index, bool_or(score > 0) AS hit, coalesce(min({NANO}) FILTER (score > 0), min({NANO})) AS oc
   FROM recs WHERE model_name <> 'm7' GROUP BY ALL),
 o AS (SELECT dataset_id, dataset_id || '/' || split AS key, count(*) AS nq, count(*) FILTER (hit) AS nc, sum(oc) / 1e9 AS oc, sum(score) AS rs,
   sum(nn) / 1e9 AS rc FROM q JOIN p USING (dataset_id, split, record_index) GROUP BY dataset_id, split),
 cell_rows AS (
  SELECT model_name AS row_name, 'performance' AS metric, key AS column_name, a AS value FROM cells
  UNION ALL SELECT model_name, 'cost', key, c FROM cells
  UNION ALL SELECT 'AVG', 'performance', key, avg_a FROM best UNION ALL SELECT 'AVG', 'cost', key, avg_c FROM best
  UNION ALL SELECT 'Max Expert', 'performance', key, max_a FROM best UNION ALL SELECT 'Max Expert', 'cost', key, bc FROM best
  UNION ALL SELECT 'Random Router', 'performance', key, rs / nq FROM o UNION ALL SELECT 'Random Router', 'cost', key, rc FROM o
  UNION ALL SELECT 'Oracle', 'performance', key, nc / nq FROM o UNION ALL SELECT 'Oracle', 'cost', key, oc FROM o)"""


def _scope_sql(scope: str, where: str, avg_col: str, sum_col: str, smp_col: str, top: str) -> str:
    mm = f"(SELECT model_name, avg(a) AS da, sum(c) AS dc, sum(ss) / sum(n) AS sm FROM cells WHERE {where} GROUP BY 1)"
    main = f"(SELECT * FROM {mm} WHERE model_name <> 'm7')"
    return f"""
  UNION ALL SELECT model_name, 'performance', '{avg_col}', da FROM {mm}
  UNION ALL SELECT model_name, 'cost', '{sum_col}', dc FROM {mm}
  UNION ALL SELECT model_name, 'performance', '{smp_col}', sm FROM {mm}
  UNION ALL SELECT 'AVG', 'performance', '{avg_col}', avg(da) FROM {main}
  UNION ALL SELECT 'AVG', 'cost', '{sum_col}', avg(dc) FROM {main}
  UNION ALL SELECT 'AVG', 'performance', '{smp_col}', avg(sm) FROM {main}
  UNION ALL SELECT 'Max Expert', 'performance', '{avg_col}', {top} FROM {main}
  UNION ALL SELECT 'Max Expert', 'cost', '{sum_col}', max(dc) FROM {main}
  UNION ALL SELECT 'Max Expert', 'performance', '{smp_col}', sum(bss) / sum(bn) FROM best WHERE {where}
  UNION ALL SELECT 'Random Router', 'performance', '{avg_col}', avg(rs / nq) FROM o WHERE {where}
  UNION ALL SELECT 'Random Router', 'cost', '{sum_col}', sum(rc) FROM o WHERE {where}
  UNION ALL SELECT 'Random Router', 'performance', '{smp_col}', sum(rs) / sum(nq) FROM o WHERE {where}
  UNION ALL SELECT 'Oracle', 'performance', '{avg_col}', avg(nc / nq) FROM o WHERE {where}
  UNION ALL SELECT 'Oracle', 'cost', '{sum_col}', sum(oc) FROM o WHERE {where}
  UNION ALL SELECT 'Oracle', 'performance', '{smp_col}', sum(nc) / sum(nq) FROM o WHERE {where}"""


_ALL = _scope_sql("All", "true", "Dataset-Avg", "Dataset-Sum", "Sample-Avg",
                  "(SELECT avg(max_a) FROM best)").replace("FROM (SELECT * FROM (SELECT model_name, avg(a) AS da, sum(c) AS dc, "
                  "sum(ss) / sum(n) AS sm FROM cells WHERE true GROUP BY 1) WHERE model_name <> 'm7')", "FROM mm_main")
_MM = ", mm_main AS (SELECT model_name, avg(a) AS da, sum(c) AS dc, sum(ss) / sum(n) AS sm FROM main GROUP BY 1)"
_SECTION = "CASE WHEN row_name IN ('AVG','Random Router','Max Expert','Oracle') THEN 'aggregate' WHEN row_name = 'm7' THEN 'reference' ELSE 'main' END AS section"
_LONG = (_CELLS + _MM + ", all_rows AS (SELECT * FROM cell_rows" +
         _ALL.replace("SELECT 'Max Expert', 'performance', 'Dataset-Avg', (SELECT avg(max_a) FROM best) FROM mm_main",
                      "SELECT 'Max Expert', 'performance', 'Dataset-Avg', avg(max_a) FROM best"))
_TAIL = f") SELECT {_SECTION}, row_name, metric, column_name, round(value, 9) AS value FROM all_rows"


@query("summary_long", "recs", _LONG + _TAIL)
def _(spark, d):
    return rounded(summary_long(V.recs(spark, d), reference_models=REFS, tie=["run_no"]))


@query("summary_long_ood", "recs", _LONG
       + _scope_sql("In-Dist", f"NOT {IN_OOD}", "In-Dist-Avg", "In-Dist-Sum", "In-Dist-Sample-Avg", "max(da)")
       + _scope_sql("OOD", IN_OOD, "OOD-Avg", "OOD-Sum", "OOD-Sample-Avg", "max(da)") + _TAIL)
def _(spark, d):
    return rounded(summary_long(V.recs(spark, d), ood_datasets=OOD, reference_models=REFS, tie=["run_no"]))


@query("summary_table_dense", "dense", """, cells AS (SELECT dataset_id || '/test' AS key, model_name, avg(score) AS a, sum(score) AS ss, count(*) AS n
  FROM dense GROUP BY ALL), best AS (SELECT key, max(a) AS m, avg(a) AS v, arg_max(ss, (a, -CAST(substr(model_name, 2) AS INT))) AS ss, any_value(n) AS n FROM cells GROUP BY key),
 p AS (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY
   md5(concat_ws('|', '42', dataset_id, split, CAST(record_index AS VARCHAR), model_name))) = 1),
 r AS (SELECT dataset_id || '/test' AS key, avg(score) AS a, sum(score) AS ss, count(*) AS n FROM p GROUP BY ALL),
 q AS (SELECT dataset_id || '/test' AS key, max(score) AS hit FROM dense GROUP BY dataset_id, record_index),
 o AS (SELECT key, avg(hit) AS a, sum(hit) AS ss, count(*) AS n FROM q GROUP BY key),
 long AS (SELECT model_name AS row_name, key, a, ss, n FROM cells UNION ALL SELECT 'AVG', key, v, NULL, NULL FROM best
   UNION ALL SELECT 'Max Expert', key, m, ss, n FROM best UNION ALL SELECT 'Random Router', key, a, ss, n FROM r
   UNION ALL SELECT 'Oracle', key, a, ss, n FROM o),
 w AS (SELECT row_name, avg(a) AS da, sum(ss) / sum(n) AS sa,
   max(a) FILTER (key = 'de/test') AS de, max(a) FILTER (key = 'en/test') AS en, max(a) FILTER (key = 'es/test') AS es,
   max(a) FILTER (key = 'fr/test') AS fr FROM long GROUP BY row_name)
SELECT row_name, round(de, 9) AS "de/test", round(en, 9) AS "en/test", round(es, 9) AS "es/test", round(fr, 9) AS "fr/test",
 round(da, 9) AS "Dataset-Avg", round(CASE WHEN row_name = 'AVG' THEN (SELECT avg(sa) FROM w WHERE row_name LIKE 'm_') ELSE sa END, 9) AS "Sample-Avg" FROM w""")
def _(spark, d):
    return rounded(summary_table(V.dense(spark, d))[0])


@query("format_table", "dense", """, c AS (SELECT dataset_id, model_name, avg(score) AS a FROM dense GROUP BY ALL)
SELECT model_name, CASE WHEN de IS NULL THEN '-' ELSE CAST(CAST(round(de * 100, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS de,
 CASE WHEN en IS NULL THEN '-' ELSE CAST(CAST(round(en * 100, 2) AS DECIMAL(38,2)) AS VARCHAR) END AS en, '-' AS it
FROM (SELECT model_name, max(a) FILTER (dataset_id = 'de') AS de, max(a) FILTER (dataset_id = 'en') AS en FROM c GROUP BY 1)""")
def _(spark, d):
    wide = V.dense(spark, d).groupBy("model_name").pivot("dataset_id", ["de", "en", "it"]).agg(F.avg("score"))
    return S.format_table(wide)


@query("summary_table_text")
def _(spark, d):
    return formatted_summary(V.recs(spark, d), ood_datasets=OOD, reference_models=REFS)[0]


@query("baseline_scores", "recs", "SELECT model_name, dataset_id, round(avg(score) * 100, 2) AS score FROM recs GROUP BY ALL")
def _(spark, d):
    return S.baseline_scores(V.recs(spark, d))


@query("run_aggregates", "runs", f"""SELECT dataset_id, split, model_name, count(*) AS counts, round(coalesce(avg(score), 0.0), 9) AS performance,
 CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 round(sum({NANO}) / 1e9, 9) AS cost FROM runs GROUP BY ALL""")
def _(spark, d):
    return rounded(S.run_aggregates(V.runs(spark, d)))


def _events(spark, d):
    e = V.table(spark, d, "events")
    return e.select("event_type", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"),
                                               F.col("value").cast("string"), F.lit("flag"), F.lit("true"),
                                               F.lit("note"), F.col("event_type")).alias("extra_fields"))


@query("extra_metric_means", "", """SELECT event_type, metric, round(avg(x), 9) AS mean, count(x) AS n FROM (
 SELECT event_type, 'k' AS metric, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x FROM events
 UNION ALL SELECT event_type, 'value', value FROM events) WHERE x IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return rounded(S.extra_metric_means(_events(spark, d), ["event_type"]))


@query("suite_metric_means", "", """SELECT event_type, round(avg(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0)), 9) AS k,
 round(avg(0.0), 9) AS absent, round(coalesce(avg(value) FILTER (value > 0), -1.0), 9) AS value FROM events GROUP BY ALL""")
def _(spark, d):
    return rounded(S.suite_metric_means(_events(spark, d), ["event_type"], ["k", "absent"], ["value"]))


@query("task_accuracy", "dense", """, t AS (SELECT dataset_id AS task, model_name, avg(CASE WHEN score = 1.0 THEN 1.0 ELSE 0.0 END) AS acc FROM dense GROUP BY ALL)
SELECT model_name, string_agg('The model achieves accuracy ' || CAST(CAST(round(acc * 100, 2) AS DECIMAL(10,2)) AS VARCHAR) || '% on the task of ' || task,
 '. ' ORDER BY task) AS description FROM t GROUP BY model_name""")
def _(spark, d):
    return S.task_accuracy(V.dense(spark, d).withColumnRenamed("dataset_id", "task"))


@query("model_avg_cost", "recs", f"SELECT model_name, round(sum({NANO}) / 1e9 / count(cost), 9) AS avg_cost FROM recs GROUP BY ALL")
def _(spark, d):
    return rounded(S.model_avg_cost(V.recs(spark, d)))


def _decisions(spark, d):
    """The random router's choices as decisions."""
    q = S.question_outcomes(V.recs(spark, d), (), 42, ["run_no"])
    return q.select("dataset_id", "split", "record_index", F.col("random_model").alias("model_name"))


_PICK_ALL = _PICK.replace("WHERE model_name <> 'm7'", "")


@query("routing_distribution", "recs", _PICK_ALL + """ SELECT model_name, n, round(n * 100.0 / (SELECT count(*) FROM p), 9) AS percent,
 CAST(count(*) OVER () AS BIGINT) AS models_used, round(max(n) OVER () * 100.0 / (SELECT count(*) FROM p), 9) AS top_share
 FROM (SELECT model_name, count(*) AS n FROM p GROUP BY 1)""")
def _(spark, d):
    return rounded(S.routing_distribution(_decisions(spark, d)))


@query("routing_distribution_by_dataset", "recs", _PICK_ALL + """, c AS (SELECT dataset_id, model_name, count(*) AS n FROM p GROUP BY ALL)
SELECT dataset_id, model_name, n, round(n * 100.0 / sum(n) OVER w, 9) AS percent, count(*) OVER w AS models_used,
 round(max(n) OVER w * 100.0 / sum(n) OVER w, 9) AS top_share FROM c WINDOW w AS (PARTITION BY dataset_id)""")
def _(spark, d):
    return rounded(S.routing_distribution(_decisions(spark, d), by_dataset=True))


@query("label_majority", "recs", "SELECT model_name, prompt, CAST(max(CASE WHEN score > 0 THEN 1 ELSE 0 END) AS INT) AS label FROM recs GROUP BY ALL")
def _(spark, d):
    return S.label_majority(V.recs(spark, d).withColumn("label", (F.col("score") > 0).cast("int")))


@query("correctness_matrix", "recs", "SELECT prompt, " + ", ".join(
    f"coalesce(max(CASE WHEN score > 0 THEN 1 ELSE 0 END) FILTER (model_name = 'm{i}'), 0) AS m{i}" for i in range(8)) +
    " FROM recs GROUP BY prompt")
def _(spark, d):
    return S.correctness_matrix(V.recs(spark, d).withColumn("label", (F.col("score") > 0).cast("int")), V.MODELS)


@query("pair_statistics", "dense", """, a AS (SELECT dataset_id, record_index, CAST(sum(score) AS BIGINT) AS r FROM dense GROUP BY ALL),
 g AS (SELECT dataset_id, r, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT dataset_id, sum(n) AS total FROM g GROUP BY ALL),
 e AS (SELECT dataset_id, r, n, total, (SELECT coalesce(sum(least(2, n - i)), 0) FROM range(1, n) x(i)) AS pairs FROM g JOIN t USING (dataset_id))
SELECT dataset_id, CAST(max(total) AS BIGINT) AS total_prompts, CAST(sum(pairs) AS BIGINT) AS pair_count,
 CAST(sum(pairs * least(total - n, 32)) AS BIGINT) AS estimated_negative_assignments,
 CAST(sum(pairs * (total - n)) AS BIGINT) AS potential_negative_assignments FROM e GROUP BY dataset_id""")
def _(spark, d):
    from routelab.operators.training import to_prompt_models
    return S.pair_statistics(to_prompt_models(V.dense(spark, d)), 32, 2)


@query("vote_tally", "", """, v AS (SELECT l_orderkey AS item_id, 'novelty' AS dimension, l_returnflag = 'R' AS win FROM lineitem UNION ALL SELECT l_orderkey, 'clarity', l_linestatus = 'F' FROM lineitem)
SELECT item_id, dimension, o AS original_votes, g AS generated_votes,
 CASE WHEN g > CASE WHEN dimension = 'novelty' THEN 4 ELSE 3 END THEN 'win' WHEN g <= 2 THEN 'lose' ELSE 'tie' END AS result
FROM (SELECT item_id, dimension, count(*) FILTER (NOT win) AS o, count(*) FILTER (win) AS g FROM v GROUP BY ALL)""")
def _(spark, d):
    # every line of an order is a vote on it
    def side(c, v):
        return F.when(F.col(c) == v, "win_B").otherwise("win_A")
    votes = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.create_map(F.lit("novelty"), side("l_returnflag", "R"), F.lit("clarity"), side("l_linestatus", "F")).alias("judgments"))
    return S.vote_tally(votes)


@query("duplicate_keys", "", """SELECT doc_id, md5(text) AS request_key FROM documents
 WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.md5("text").alias("request_key"))
    return S.duplicate_keys(docs, "request_key")


@query("exact_quantiles", "recs", """SELECT model_name, prob, round(quantile_cont(cost, prob), 9) AS quantile FROM recs,
 (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(prob) GROUP BY model_name, prob""".replace(
    "quantile_cont(cost, prob)", "CASE prob WHEN 0.1 THEN quantile_cont(cost, 0.1) WHEN 0.5 THEN quantile_cont(cost, 0.5) ELSE quantile_cont(cost, 0.9) END"))
def _(spark, d):
    return rounded(S.exact_quantiles(V.recs(spark, d), ["model_name"], "cost", [0.1, 0.5, 0.9]), 9)
