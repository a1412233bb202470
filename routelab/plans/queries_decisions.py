"""Queries over routing-decision reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import decisions as D
from routelab.operators import shapes as G
from routelab.operators import stats as S
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded

L = F.lit
Q3 = ["dataset_id", "split", "record_index"]
OOD = ["1-URGENT", "2-HIGH"]
NANO = "CAST(round(cost * 1e9) AS BIGINT)"
PICK = """, pick AS (SELECT dataset_id, split, record_index, model_name, score, cost FROM latest QUALIFY row_number() OVER (PARTITION BY dataset_id, split, record_index
  ORDER BY md5(concat_ws('|', '42', dataset_id, split, CAST(record_index AS VARCHAR), model_name))) = 1)"""


def decisions(spark, d):
    return S.question_outcomes(V.latest(spark, d)).select(*Q3, F.col("random_model").alias("model_name"))


def scored(spark, d):
    """Predicted correctness per (sample, model), a fixed function of the keys."""
    r = V.dense(spark, d)
    m = F.substring("model_name", 2, 1).cast("bigint")
    return r.select("dataset_id", "record_index", F.concat_ws("::", "dataset_id", F.col("record_index").cast("string")).alias("sample_id"), "model_name",
                    (F.col("score") > 0).cast("int").alias("label"), (((F.col("record_index") * 13 + m * 17) % 101) / 100.0).alias("probability"), "cost", "score")


SCORED = """, scored AS (SELECT dataset_id, record_index, dataset_id || '::' || CAST(record_index AS VARCHAR) AS sample_id, model_name, CAST(score > 0 AS INT) AS label,
  CAST((record_index * 13 + CAST(substr(model_name, 2) AS BIGINT) * 17) % 101 AS DOUBLE) / 100.0 AS probability, cost, score FROM dense)"""

_PER = PICK + f""", per AS (SELECT dataset_id, CASE WHEN dataset_id IN ('1-URGENT','2-HIGH') THEN 'ood' ELSE 'non_ood' END AS side, count(*) AS n, sum(score) AS correct,
  CAST(sum({NANO}) AS BIGINT) AS c, CAST(sum(CASE WHEN score > 0 THEN {NANO} ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN score > 0 THEN 0 ELSE {NANO} END) AS BIGINT) AS bad FROM pick GROUP BY ALL),
 lv AS (SELECT 'dataset' AS level, dataset_id AS name, * FROM per UNION ALL SELECT 'side', side, * FROM per UNION ALL SELECT 'all', 'all', * FROM per),
 rep AS (SELECT level, name, CAST(sum(n) AS BIGINT) AS n, sum(correct) AS correct, avg(correct / n) * 100 AS macro_accuracy, sum(correct) * 100 / sum(n) AS pooled_accuracy,
  sum(c) / 1e9 AS total_cost, sum(good) / 1e9 AS correct_cost, sum(bad) / 1e9 AS incorrect_cost FROM lv GROUP BY ALL)"""


@query("evaluate_selection", "latest", _PER + """ SELECT level, name, n, correct, round(macro_accuracy, 6) AS macro_accuracy, round(pooled_accuracy, 6) AS pooled_accuracy,
 round(total_cost, 6) AS total_cost, round(correct_cost, 6) AS correct_cost, round(incorrect_cost, 6) AS incorrect_cost FROM rep""".replace(", 6)", ", 9)"))
def _(spark, d):
    return rounded(D.evaluate_selection(decisions(spark, d), V.latest(spark, d), OOD, keys=Q3))


@query("routing_costs", "latest", _PER + """ SELECT level, name, n, round(total_cost, 9) AS total_cost, round(total_cost / n, 9) AS avg_cost_per_query, round(correct_cost, 9) AS correct_cost,
 round(incorrect_cost, 9) AS incorrect_cost, round(CASE WHEN correct > 0 THEN correct_cost / correct ELSE 0 END, 9) AS cost_per_correct,
 round(macro_accuracy / (total_cost / n + 1e-8), 9) AS cost_efficiency FROM rep""")
def _(spark, d):
    return rounded(D.routing_costs(decisions(spark, d), V.latest(spark, d), OOD, keys=Q3))


@query("model_costs", "latest", PICK + f" SELECT model_name, count(*) AS n_queries, round(sum({NANO}) / 1e9, 9) AS total_cost FROM pick GROUP BY 1")
def _(spark, d):
    return rounded(D.model_costs(decisions(spark, d), V.latest(spark, d), Q3))


_BASE = _PER + f""", cell AS (SELECT model_name, dataset_id, avg(score) AS a, CAST(sum({NANO}) AS BIGINT) AS c FROM latest WHERE dataset_id NOT IN ('1-URGENT','2-HIGH') GROUP BY ALL),
 r AS (SELECT avg(pooled_accuracy) AS ra, count(*) AS n_all FROM rep WHERE level = 'dataset' AND name NOT IN ('1-URGENT','2-HIGH')),
 m AS (SELECT model_name, avg(a) * 100 AS mean_score, count(*) AS k, sum(c) / 1e9 AS total_cost FROM cell GROUP BY 1)
SELECT model_name, round(mean_score, 9) AS mean_score, CAST(k AS VARCHAR) || '/' || CAST(n_all AS VARCHAR) AS coverage, round(total_cost, 9) AS total_cost, round(ra, 9) AS router_accuracy,
 round(ra - mean_score, 9) AS improvement, row_number() OVER (ORDER BY mean_score DESC, model_name) = 1 AS is_best FROM m, r"""


@query("baseline_comparison", "latest", _BASE)
def _(spark, d):
    rep = D.evaluate_selection(decisions(spark, d), V.latest(spark, d), OOD, keys=Q3)
    return rounded(D.baseline_comparison(V.latest(spark, d), rep, OOD, "non_ood"))


@query("dataset_best_join", "latest", _PER + """, b AS (SELECT model_name, dataset_id, round(avg(score) * 100, 2) AS score FROM latest GROUP BY ALL
  QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY round(avg(score) * 100, 2) DESC, model_name) = 1)
SELECT dataset_id, round(pooled_accuracy, 9) AS router_accuracy, model_name AS best_model, score AS best_score, round(pooled_accuracy - score, 9) AS improvement
FROM (SELECT name AS dataset_id, pooled_accuracy FROM rep WHERE level = 'dataset') JOIN b USING (dataset_id)""".replace("GROUP BY ALL\n  QUALIFY", "GROUP BY model_name, dataset_id\n  QUALIFY"))
def _(spark, d):
    rep = D.evaluate_selection(decisions(spark, d), V.latest(spark, d), OOD, keys=Q3)
    return rounded(D.dataset_best_join(rep, S.baseline_scores(V.latest(spark, d))))


_PAIRS = """, pairs AS (SELECT a.dataset_id, a.prompt, a.score AS sa, b.score AS sb, a.cost AS ca, b.cost AS cb,
  CASE WHEN a.score = b.score THEN 'tie' WHEN a.score > b.score THEN 'model_a' ELSE 'model_b' END AS winner, CAST((a.record_index * 7) % 100 AS DOUBLE) / 100.0 AS winrate
 FROM latest a JOIN latest b ON a.dataset_id = b.dataset_id AND a.prompt = b.prompt WHERE a.model_name = 'm7' AND b.model_name = 'm2')"""


def pairs(spark, d):
    p = G.pair_models(V.latest(spark, d), "m7", "m2", True)
    return p.withColumn("winrate", ((F.col("record_index") * 7) % 100) / 100.0)


@query("threshold_router", "latest", _PAIRS + " SELECT dataset_id, prompt, winrate, CASE WHEN winrate >= 0.6 THEN 'model_a' ELSE 'model_b' END AS predicted FROM pairs")
def _(spark, d):
    return D.threshold_router(pairs(spark, d), threshold=0.6).select("dataset_id", "prompt", "winrate", "predicted")


@query("pairwise_report", "latest", _PAIRS + """, p AS (SELECT *, CASE WHEN dataset_id LIKE '1-%' OR dataset_id LIKE '2-%' THEN 'ood' ELSE 'in_domain' END AS side, winrate >= 0.5 AS strong FROM pairs),
 x AS (SELECT *, CASE WHEN strong THEN sa ELSE sb END > 0 AS ok, winner <> 'tie' AS dec, CASE WHEN strong THEN 'model_a' ELSE 'model_b' END = winner AS routed,
  CAST(round(CASE WHEN strong THEN ca ELSE cb END * 1e9) AS BIGINT) AS c FROM p),
 lv AS (SELECT 'dataset' AS level, dataset_id AS name, * FROM x UNION ALL SELECT 'side', side, * FROM x UNION ALL SELECT 'all', 'all', * FROM x),
 da AS (SELECT dataset_id, side, avg(CAST(ok AS INT)) AS acc FROM x GROUP BY ALL)
SELECT level, name, count(*) AS n, count(*) FILTER (strong) AS n_strong, count(*) FILTER (NOT dec) AS n_ties, count(*) FILTER (dec) AS n_decisive,
 round(count(*) FILTER (ok) / count(*), 6) AS selection_accuracy, round(count(*) FILTER (ok AND dec) / count(*) FILTER (dec), 6) AS selection_accuracy_decisive,
 round(count(*) FILTER (dec AND routed) / count(*) FILTER (dec), 6) AS routing_accuracy,
 round((SELECT avg(acc) FROM da WHERE level = 'all' OR (level = 'side' AND side = name) OR dataset_id = name), 6) AS macro_accuracy,
 round(avg(winrate), 6) AS winrate_mean, round(stddev_pop(winrate), 6) AS winrate_std, round(sum(c) / 1e9, 6) AS total_cost, round(sum(c) / 1e9 / count(DISTINCT dataset_id), 6) AS avg_cost_per_dataset
FROM lv GROUP BY level, name""")
def _(spark, d):
    return rounded(D.pairwise_report(pairs(spark, d), ood_prefixes=["1-", "2-"]), 6)


_CHEAP = SCORED + """, ch AS (SELECT *, probability >= 0.7 AS pos FROM scored QUALIFY row_number() OVER (PARTITION BY dataset_id, sample_id ORDER BY NOT (probability >= 0.7),
  CASE WHEN probability >= 0.7 THEN cost ELSE -probability END, CASE WHEN probability >= 0.7 THEN -probability ELSE cost END, model_name) = 1)"""


@query("cheapest_positive", "dense", _CHEAP + " SELECT dataset_id, sample_id, model_name, label, probability, round(cost, 9) AS cost FROM ch")
def _(spark, d):
    return rounded(D.cheapest_positive(scored(spark, d), 0.7))


@query("choice_report", "dense", _CHEAP + f""", per AS (SELECT dataset_id, count(*) AS n, avg(label) AS acc, CAST(sum({NANO}) AS BIGINT) AS c FROM ch GROUP BY 1)
SELECT name, CAST(sum(n) AS BIGINT) AS n, round(avg(acc), 9) AS accuracy, round(sum(c) / 1e9, 9) AS total_cost, round(sum(c) / 1e9 / sum(n), 9) AS avg_cost
FROM (SELECT dataset_id AS name, n, acc, c FROM per UNION ALL SELECT 'ALL', n, acc, c FROM per) GROUP BY name""")
def _(spark, d):
    return rounded(D.choice_report(D.cheapest_positive(scored(spark, d), 0.7)))


@query("binary_scores", "dense", SCORED + """, pr AS (SELECT sample_id, max(probability) AS probability, max(label) AS label, max(CAST(probability >= 0.5 AS INT)) AS prediction FROM scored GROUP BY 1),
 b AS (SELECT 'record' AS level, probability, label, CAST(probability >= 0.5 AS INT) AS prediction FROM scored UNION ALL SELECT 'prompt', probability, label, prediction FROM pr),
 r AS (SELECT *, rank() OVER (PARTITION BY level ORDER BY probability) + (count(*) OVER (PARTITION BY level, probability) - 1) / 2.0 AS ar FROM b)
SELECT level, count(*) AS n, round(avg(CAST(prediction = label AS INT)), 6) AS accuracy,
 round(CAST((sum(ar) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS DOUBLE), 6) AS auc FROM r GROUP BY level""")
def _(spark, d):
    return rounded(D.binary_scores(scored(spark, d)), 6)


_CAND = SCORED + """, cand AS (SELECT dataset_id, record_index AS id, CAST(substr(model_name, 2) AS INT) AS idx, probability AS score, cost FROM scored),
 sel AS (SELECT dataset_id, id, CAST(id % 8 AS INT) AS sel FROM (SELECT DISTINCT dataset_id, id FROM cand))"""


@query("selection_report", "dense", _CAND + f""", q AS (SELECT dataset_id, id, max(score) FILTER (idx = sel) AS ss, any_value(sel) AS sel, arg_max(idx, (score, idx)) AS r0, arg_max(idx, (score, -idx)) AS oi,
  max(score) AS os, CAST(sum(CASE WHEN idx = sel THEN {NANO} END) AS BIGINT) AS c FROM cand JOIN sel USING (dataset_id, id) GROUP BY dataset_id, id),
 per AS (SELECT dataset_id AS name, count(*) AS n, avg(ss) AS a, avg(CAST(sel = r0 AS INT)) AS b, avg(sel) AS e, avg(os) AS f, avg(oi) AS g, sum(c) / 1e9 / count(*) AS h FROM q GROUP BY 1),
 u AS (SELECT * FROM per UNION ALL SELECT 'MICRO', count(*), avg(ss), avg(CAST(sel = r0 AS INT)), avg(sel), avg(os), avg(oi), sum(c) / 1e9 / count(*) FROM q
  UNION ALL SELECT 'MACRO', CAST(sum(n) AS BIGINT), avg(a), avg(b), avg(e), avg(f), avg(g), avg(h) FROM per)
SELECT name, n, round(a, 9) AS sel_score, round(b, 9) AS sel_acc, round(e, 9) AS sel_index, round(f, 9) AS oracle_score, round(g, 9) AS oracle_index, round(h, 9) AS avg_cost FROM u""")
def _(spark, d):
    s = scored(spark, d)
    c = s.select("dataset_id", F.col("record_index").alias("id"), F.substring("model_name", 2, 1).cast("int").alias("idx"), F.col("probability").alias("score"), "cost")
    sel = c.select("dataset_id", "id").distinct().withColumn("idx", (F.col("id") % 8).cast("int"))
    r = D.selection_report(c, sel)
    return r.select("name", "n", *[F.round(x, 9).alias(x) for x in r.columns[2:]])


@query("select_candidate", "", """, e AS (SELECT vec_id, embedding AS a FROM embeddings)
SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS INT) AS arg_max,
 CAST(coalesce(list_position([x >= 0 for x in a], true) - 1, len(a) - 1) AS INT) AS bubble,
 CAST(CASE WHEN list_max(a) < 0 THEN len(a) ELSE list_position(a, list_max(a)) - 1 END AS INT) AS heads FROM e""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("logits"))
    a = D.select_candidate(e, "det_ncls").withColumnRenamed("selected", "arg_max")
    b = D.select_candidate(a, "det_nlabels").withColumnRenamed("selected", "bubble")
    return D.select_candidate(b, "prob_nlabels").withColumnRenamed("selected", "heads").drop("logits")


@query("rank_correlation", "dense", SCORED + """, g AS (SELECT dataset_id, round(probability - 0.5, 9) AS pred, CAST(completion_tokens AS DOUBLE) / 1000 - 0.2 AS truth FROM (SELECT s.*, d.completion_tokens FROM scored s JOIN dense d USING (dataset_id, record_index, model_name))),
 r AS (SELECT *, rank() OVER (PARTITION BY dataset_id ORDER BY pred) + (count(*) OVER (PARTITION BY dataset_id, pred) - 1) / 2.0 AS rp,
  rank() OVER (PARTITION BY dataset_id ORDER BY truth) + (count(*) OVER (PARTITION BY dataset_id, truth) - 1) / 2.0 AS rt FROM g)
SELECT dataset_id, count(*) AS n, round(corr(CAST(rp AS DOUBLE), CAST(rt AS DOUBLE)), 6) AS spearman, round(avg((pred - truth) * (pred - truth)), 6) AS mse,
 round(avg(CAST(sign(pred) = sign(truth) AS INT)), 6) AS sign_accuracy FROM r GROUP BY 1""")
def _(spark, d):
    s = scored(spark, d).join(V.dense(spark, d).select("dataset_id", "record_index", "model_name", "completion_tokens"), ["dataset_id", "record_index", "model_name"])
    g = s.select("dataset_id", F.round(F.col("probability") - 0.5, 9).alias("pred"), (F.col("completion_tokens").cast("double") / 1000 - 0.2).alias("truth"))
    return rounded(D.rank_correlation(g, "pred", "truth", ["dataset_id"]), 6)


@query("arg_best_match", "latest", PICK + """, t AS (SELECT p.dataset_id, p.score, (SELECT max(score) FROM latest l WHERE l.dataset_id = p.dataset_id AND l.split = p.split AND l.record_index = p.record_index) AS top FROM pick p),
 per AS (SELECT dataset_id, count(*) AS n, avg(CAST(score = top AS INT)) AS m, avg(score) AS s, avg(CAST(score > 0 AS INT)) AS b FROM t GROUP BY 1)
SELECT dataset_id AS name, n, round(m, 6) AS match, round(s, 6) AS score, round(b, 6) AS binary_score FROM per
UNION ALL SELECT 'MACRO', CAST(sum(n) AS BIGINT), round(avg(m), 6), round(avg(s), 6), round(avg(b), 6) FROM per
UNION ALL SELECT 'POOLED', count(*), round(avg(CAST(score = top AS INT)), 6), round(avg(score), 6), round(avg(CAST(score > 0 AS INT)), 6) FROM t""")
def _(spark, d):
    return rounded(D.arg_best_match(decisions(spark, d), V.latest(spark, d), Q3), 6)


@query("highest_confidence_match", "dense", SCORED + """, c AS (SELECT dataset_id, label FROM scored QUALIFY row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY probability DESC, model_name) = 1),
 per AS (SELECT dataset_id AS name, count(*) AS n, avg(label) AS a FROM c GROUP BY 1)
SELECT name, n, round(a, 6) AS accuracy FROM per UNION ALL SELECT 'MACRO', CAST(sum(n) AS BIGINT), round(avg(a), 6) FROM per""")
def _(spark, d):
    return rounded(D.highest_confidence_match(scored(spark, d)), 6)


UTIL = """, edges AS (SELECT dataset_id AS task_id, record_index, model_name AS llm, score AS effect, cost AS cost_usd, (cost - min(cost) OVER w) / (max(cost) OVER w - min(cost) OVER w) AS cost
  FROM dense WINDOW w AS (PARTITION BY dataset_id)), ut AS (SELECT *, 0.5 * effect - 0.5 * cost AS utility FROM edges)"""


def utility_edges(spark, d):
    from routelab.operators.splits import normalize_cost_by_task
    from routelab.plans.queries_splits import edges
    return normalize_cost_by_task(edges(spark, d)).withColumnRenamed("cost", "cost_usd").withColumnRenamed("cost_norm", "cost")


@query("utility_report", "dense", UTIL + """, dec AS (SELECT task_id, record_index, llm FROM ut QUALIFY row_number() OVER (PARTITION BY task_id, record_index ORDER BY md5(concat_ws('|', '7', task_id, CAST(record_index AS VARCHAR), llm))) = 1),
 best AS (SELECT task_id, record_index, llm AS ideal, utility AS iu FROM ut QUALIFY row_number() OVER (PARTITION BY task_id, record_index ORDER BY utility DESC, llm) = 1),
 q AS (SELECT * FROM dec JOIN ut USING (task_id, record_index, llm) JOIN best USING (task_id, record_index)),
 m AS (SELECT m, 2.0 * count(*) FILTER (llm = m AND ideal = m) / (count(*) FILTER (llm = m) + count(*) FILTER (ideal = m)) AS f1 FROM q, (SELECT DISTINCT llm AS m FROM edges) GROUP BY m),
 lv AS (SELECT task_id AS name, * FROM q UNION ALL SELECT 'ALL', * FROM q)
SELECT name, count(*) AS n, round(avg(utility), 6) AS utility, round(avg(iu), 6) AS ideal_utility, round(avg(CAST(effect > 0 AS INT)), 6) AS accuracy,
 round(sum(CAST(round(cost_usd * 1e9) AS BIGINT)) / 1e9, 9) AS total_cost, round((SELECT avg(f1) FROM m), 6) AS macro_f1 FROM lv GROUP BY name""")
def _(spark, d):
    from routelab.scale import seeded_hash
    e = utility_edges(spark, d).withColumn("utility", 0.5 * F.col("effect") - 0.5 * F.col("cost"))
    dec = e.groupBy("task_id", "record_index").agg(F.min_by("llm", seeded_hash(7, "task_id", "record_index", "llm")).alias("model_name"))
    r = D.utility_report(e, dec)
    return r.select("name", "n", *[F.round(x, 9 if x == "total_cost" else 6).alias(x) for x in r.columns[2:]])


@query("headline_metrics", "latest", PICK + f""", per AS (SELECT model_name AS method, avg(score) AS acc, sum({NANO}) / 1e9 AS cost FROM latest GROUP BY 1),
 fr AS (SELECT * FROM per a WHERE NOT EXISTS (SELECT 1 FROM per b WHERE b.acc >= a.acc AND b.cost <= a.cost AND (b.acc > a.acc OR b.cost < a.cost))),
 dist AS (SELECT p.method, min(sqrt(pow(f.acc - p.acc, 2) + pow((f.cost - p.cost) / 20.0, 2))) AS x FROM per p, fr f GROUP BY 1),
 a AS (SELECT (SELECT avg(score) FROM pick) AS router, (SELECT min(acc) FROM per) AS random, (SELECT max(acc) FROM per) AS best,
  (SELECT avg(hit) FROM (SELECT max(score) AS hit FROM latest GROUP BY dataset_id, split, record_index)) AS oracle)
SELECT round(router / random - 1, 6) AS gain_at_random, round(router / best - 1, 6) AS gain_at_best, round(1 - router / oracle, 6) AS gap_at_oracle,
 round((SELECT max(acc) FROM per) / 0.36 - 1, 6) AS perf_gain, round(coalesce((SELECT max(1 - cost / 20.0) FROM per WHERE acc >= 0.36), 0.0), 6) AS cost_save,
 round((SELECT avg(x) FROM dist), 6) AS pareto_dist FROM a""")
def _(spark, d):
    from routelab.functions.money import sum_money
    r = V.latest(spark, d)
    per = r.groupBy(F.col("model_name").alias("method")).agg(F.avg("score").alias("accuracy"), sum_money("cost").alias("cost"))
    router = S.question_outcomes(r).agg(F.avg("random_score").alias("router"), L(1).alias("k"))
    ends = per.agg(F.min("accuracy").alias("random"), F.max("accuracy").alias("best_single"), L(1).alias("k"))
    oracle = r.groupBy(*Q3).agg(F.max("score").alias("h")).agg(F.avg("h").alias("oracle"), L(1).alias("k"))
    return rounded(D.headline_metrics(router.join(ends, "k").join(oracle, "k"), per, 0.36, 20.0), 6)


@query("merge_run_reports", "latest", """, c AS (SELECT CAST(record_index % 3 AS VARCHAR) AS seed, dataset_id, avg(CAST(score > 0 AS INT)) AS a, count(*) AS n FROM latest GROUP BY ALL)
SELECT seed, """ + ", ".join(f"round(max(a * 100) FILTER (dataset_id = '{n}'), 9) AS \"{n}\"" for n in ("1-URGENT", "2-HIGH", "3-MEDIUM")) +
       """, round(avg(a) * 100, 9) AS all_dataset_avg, round(sum(a * n) / sum(n) * 100, 9) AS sample_avg FROM c GROUP BY seed""")
def _(spark, d):
    from routelab.functions.money import sum_money
    from routelab.scale import shared_dir
    from routelab.sources.runs import read_reports
    # one report document per seed, written and read back
    path = f"{shared_dir(spark)}/reports-{spark.sparkContext.applicationId}"
    per = V.latest(spark, d).groupBy((F.col("record_index") % 3).alias("seed"), "dataset_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("score") > 0).alias("hit"), sum_money("cost").alias("total_cost"))
    acc = F.col("hit") / F.col("total")
    doc = per.groupBy("seed").agg(
        F.avg(acc).alias("all_dataset_avg"), (F.sum("hit") / F.sum("total")).alias("sample_avg"), F.sum("total_cost").alias("total_cost"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset_id", F.struct(
            "total", acc.alias("selection_accuracy"), L(None).cast("double").alias("routing_accuracy"), "total_cost"))))).alias("datasets"))
    doc.write.mode("overwrite").partitionBy("seed").json(path)
    return rounded(D.merge_run_reports(read_reports(spark, path), datasets=["1-URGENT", "2-HIGH", "3-MEDIUM"]))
