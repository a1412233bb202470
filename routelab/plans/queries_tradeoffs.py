"""Queries over configuration sweeps and Pareto frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from routelab.operators import tradeoffs as T
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.scale import shared_dir

_POINTS = """, pts AS (SELECT o_orderstatus AS grp, o_orderkey AS id, o_totalprice AS cost, CAST(o_custkey AS DOUBLE) AS acc FROM orders)"""


@query("pareto_join", "", _POINTS + """ SELECT grp, id, cost, acc FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.grp = a.grp AND b.acc >= a.acc AND b.cost <= a.cost AND (b.acc > a.acc OR b.cost < a.cost))""")
def _(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("cost"),
                                           F.col("o_custkey").cast("double").alias("acc"))
    return T.pareto_join(o, "cost", "acc", ["grp"])


def _configs(spark):
    return T.weight_grid(spark, 0.0, 1.0, 0.1)


def _sweep(spark, d):
    a = V.dense(spark, d).withColumn("cluster_id", F.col("label") % 8)
    return T.sweep(a, a, _configs(spark))


SWEEP = """, a AS (SELECT label % 8 AS cluster_id, dataset_id, model_name, score, CAST(round(cost * 1e9) AS BIGINT) AS c FROM dense),
 m AS (SELECT cluster_id, model_name, avg(score) AS accuracy, sum(c) / 1e9 / count(*) AS avg_cost FROM a GROUP BY ALL),
 n AS (SELECT *, (accuracy - min(accuracy) OVER w) / (max(accuracy) OVER w - min(accuracy) OVER w) AS na, 1 - avg_cost / max(avg_cost) OVER w AS nc FROM m WINDOW w AS (PARTITION BY cluster_id)),
 g AS (SELECT round(i * CAST(0.1 AS DOUBLE), 9) AS w, round(1 - round(i * CAST(0.1 AS DOUBLE), 9), 9) AS s FROM range(11) x(i)),
 pick AS (SELECT w, s, cluster_id, model_name FROM n, g QUALIFY row_number() OVER (PARTITION BY w, cluster_id ORDER BY round(w * na + s * nc, 12) DESC, model_name) = 1),
 per AS (SELECT w, s, dataset_id, count(*) AS n, sum(score) AS sc, sum(c) AS c FROM pick JOIN a USING (cluster_id, model_name) GROUP BY ALL),
 sweep AS (SELECT w AS performance_weight, s AS cost_sensitivity, round(avg(sc / n), 12) AS accuracy, sum(sc) / sum(n) AS sample_accuracy, sum(c) / 1e9 AS total_cost, sum(c) / 1e9 / sum(n) AS avg_cost_per_query,
  round(avg(sc / n), 12) / (sum(c) / 1e9 / sum(n) + 1e-8) AS cost_efficiency FROM per GROUP BY w, s)"""


@query("sweep", "dense", SWEEP + """ SELECT performance_weight, cost_sensitivity, round(accuracy, 6) AS accuracy, round(sample_accuracy, 6) AS sample_accuracy, round(total_cost, 6) AS total_cost,
 round(avg_cost_per_query, 6) AS avg_cost_per_query, round(cost_efficiency, 6) AS cost_efficiency FROM sweep""")
def _(spark, d):
    return rounded(_sweep(spark, d), 6)


_FINE = 96

# Ward merging of the fine clusters, a step per row: s is the list of clusters left, f the map from fine to merged ids
LEVELS = """, fv AS (SELECT record_index % 96 AS f, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM prompt_vectors),
 fc AS (SELECT f, round(avg(CAST(x AS DOUBLE)), 6) AS x, i FROM fv GROUP BY f, i),
 fn AS (SELECT record_index % 96 AS f, CAST(count(*) AS DOUBLE) AS n FROM prompt_vectors GROUP BY 1),
 fine AS (SELECT f, any_value(n) AS n, list(x ORDER BY i) AS c FROM fc JOIN fn USING (f) GROUP BY f),
 tree AS (SELECT 0 AS step, list({'f': f, 'n': n, 'c': c} ORDER BY f) AS s, list({'fine': f, 'id': f}) AS f, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM fine
  UNION ALL SELECT step + 1, [CASE WHEN x.f = p.a THEN {'f': x.f, 'n': x.n + y.n, 'c': [(x.n * x.c[i] + y.n * y.c[i]) / (x.n + y.n) for i in range(1, len(x.c) + 1)]} ELSE x END for x in s if x.f <> p.b],
   [{'fine': m.fine, 'id': CASE WHEN m.id = p.b THEN p.a ELSE m.id END} for m in f], p.a, p.b
  FROM (SELECT step, s, f, p, list_filter(s, lambda z: z.f = p.b)[1] AS y FROM (
    SELECT step, s, f, list_sort(flatten([[{'cost': u.n * v.n / (u.n + v.n) * list_distance(u.c, v.c) ** 2, 'a': u.f, 'b': v.f} for v in s if v.f > u.f] for u in s]))[1] AS p FROM tree WHERE len(s) > 8))),
 ks AS (SELECT CAST(unnest([8, 12, 16, 20, 24, 32, 40, 48, 56, 64, 72, 80]) AS INT) AS n_clusters),
 levels AS (SELECT n_clusters, unnest(f).fine AS fine_id, unnest(f).id AS cluster_id FROM ks JOIN tree ON len(s) = greatest(8, least(n_clusters, (SELECT count(*) FROM fine))))"""


def _fine(spark, d):
    """96 fine clusters of the documents and, for those with a vector, their mean vector and size."""
    v = V.prompt_vectors(spark, d).withColumn("cluster_id", F.col("record_index") % _FINE)
    long = v.select("cluster_id", F.posexplode("embedding").alias("i", "x")).groupBy("cluster_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    centers = long.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    return centers.join(v.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id")


@query("merge_levels", "prompt_vectors", LEVELS + " SELECT n_clusters, CAST(fine_id AS BIGINT) AS fine_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM levels", recursive=True)
def _(spark, d):
    return T.merge_levels(_fine(spark, d), T.k_grid(spark))


@query("sweep_clusters", "dense prompt_vectors", LEVELS + """, a AS (SELECT record_index % 96 AS fine_id, dataset_id, model_name, score, CAST(round(cost * 1e9) AS BIGINT) AS c FROM dense),
 al AS (SELECT n_clusters, cluster_id, a.* FROM a JOIN levels USING (fine_id)),
 m AS (SELECT n_clusters, cluster_id, model_name, avg(score) AS accuracy, sum(c) / 1e9 / count(*) AS avg_cost FROM al GROUP BY ALL),
 n AS (SELECT *, CASE WHEN max(accuracy) OVER w > min(accuracy) OVER w THEN (accuracy - min(accuracy) OVER w) / (max(accuracy) OVER w - min(accuracy) OVER w) ELSE 1 END AS na, 1 - avg_cost / max(avg_cost) OVER w AS nc
  FROM m WINDOW w AS (PARTITION BY n_clusters, cluster_id)),
 g AS (SELECT round(i * CAST(0.1 AS DOUBLE), 9) AS w, round(1 - round(i * CAST(0.1 AS DOUBLE), 9), 9) AS s FROM range(11) x(i)),
 pick AS (SELECT w, s, n_clusters, cluster_id, model_name FROM n, g QUALIFY row_number() OVER (PARTITION BY w, n_clusters, cluster_id ORDER BY round(w * na + s * nc, 12) DESC, model_name) = 1),
 per AS (SELECT n_clusters, w, s, dataset_id, count(*) AS n, sum(score) AS sc, sum(c) AS c FROM pick JOIN al USING (n_clusters, cluster_id, model_name) GROUP BY ALL)
SELECT n_clusters, w AS performance_weight, s AS cost_sensitivity, round(avg(sc / n), 6) AS accuracy, round(sum(sc) / sum(n), 6) AS sample_accuracy, round(sum(c) / 1e9, 6) AS total_cost,
 round(sum(c) / 1e9 / sum(n), 6) AS avg_cost_per_query, round(round(avg(sc / n), 12) / (sum(c) / 1e9 / sum(n) + 1e-8), 6) AS cost_efficiency FROM per GROUP BY n_clusters, w, s""", recursive=True)
def _(spark, d):
    a = V.dense(spark, d).withColumn("cluster_id", F.col("record_index") % _FINE)
    return rounded(T.sweep_clusters(a, a, T.merge_levels(_fine(spark, d), T.k_grid(spark)), _configs(spark)), 6)


@query("weight_grid", "dense", SWEEP + " SELECT DISTINCT model_name, w AS performance_weight, s AS cost_sensitivity FROM m, g")
def _(spark, d):
    m = V.dense(spark, d).select("model_name").distinct()
    cfg = _configs(spark).agg(F.collect_list(F.struct("performance_weight", "cost_sensitivity")).alias("c"), F.lit(1).alias("k"))
    return m.withColumn("k", F.lit(1)).join(cfg, "k").select("model_name", F.explode("c").alias("c")).select("model_name", "c.*")


@query("pareto_frontier", "dense", SWEEP + """ SELECT performance_weight, round(accuracy, 6) AS accuracy, round(total_cost, 6) AS total_cost FROM sweep x WHERE NOT EXISTS (SELECT 1 FROM sweep y
 WHERE y.accuracy >= x.accuracy AND y.total_cost <= x.total_cost AND (y.accuracy > x.accuracy OR y.total_cost < x.total_cost))""")
def _(spark, d):
    return rounded(T.pareto_frontier(_sweep(spark, d), "total_cost", "accuracy").select("performance_weight", "accuracy", "total_cost"), 6)


@query("tradeoff_summary", "dense", SWEEP + """ SELECT count(*) AS n, round(corr(performance_weight, accuracy), 6) AS corr_weight_accuracy, round(corr(performance_weight, avg_cost_per_query), 6) AS corr_weight_cost,
 round(corr(accuracy, avg_cost_per_query), 6) AS corr_accuracy_cost, round(max(accuracy), 6) AS max_accuracy, round(min(accuracy), 6) AS min_accuracy,
 arg_max(performance_weight, (accuracy, -performance_weight)) AS weight_at_max_accuracy, arg_min(performance_weight, (avg_cost_per_query, performance_weight)) AS weight_at_min_cost,
 round((max(accuracy) - min(accuracy)) / (max(avg_cost_per_query) - min(avg_cost_per_query)), 6) AS accuracy_per_cost FROM sweep""")
def _(spark, d):
    return rounded(T.tradeoff_summary(_sweep(spark, d)), 6)


@query("trend", "recs", """, p AS (SELECT model_name, CAST(run_no AS DOUBLE) AS x, avg(score) AS y FROM recs GROUP BY ALL)
SELECT model_name, round(regr_slope(y, x), 6) AS slope, CASE WHEN abs(regr_slope(y, x)) < 1e-6 THEN 'stable' WHEN regr_slope(y, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM p GROUP BY 1""")
def _(spark, d):
    p = V.recs(spark, d).groupBy("model_name", F.col("run_no").cast("double").alias("x")).agg(F.avg("score").alias("y"))
    return rounded(T.trend(p, "x", "y", ["model_name"]), 6)


@query("optimal_configs", "dense", SWEEP + """, o AS (SELECT *, (SELECT list(performance_weight ORDER BY performance_weight)[6] FROM sweep) AS med FROM sweep),
 k AS (SELECT 'best_accuracy' AS criterion, -accuracy AS v, * FROM o UNION ALL SELECT 'lowest_cost', avg_cost_per_query, * FROM o WHERE accuracy > 0.3 UNION ALL SELECT 'best_efficiency', -cost_efficiency, * FROM o
  UNION ALL SELECT 'most_balanced', round(abs(performance_weight - 0.5), 9), * FROM o UNION ALL SELECT 'best_product', -accuracy * cost_efficiency, * FROM o UNION ALL SELECT 'most_stable', round(abs(performance_weight - med), 9), * FROM o)
SELECT criterion, performance_weight, round(accuracy, 6) AS accuracy, round(avg_cost_per_query, 6) AS avg_cost_per_query, round(cost_efficiency, 6) AS cost_efficiency FROM k
QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY v, performance_weight) = 1""")
def _(spark, d):
    return rounded(T.optimal_configs(_sweep(spark, d)), 6)


@query("beats_baseline", "dense", SWEEP + """, b AS (SELECT max(a) AS base FROM (SELECT avg(a) AS a FROM (SELECT model_name, dataset_id, avg(score) AS a FROM dense GROUP BY ALL) GROUP BY model_name))
SELECT count(*) AS n_configs, count(*) FILTER (accuracy > base) AS n_better, min(performance_weight) FILTER (accuracy > base) AS min_x, max(performance_weight) FILTER (accuracy > base) AS max_x,
 round(avg(accuracy - base) FILTER (accuracy > base), 6) AS mean_gain, median(performance_weight) FILTER (accuracy > base) AS median_x, round(100.0 * count(*) FILTER (accuracy > base) / count(*), 6) AS percent FROM sweep, b""")
def _(spark, d):
    per = V.dense(spark, d).groupBy("model_name", "dataset_id").agg(F.avg("score").alias("a")).groupBy("model_name").agg(F.avg("a").alias("a"))
    base = per.agg(F.max("a")).first()[0]
    return rounded(T.beats_baseline(_sweep(spark, d), base), 6)


@query("export_sweep", "dense", SWEEP + " SELECT performance_weight, round(accuracy, 6) AS accuracy FROM sweep")
def _(spark, d):
    path = f"{shared_dir(spark)}/sweep-{spark.sparkContext.applicationId}"
    T.export_sweep(_sweep(spark, d), path)
    back = spark.read.option("header", True).schema("performance_weight double, cost_sensitivity double, accuracy double, sample_accuracy double, total_cost double, avg_cost_per_query double, cost_efficiency double").csv(path)
    return rounded(back.select("performance_weight", "accuracy"), 6)
