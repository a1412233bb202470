"""Queries over neighbours, cluster routers, utilities, linear models and cascades."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from routelab.operators import cascade as C
from routelab.operators import neighbors as N
from routelab.operators import routers as R
from routelab.plans import views as V
from routelab.plans.catalog import query, rounded
from routelab.plans.queries_decisions import SCORED, UTIL, scored, utility_edges
from routelab.scale import seeded_hash, shared_dir

L = F.lit
D = "CAST({} AS DOUBLE[])"


def _fixed_centers(spark, d):
    """Label means of the vectors: centres that do not depend on a fit."""
    v = V.prompt_vectors(spark, d)
    long = v.select("cluster_id", F.posexplode("embedding").alias("i", "x")).groupBy("cluster_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return long.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


_CENTERS = """, cx AS (SELECT cluster_id, i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM prompt_vectors) GROUP BY ALL),
 centers AS (SELECT cluster_id, list(x ORDER BY i) AS center FROM cx GROUP BY 1),
 dist AS (SELECT dataset_id, record_index, c.cluster_id, 1 - list_inner_product(CAST(embedding AS DOUBLE[]), center) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS d
  FROM prompt_vectors p, centers c),
 near AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY d, cluster_id) AS place FROM dist)"""


@query("assign_nearest_centroid", "prompt_vectors", _CENTERS + " SELECT dataset_id, record_index, cluster_id, place, round(d, 6) AS distance FROM near WHERE place <= 3")
def _(spark, d):
    a = R.assign_nearest_centroid(V.prompt_vectors(spark, d).drop("cluster_id"), _fixed_centers(spark, d), 3)
    return rounded(a.select("dataset_id", "record_index", F.col("cluster_id").cast("bigint").alias("cluster_id"), "place", "distance"), 6)


@query("route_by_cluster", "dense prompt_vectors", _CENTERS + """, rk AS (SELECT label % 8 AS cluster_id, model_name, row_number() OVER (PARTITION BY label % 8 ORDER BY avg(score) DESC, model_name) AS rank FROM dense GROUP BY label % 8, model_name),
 w AS (SELECT dataset_id, record_index, cluster_id, exp(-9 * d) / sum(exp(-9 * d)) OVER (PARTITION BY dataset_id, record_index) AS w FROM near WHERE place <= 3),
 s AS (SELECT dataset_id, record_index, model_name, round(sum(w / rank), 12) AS s FROM w JOIN rk USING (cluster_id) GROUP BY ALL)
SELECT dataset_id, record_index, model_name, round(s, 6) AS expert_score, row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY s DESC, model_name) AS rank FROM s QUALIFY rank <= 2""")
def _(spark, d):
    from routelab.operators.splits import rank_models_in_cluster
    train = V.dense(spark, d).withColumn("cluster_id", F.col("label") % 8)
    model = R.RouterModel(_fixed_centers(spark, d), rank_models_in_cluster(train, V.MODELS))
    return rounded(R.route_by_cluster(V.prompt_vectors(spark, d).drop("cluster_id"), model, top_k=3, max_router=2), 6)


@query("fit_cluster_router", "prompt_vectors", """ SELECT CAST(count(*) AS BIGINT) AS n_routed, 8 AS n_clusters, true AS ranks_whole, true AS nearer_than_the_mean, true AS models_known FROM prompt_vectors""")
def _(spark, d):
    # what any right fit has: every prompt decided, whole rankings, and less distance to the centres than to the mean of all vectors
    v = V.prompt_vectors(spark, d).drop("cluster_id")
    m = R.fit_cluster_router(V.dense(spark, d), v, n_clusters=8, n_init=10)
    routed = R.route_by_cluster(v, m).agg(F.count("*").alias("n_routed"), F.min(F.col("model_name").isin(V.MODELS)).alias("models_known"), L(1).alias("k"))
    ranks = m.ranking.groupBy("cluster_id").agg((F.sort_array(F.collect_list("rank")) == F.array(*[L(i + 1) for i in range(len(V.MODELS))])).alias("ok")).agg(
        F.count("*").cast("int").alias("n_clusters"), F.min("ok").alias("ranks_whole"), L(1).alias("k"))
    unit = R._unit(v, "embedding").select(F.posexplode("_u").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    mean = unit.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center")).withColumn("cluster_id", L(0))
    far = [R.assign_nearest_centroid(v, c).agg(F.avg("distance").alias(n), L(1).alias("k")) for c, n in ((m.centers, "own"), (mean, "all"))]
    return routed.join(ranks, "k").join(far[0].join(far[1], "k").select((F.col("own") < F.col("all")).alias("nearer_than_the_mean"), "k"), "k").select(
        "n_routed", "n_clusters", "ranks_whole", "nearer_than_the_mean", "models_known")


_BALANCE = """, a AS (SELECT label % 8 AS cluster_id, model_name, score, CAST(round(cost * 1e9) AS BIGINT) AS c FROM dense),
 m AS (SELECT cluster_id, model_name, avg(score) AS accuracy, sum(c) / 1e9 / count(*) AS avg_cost, count(*) AS total_queries, avg(c) AS mc FROM a GROUP BY ALL),
 b AS (SELECT *, 0.7 * CASE WHEN max(accuracy) OVER w > min(accuracy) OVER w THEN (accuracy - min(accuracy) OVER w) / (max(accuracy) OVER w - min(accuracy) OVER w) ELSE 1 END
   + 0.3 * (1 - avg_cost / max(avg_cost) OVER w) AS balance FROM m WINDOW w AS (PARTITION BY cluster_id))"""


@query("fit_balance_router", "dense", _BALANCE + """ SELECT cluster_id, model_name, round(accuracy, 9) AS accuracy, round(avg_cost, 9) AS avg_cost, total_queries, round(CASE WHEN accuracy >= 0.2 THEN balance ELSE 0 END, 9) AS balance,
 row_number() OVER (PARTITION BY cluster_id ORDER BY round(CASE WHEN accuracy >= 0.2 THEN balance ELSE 0 END, 12) DESC, model_name) AS rank,
 round((SELECT 100.0 * count(*) FILTER (a.c < b.mc) / count(*) FROM a WHERE a.cluster_id = b.cluster_id), 9) AS cost_percentile,
 NOT EXISTS (SELECT 1 FROM m x WHERE x.cluster_id = b.cluster_id AND x.accuracy >= b.accuracy AND x.avg_cost <= b.avg_cost AND (x.accuracy > b.accuracy OR x.avg_cost < b.avg_cost)) AS pareto FROM b""")
def _(spark, d):
    b = R.fit_balance_router(V.dense(spark, d).withColumn("cluster_id", F.col("label") % 8), 0.7, 0.3, 0.2)
    return rounded(b.select("cluster_id", "model_name", "accuracy", "avg_cost", "total_queries", "balance", "rank", "cost_percentile", "pareto"))


def _halves(spark, d):
    """Vectors split by a seeded hash into train and test."""
    v = V.prompt_vectors(spark, d).drop("cluster_id")
    return v.where(seeded_hash(3, "prompt") >= "4"), v.where(seeded_hash(3, "prompt") < "4")


@query("assign_clusters_global", "prompt_vectors", """ SELECT CASE WHEN md5('3|' || prompt) >= '4' THEN 'train' ELSE 'test' END AS side, CAST(count(*) AS BIGINT) AS n, true AS in_range, true AS nearest FROM prompt_vectors GROUP BY 1""")
def _(spark, d):
    tr, te = _halves(spark, d)
    a, b = R.assign_clusters_global(tr, te, 10)
    both = a.withColumn("side", L("train")).unionByName(b.withColumn("side", L("test")))
    # a training centre is the mean of its rows: no row of a cluster lies nearer to the mean of another
    long = a.select("cluster_id", F.posexplode("embedding").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = long.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center")).orderBy("cluster_id").collect()
    fit = R.Clusters(np.array([r["center"] for r in means]), 0.0)
    again = fit.assign(both, "embedding", "at").withColumn("again", F.element_at(F.array(*[L(r["cluster_id"]) for r in means]), F.col("at") + 1))
    return again.groupBy("side").agg(F.count("*").alias("n"), F.min(F.col("cluster_id").between(0, 9)).alias("in_range"), (F.avg((F.col("again") == F.col("cluster_id")).cast("int")) > 0.99).alias("nearest"))


_KNN = """, v AS (SELECT record_index AS id, CAST(embedding AS DOUBLE[]) AS e, md5('3|' || prompt) < '4' AS is_test FROM prompt_vectors),
 nn AS (SELECT q.id AS test_id, t.id AS train_id, list_distance(q.e, t.e) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, t.e), t.id) AS rank FROM v q, v t WHERE q.is_test AND NOT t.is_test)"""


@query("knn_join", "prompt_vectors", _KNN + " SELECT test_id, train_id, rank, round(d, 6) AS distance FROM nn WHERE rank <= 15")
def _(spark, d):
    tr, te = _halves(spark, d)
    j = N.knn_join(te.withColumnRenamed("record_index", "test_id"), tr.withColumnRenamed("record_index", "train_id"), 15)
    return rounded(j.select("test_id", "train_id", "rank", "distance"), 6)


@query("approx_knn_join", "prompt_vectors", _KNN + " SELECT count(DISTINCT test_id) AS n_queries, true AS recall_reached, true AS distances_exact, true AS ranks_whole FROM nn")
def _(spark, d):
    tr, te = (x.withColumnRenamed("record_index", n) for x, n in zip(_halves(spark, d), ("train_id", "test_id")))
    exact, got = N.knn_join(te, tr, 15), N.approx_knn_join(te, tr, 15, 0.95)
    j = exact.select("test_id", "train_id", F.col("distance").alias("d")).join(got, ["test_id", "train_id"], "full")
    per = got.groupBy("test_id").agg((F.max("rank") == F.count("*")).alias("whole")).agg(F.min("whole").alias("whole"), F.count("*").alias("n"))
    found = j.agg((F.count_if(F.col("d").isNotNull() & F.col("distance").isNotNull()) / F.count("d")).alias("recall"), F.max(F.abs(F.col("d") - F.col("distance"))).alias("off"))
    n, one = te.where("embedding is not null").select(F.count("*").cast("bigint").alias("n_queries"), L(1).alias("k")), L(1).alias("k")
    return n.join(found.select((F.col("recall") >= 0.9).alias("recall_reached"), (F.col("off") < 1e-9).alias("distances_exact"), one), "k").join(per.select(F.col("whole").alias("ranks_whole"), one), "k").drop("k")


@query("knn_router", "dense prompt_vectors", _KNN + """, vt AS (SELECT test_id, model_name, CAST(avg(score) > 0.5 AS INT) AS predicted FROM nn JOIN dense ON record_index = train_id WHERE rank <= 31 GROUP BY ALL),
 r AS (SELECT vt.model_name, CAST(CAST(d.score AS INT) = predicted AS INT) AS ok FROM vt JOIN dense d ON d.record_index = vt.test_id AND d.model_name = vt.model_name),
 per AS (SELECT model_name AS name, avg(ok) AS a, count(*) AS n FROM r GROUP BY 1)
SELECT name, round(a, 6) AS accuracy, n FROM per UNION ALL SELECT 'ALL', round(avg(a), 6), CAST(sum(n) AS BIGINT) FROM per""")
def _(spark, d):
    tr, te = _halves(spark, d)
    lab = V.dense(spark, d).select("record_index", "model_name", F.col("score").cast("int").alias("label"))
    r = N.knn_router(te.withColumnRenamed("record_index", "test_id"), tr.withColumnRenamed("record_index", "train_id"),
                     lab.withColumnRenamed("record_index", "test_id"), lab.withColumnRenamed("record_index", "train_id"), 31)
    return rounded(N.knn_accuracy(r), 6)


@query("utility_router", "dense", UTIL + """ SELECT task_id, record_index, llm, round(utility, 9) AS utility, CAST(abs(utility - max(utility) OVER w) <= 1e-8 + 1e-5 * abs(max(utility) OVER w) AS INT) AS is_best,
 first_value(llm) OVER (PARTITION BY task_id, record_index ORDER BY utility DESC, llm) AS chosen FROM ut WINDOW w AS (PARTITION BY task_id, record_index)""")
def _(spark, d):
    return rounded(R.utility_router(utility_edges(spark, d), "Balance").select("task_id", "record_index", "llm", "utility", "is_best", "chosen"))


@query("cost_threshold_sweep", "dense", SCORED + """, c AS (SELECT sample_id AS id, CAST(substr(model_name, 2) AS INT) AS idx, probability AS margin, CAST(round(cost * 1e9) AS BIGINT) AS c, score FROM scored),
 t AS (SELECT s AS step, (SELECT min(margin) FROM c) + ((SELECT max(margin) FROM c) - (SELECT min(margin) FROM c)) * s / 20.0 AS t FROM range(21) x(s)),
 p AS (SELECT step, t, id, coalesce(arg_min(c, (c, idx)) FILTER (margin >= t), arg_max(c, idx)) AS c, coalesce(arg_min(score, (c, idx)) FILTER (margin >= t), arg_max(score, idx)) AS s FROM c, t GROUP BY step, t, id)
SELECT CAST(step AS INT) AS step, round(CAST(any_value(t) AS DOUBLE), 9) AS threshold, round(avg(s), 9) AS mean_score, round(sum(c) / 1e9, 9) AS total_cost FROM p GROUP BY step""")
def _(spark, d):
    c = scored(spark, d).select(F.col("sample_id").alias("id"), F.substring("model_name", 2, 1).cast("int").alias("idx"), F.col("probability").alias("margin"), "cost", "score")
    return rounded(R.cost_threshold_sweep(c))


@query("linear_win_rate", "dense prompt_vectors", """, w AS (SELECT record_index, max(score) FILTER (model_name = 'm7') AS a, max(score) FILTER (model_name = 'm2') AS b FROM dense GROUP BY 1),
 p AS (SELECT a > b AS win FROM w JOIN prompt_vectors USING (record_index) WHERE a <> b)
SELECT (SELECT count(*) FROM prompt_vectors) AS n, true AS in_range, true AS better_than_majority, (SELECT count(*) FROM p) AS n_decided""")
def _(spark, d):
    from routelab.operators.shapes import pair_models
    vec = V.prompt_vectors(spark, d).drop("cluster_id")
    pairs = pair_models(V.dense(spark, d), "m7", "m2", True)
    rates = R.win_rates(R.linear_win_rate(pairs, vec), vec)
    win = (F.col("winner") == "model_a").cast("int")
    known = pairs.where("winner <> 'tie'").join(rates, ["dataset_id", "prompt"]).agg(F.count("*").alias("n_decided"), F.avg(((F.col("winrate") >= 0.5).cast("int") == win).cast("int")).alias("right"),
                                                                                     F.avg(win).alias("share"), L(1).alias("k"))
    return rates.agg(F.count("*").alias("n"), F.min(F.col("winrate").between(0, 1)).alias("in_range"), L(1).alias("k")).join(known, "k").select(
        "n", "in_range", (F.col("right") >= F.greatest("share", 1 - F.col("share"))).alias("better_than_majority"), "n_decided")


@query("per_model_correctness", "dense prompt_vectors", """ SELECT count(*) AS n, true AS in_range, true AS models_known, true AS better_than_best_single FROM prompt_vectors""")
def _(spark, d):
    vec = V.prompt_vectors(spark, d).drop("cluster_id")
    facts = V.dense(spark, d)
    m = R.per_model_correctness(facts.where("embedding is not null").select("dataset_id", "prompt", "model_name", F.col("score").alias("label")), vec)
    chosen = R.route_by_correctness(m, vec, V.MODELS)
    seen = facts.where("embedding is not null").select("dataset_id", "prompt", "model_name", "score")
    got = chosen.join(seen, ["dataset_id", "prompt", "model_name"]).agg(F.count("*").alias("n"), F.min(F.col("probability").between(0, 1)).alias("in_range"),
                                                                        F.min(F.col("model_name").isin(V.MODELS)).alias("models_known"), F.avg("score").alias("own"), L(1).alias("k"))
    single = seen.groupBy("model_name").agg(F.avg("score").alias("s")).agg(F.max("s").alias("single"), L(1).alias("k"))
    return got.join(single, "k").select("n", "in_range", "models_known", (F.col("own") > F.col("single")).alias("better_than_best_single"))


@query("export_router", "dense", """ SELECT CAST(label % 8 AS BIGINT) AS cluster_id, model_name, round(avg(score), 9) AS mean_score, count(*) AS n, round(sum(CAST(round(cost * 1e9) AS BIGINT)) / 1e9 / count(*), 9) AS mean_cost,
 row_number() OVER (PARTITION BY label % 8 ORDER BY avg(score) DESC, model_name) AS rank FROM dense GROUP BY label % 8, model_name""")
def _(spark, d):
    from routelab.operators.splits import rank_models_in_cluster
    path = f"{shared_dir(spark)}/router-{uuid.uuid4().hex}"
    ranking = rank_models_in_cluster(V.dense(spark, d).withColumn("cluster_id", (F.col("label") % 8).cast("bigint")), V.MODELS)
    R.export_router(R.RouterModel(_fixed_centers(spark, d), ranking), path)
    return rounded(R.load_router(spark, path).ranking)


@query("export_balance_router", "dense prompt_vectors", _CENTERS + _BALANCE + """, rk AS (SELECT cluster_id, model_name, row_number() OVER (PARTITION BY cluster_id ORDER BY round(CASE WHEN accuracy >= 0.2 THEN balance ELSE 0 END, 12) DESC, model_name) AS rank FROM b),
 w AS (SELECT dataset_id, record_index, cluster_id, exp(-5 * d) / sum(exp(-5 * d)) OVER (PARTITION BY dataset_id, record_index) AS w FROM near WHERE place <= 4),
 s AS (SELECT dataset_id, record_index, model_name, round(sum(w / rank), 12) AS s FROM w JOIN rk USING (cluster_id) GROUP BY ALL)
SELECT dataset_id, record_index, model_name, round(s, 6) AS expert_score, row_number() OVER (PARTITION BY dataset_id, record_index ORDER BY s DESC, model_name) AS rank FROM s QUALIFY rank <= 3""")
def _(spark, d):
    path = f"{shared_dir(spark)}/router-{uuid.uuid4().hex}"
    model = R.balance_router(_fixed_centers(spark, d), V.dense(spark, d).withColumn("cluster_id", F.col("label") % 8), 0.7, 0.3, 0.2, top_k=4, beta=5.0, max_router=3)
    R.export_router(model, path)
    return rounded(R.route(V.prompt_vectors(spark, d).drop("cluster_id"), R.load_router(spark, path)), 6)


@query("project_embeddings", "prompt_vectors", """, x AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM prompt_vectors), v AS (SELECT i, var_pop(CAST(x AS DOUBLE)) AS v FROM x GROUP BY i)
SELECT (SELECT count(*) FROM prompt_vectors) AS n, true AS ordered, true AS uncorrelated, true AS beats_every_axis, true AS within_total, round((SELECT sum(v) FROM v), 6) AS total_variance""")
def _(spark, d):
    # the first component has the largest variance of all directions, the second is uncorrelated with it
    v = V.prompt_vectors(spark, d).drop("cluster_id")
    p = R.project_embeddings(v).select(F.col("projection")[0].alias("x"), F.col("projection")[1].alias("y"))
    got = p.agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.corr("x", "y").alias("c"), L(1).alias("k"))
    axes = v.select(F.posexplode("embedding").alias("i", "e")).groupBy("i").agg(F.var_pop(F.col("e").cast("double")).alias("v")).agg(F.max("v").alias("axis"), F.sum("v").alias("total"), L(1).alias("k"))
    return got.join(axes, "k").select("n", (F.col("vx") >= F.col("vy")).alias("ordered"), (F.abs("c") < 1e-6).alias("uncorrelated"), (F.col("vx") >= F.col("axis") - 1e-9).alias("beats_every_axis"),
                                      (F.col("vx") + F.col("vy") <= F.col("total") + 1e-9).alias("within_total"), F.round("total", 6).alias("total_variance"))


# cascades

_ORDER = ["m0", "m3", "m6"]


@query("cumulative_cascade_cost", "dense", SCORED + """ SELECT sample_id, model_name, round(sum(CAST(round(cost * 1e9) AS BIGINT)) OVER (PARTITION BY sample_id ORDER BY model_name) / 1e9, 9) AS cum_cost
FROM scored WHERE model_name IN ('m0', 'm3', 'm6')""")
def _(spark, d):
    return rounded(C.cumulative_cascade_cost(scored(spark, d), _ORDER).select("sample_id", "model_name", "cum_cost"))


@query("cascade_thresholds", "dense", SCORED + """, w AS (SELECT sample_id, 1 - max(probability) FILTER (model_name = 'm0') AS d0, 1 - max(probability) FILTER (model_name = 'm3') AS d1 FROM scored GROUP BY 1),
 t0 AS (SELECT quantile_cont(d0, 0.7) AS t FROM w), t1 AS (SELECT quantile_cont(d1, 0.4) AS t FROM w, t0 WHERE d0 >= t0.t)
SELECT CAST(1 AS INT) AS stage, round(t, 9) AS threshold FROM t0 UNION ALL SELECT 2, round(t, 9) FROM t1 UNION ALL SELECT 3, 1.0""")
def _(spark, d):
    t = C.cascade_thresholds(scored(spark, d), _ORDER, [0.3, 0.6])
    return rounded(spark.createDataFrame([(i + 1, x) for i, x in enumerate(t)], "stage int, threshold double"))


_RUN = SCORED + """, s AS (SELECT *, CASE model_name WHEN 'm0' THEN 1 WHEN 'm3' THEN 2 ELSE 3 END AS p, CAST(round(cost * 1e9) AS BIGINT) AS n,
  probability > 1.0 - CASE model_name WHEN 'm0' THEN 0.2 WHEN 'm3' THEN 0.4 ELSE 1.0 END AS ok FROM scored WHERE model_name IN ('m0', 'm3', 'm6')),
 st AS (SELECT dataset_id, sample_id, coalesce(min(p) FILTER (ok), max(p)) AS stop FROM s GROUP BY ALL),
 run AS (SELECT dataset_id, sample_id, max(model_name) FILTER (p = stop) AS model_name, max(label) FILTER (p = stop) AS label, CAST(sum(n) FILTER (p <= stop) AS BIGINT) AS n FROM s JOIN st USING (dataset_id, sample_id) GROUP BY dataset_id, sample_id)"""


@query("run_cascade", "dense", _RUN + " SELECT dataset_id, sample_id, model_name, label, round(n / 1e9, 9) AS cum_cost FROM run")
def _(spark, d):
    return rounded(C.run_cascade(scored(spark, d), C.Strategy(_ORDER, [0.2, 0.4, 1.0])).drop("probability"))


@query("cascade_report", "dense", _RUN + """, per AS (SELECT dataset_id AS name, count(*) AS n, avg(label) AS a, sum(n) AS c FROM run GROUP BY 1)
SELECT name, n, round(a, 9) AS accuracy, round(c / 1e9, 9) AS total_cost, round(c / 1e9 / n, 9) AS avg_cost FROM per
UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), round(avg(a), 9), round(sum(c) / 1e9, 9), round(sum(c) / 1e9 / sum(n), 9) FROM per""")
def _(spark, d):
    from routelab.operators.decisions import choice_report
    return rounded(choice_report(C.run_cascade(scored(spark, d), C.Strategy(_ORDER, [0.2, 0.4, 1.0])), "cum_cost"))


def _interpolated(values: str, prob: str) -> str:
    """Linear interpolation in a sorted list, written like the operator's so that equal values stay equal."""
    at = f"({prob}) * (len({values}) - 1)"
    return f"{values}[CAST(floor({at}) AS BIGINT) + 1] + ({values}[CAST(ceil({at}) AS BIGINT) + 1] - {values}[CAST(floor({at}) AS BIGINT) + 1]) * ({at} - floor({at}))"


@query("cascade_search", "dense", SCORED + f""", p AS (SELECT sample_id, model_name AS m, max(1 - probability) AS d, max(label) AS y, CAST(sum(round(cost * 1e9)) AS BIGINT) AS c FROM scored GROUP BY ALL),
 g AS (SELECT i, 0.00001 + (1 - 0.00002) * i / CAST(14 AS DOUBLE) AS q FROM range(15) x(i)),
 d1 AS (SELECT m, list(d ORDER BY d) AS ds, sum(c) AS c0, count(*) AS n FROM p GROUP BY m HAVING sum(c) <= 0.0008 * 1e9 * count(*)),
 t1 AS (SELECT m AS a, i, {_interpolated("ds", "1 - q")} AS t FROM d1, g),
 r1 AS (SELECT sample_id, a, i, t, d < t AS ok, y, c FROM p JOIN t1 ON m = a),
 b1 AS (SELECT a, i, count(*) AS n, coalesce(sum(y) FILTER (ok), 0) AS hits, coalesce(sum(c) FILTER (ok), 0) AS paid FROM r1 GROUP BY a, i),
 l1 AS (SELECT sample_id, a, i, c FROM r1 WHERE NOT ok),
 d2 AS (SELECT a, i, m AS b, list(d ORDER BY d) AS ds FROM l1 JOIN p USING (sample_id) WHERE m <> a GROUP BY ALL),
 t2 AS (SELECT a, d2.i AS i, b, g.i AS k, {_interpolated("ds", "1 - q")} AS t FROM d2, g WHERE g.i >= d2.i),
 r2 AS (SELECT sample_id, a, i, b, k, p.d < t2.t AS ok, y, l1.c + p.c AS c FROM l1 JOIN t2 USING (a, i) JOIN p USING (sample_id) WHERE p.m = b),
 b2 AS (SELECT a, i, b, k, coalesce(sum(y) FILTER (ok), 0) AS hits, coalesce(sum(c) FILTER (ok), 0) AS paid FROM r2 GROUP BY ALL),
 b3 AS (SELECT a, i, b, k, m AS z, coalesce(sum(p.y) FILTER (p.d < 1), 0) AS hits, coalesce(sum(r2.c + p.c) FILTER (p.d < 1), 0) AS paid FROM r2 JOIN p USING (sample_id) WHERE NOT r2.ok AND m <> a AND m <> b GROUP BY ALL),
 r AS (SELECT a, b, z, i, k, CAST(b1.hits + b2.hits + b3.hits AS DOUBLE) / n AS acc, b1.paid + b2.paid + b3.paid AS paid, n FROM b3 JOIN b2 USING (a, i, b, k) JOIN b1 USING (a, i)),
 top AS (SELECT * FROM r WHERE paid <= 0.0008 * 1e9 * n ORDER BY acc DESC, a, b, z, i, k LIMIT 1)
SELECT a || ',' || b || ',' || z AS model_order, round(t1.t, 6) AS threshold, round(t2.t, 6) AS second_threshold, round(acc, 6) AS accuracy FROM top JOIN t1 USING (a, i) JOIN t2 USING (a, i, b, k)""")
def _(spark, d):
    b = C.cascade_search(scored(spark, d), 0.0008, 3)
    return rounded(spark.createDataFrame([(",".join(b.order), *map(float, b.thresholds[:2]), float(b.accuracy))] if b else [],
                                         "model_order string, threshold double, second_threshold double, accuracy double"), 6)
