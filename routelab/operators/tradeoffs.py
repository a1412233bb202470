"""Trade-offs over many router configurations: grids, sweeps, Pareto frontiers, trends and best configurations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelab.functions.money import avg_money, clean_usage_cost, dollars, nano
from routelab.operators.stats import exact_quantiles
from routelab.scale import join_null_safe, ordered_running, stable

L = F.lit

# fixed values: cluster counts tried by default
CLUSTER_COUNTS = [8, 12, 16, 20, 24, 32, 40, 48, 56, 64, 72, 80]


def weight_grid(spark: SparkSession, lo: float = 0.0, hi: float = 1.0, step: float = 0.1) -> DataFrame:
    """(performance_weight, cost_sensitivity) pairs that add up to 1."""
    n = int(round((hi - lo) / step))
    w = F.round(L(lo) + F.col("id") * L(step), 9)
    return spark.range(n + 1).select(w.alias("performance_weight"), F.round(1 - w, 9).alias("cost_sensitivity"))


def k_grid(spark: SparkSession, lo: int | None = None, hi: int | None = None, step: int = 1) -> DataFrame:
    ks = CLUSTER_COUNTS if lo is None or hi is None else list(range(lo, hi + 1, step))
    return spark.createDataFrame([(k,) for k in ks], "n_clusters int")


def pareto_join(points: DataFrame, cost: str = "cost", score: str = "acc", by: Sequence[str] = ()) -> DataFrame:
    """Points that no other point beats (score >=, cost <=, one strictly); equal duplicates all stay.

    Costs reduce to levels, the running best score along the levels is computed in ordered buckets, and the
    frontier is where that best first reaches a value. Then points are looked up; nothing is compared pairwise.
    """
    by = list(by)
    p = points.where(F.col(cost).isNotNull() & F.col(score).isNotNull())
    levels = p.groupBy(*by, cost).agg(F.max(score).alias("_m"))
    best = ordered_running(levels, by, [cost], {"_best": ("max", "_m")})
    front = best.groupBy(*by, "_best").agg(F.min(cost).alias(cost)).withColumnRenamed("_best", score)
    return join_null_safe(p, front.select(*by, cost, score), [*by, cost, score], "left_semi")


pareto_frontier = pareto_join


def cluster_metrics(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per (cluster, model): accuracy, average cost, efficiency and the cluster's ranges."""
    m = assigned.withColumn("cost", clean_usage_cost("cost")).groupBy(cluster, "model_name").agg(
        F.avg("score").alias("accuracy"), avg_money("cost").alias("avg_cost"), F.count("*").alias("total_queries"),
        dollars(F.sum(nano("cost"))).alias("total_cost"))
    w = Window.partitionBy(cluster)  # rows per cluster = models
    return m.withColumn("cost_efficiency", F.col("accuracy") / (F.col("avg_cost") + L(1e-8))).withColumns({
        "_hi": F.max("accuracy").over(w), "_lo": F.min("accuracy").over(w), "_mc": F.max("avg_cost").over(w)})


def balance_score(weight: Column, sensitivity: Column, min_accuracy: float = 0.0) -> Column:
    """Weighted sum of min-max accuracy and cheapness inside a cluster; below the minimum accuracy 0."""
    acc = F.when(F.col("_hi") > F.col("_lo"), (F.col("accuracy") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
    cheap = F.when(F.col("_mc") > 0, 1.0 - F.col("avg_cost") / F.col("_mc")).otherwise(1.0)
    return F.when((F.col("total_queries") == 0) | (F.col("accuracy") < min_accuracy), 0.0).otherwise(weight * acc + sensitivity * cheap)


def sweep(assigned_train: DataFrame, assigned_test: DataFrame, configs: DataFrame, cluster: str = "cluster_id",
          keys: Sequence[str] = ("dataset_id", "record_index")) -> DataFrame:
    """Accuracy and cost of every (performance_weight, cost_sensitivity) row, in one job for all rows.

    The choice of a cluster depends on the configuration only, so configurations multiply the cluster x model
    table and the test side is reduced to (cluster, dataset, model) sums before they meet.
    """
    m = stable(cluster_metrics(assigned_train, cluster))
    t = assigned_test.groupBy(cluster, "dataset_id", "model_name").agg(
        F.count("*").alias("n"), F.sum("score").alias("sc"), F.sum(nano(clean_usage_cost("cost"))).alias("c"))
    return _sweep(m, t, configs, [], cluster)


def _sweep(metrics: DataFrame, test: DataFrame, configs: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """Every configuration for each value of ``by``: choices from cluster metrics, results from the sums of the test side."""
    pair = ["performance_weight", "cost_sensitivity"]
    n_cfg = configs.agg(F.collect_list(F.struct(*pair)).alias("cfg"), L(1).alias("_k"))
    grid = metrics.withColumn("_k", L(1)).join(n_cfg, "_k").withColumn("cfg", F.explode("cfg")).select(
        *by, cluster, "model_name", *[f"cfg.{x}" for x in pair], "accuracy", "avg_cost", "total_queries", "_hi", "_lo", "_mc")
    s = F.round(balance_score(F.col("performance_weight"), F.col("cost_sensitivity")), 12)
    pick = grid.withColumn("s", s).groupBy(*by, *pair, cluster).agg(
        F.min_by("model_name", F.struct((-F.col("s")).alias("s"), "model_name")).alias("model_name"))
    per = pick.join(test, [*by, cluster, "model_name"]).groupBy(*by, *pair, "dataset_id").agg(
        F.sum("n").alias("n"), F.sum("sc").alias("sc"), F.sum("c").alias("c"))
    r = per.groupBy(*by, *pair).agg(
        # 12 digits: configurations with the same choices must tie exactly on the frontier
        F.round(F.avg(F.col("sc") / F.col("n")), 12).alias("accuracy"), (F.sum("sc") / F.sum("n")).alias("sample_accuracy"),
        dollars(F.sum("c")).alias("total_cost"), (dollars(F.sum("c")) / F.sum("n")).alias("avg_cost_per_query"))
    return r.withColumn("cost_efficiency", F.col("accuracy") / (F.col("avg_cost_per_query") + L(1e-8)))


def merge_levels(centers: DataFrame, ks: DataFrame, fine: str = "cluster_id") -> DataFrame:
    """(n_clusters, fine_id, cluster_id): which merged cluster each fine cluster belongs to, for every cluster count of ``ks``.

    ``centers``: (fine cluster, center, n). Ward linkage joins the two clusters whose union adds least to the squared distances, weighing
    them by their rows; ties go to the smaller ids. A merged cluster keeps the least fine id. One tree serves every count: a
    level is cut where that many clusters are left (all fine ones if there are fewer). Centres are model parameters, a few hundred at most.
    """
    spark = centers.sparkSession
    rows = sorted((int(r[fine]), [float(x) for x in r["center"]], float(r["n"])) for r in centers.select(fine, "center", "n").collect())
    wanted = sorted({int(r[0]) for r in ks.select("n_clusters").collect()})
    merges = ward_merges([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) if rows else []
    out = []
    for k in wanted:
        of = {r[0]: r[0] for r in rows}
        for keep, gone in merges[: max(0, len(rows) - max(1, k))]:
            of = {f: keep if c == gone else c for f, c in of.items()}
        out += [(k, f, c) for f, c in of.items()]
    return spark.createDataFrame(out, "n_clusters int, fine_id bigint, cluster_id bigint")


def ward_merges(ids: Sequence[int], centers: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """(kept id, id merged into it) in the order of merging."""
    c, n = centers.astype(float).copy(), counts.astype(float).copy()
    gap = (n[:, None] * n[None, :] / (n[:, None] + n[None, :])) * ((c[:, None, :] - c[None, :, :]) ** 2).sum(2)
    gap[np.tril_indices(len(n))] = np.inf
    out = []
    for _ in range(len(n) - 1):
        i, j = np.unravel_index(int(gap.argmin()), gap.shape)
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        out.append((int(ids[i]), int(ids[j])))
        gap[j, :] = gap[:, j] = np.inf
        left = np.flatnonzero(np.isfinite(gap).any(0) | np.isfinite(gap).any(1))
        left = left[left != i]
        new = n[i] * n[left] / (n[i] + n[left]) * ((c[left] - c[i]) ** 2).sum(1)
        gap[np.minimum(left, i), np.maximum(left, i)] = new
    return out


def sweep_clusters(assigned_train: DataFrame, assigned_test: DataFrame, levels: DataFrame, configs: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """``sweep`` for every cluster count of ``levels`` (from ``merge_levels``) as well: a row per (n_clusters, performance_weight, cost_sensitivity).

    Both sides are summed once per (fine cluster, dataset, model); levels and configurations multiply those small tables only, so a dozen
    cluster counts read the facts once. Rows of a cluster that is in no level take no part.
    """
    def sums(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(F.col(cluster).cast("bigint").alias("fine_id"), *by, "model_name").agg(
            F.count("*").alias("n"), F.sum("score").alias("sc"), F.sum(nano(clean_usage_cost("cost"))).alias("c"))

    key = ["n_clusters", "cluster_id"]
    m = sums(assigned_train).join(levels, "fine_id").groupBy(*key, "model_name").agg(F.sum("n").alias("total_queries"), F.sum("sc").alias("sc"), F.sum("c").alias("c"))
    m = m.select(*key, "model_name", "total_queries", (F.col("sc") / F.col("total_queries")).alias("accuracy"), (dollars(F.col("c")) / F.col("total_queries")).alias("avg_cost"))
    w = Window.partitionBy(*key)  # rows per cluster = models
    m = stable(m.withColumns({"_hi": F.max("accuracy").over(w), "_lo": F.min("accuracy").over(w), "_mc": F.max("avg_cost").over(w)}))
    t = sums(assigned_test, "dataset_id").join(levels, "fine_id").groupBy(*key, "dataset_id", "model_name").agg(*[F.sum(x).alias(x) for x in ("n", "sc", "c")])
    return _sweep(m, t, configs, ["n_clusters"], "cluster_id")


def tradeoff_summary(s: DataFrame) -> DataFrame:
    """Correlations (with more than two rows), extremes, and accuracy range per cost range."""
    n = F.count("*")
    def corr(a, b):
        return F.when(n > 2, F.nanvl(F.corr(a, b), L(None).cast("double")))
    span_c = F.max("avg_cost_per_query") - F.min("avg_cost_per_query")
    return s.agg(
        n.alias("n"), corr("performance_weight", "accuracy").alias("corr_weight_accuracy"), corr("performance_weight", "avg_cost_per_query").alias("corr_weight_cost"),
        corr("accuracy", "avg_cost_per_query").alias("corr_accuracy_cost"), F.max("accuracy").alias("max_accuracy"), F.min("accuracy").alias("min_accuracy"),
        F.min_by("performance_weight", F.struct((-F.col("accuracy")).alias("a"), "performance_weight")).alias("weight_at_max_accuracy"),
        F.min_by("performance_weight", F.struct("avg_cost_per_query", "performance_weight")).alias("weight_at_min_cost"),
        F.try_divide(F.max("accuracy") - F.min("accuracy"), span_c).alias("accuracy_per_cost"))


def trend(points: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    s = F.regr_slope(y, x)
    return points.groupBy(*by).agg(s.alias("slope"), F.when(F.abs(s) < 1e-6, "stable").when(s > 0, "increasing").when(s < 0, "decreasing")
                                   .otherwise("stable").alias("trend"))


def optimal_configs(s: DataFrame, min_accuracy: float = 0.3, x: str = "performance_weight") -> DataFrame:
    """Best configuration per criterion, ties by the smaller parameter value."""
    med = s.agg(F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("_med"), L(1).alias("_k"))
    d = s.withColumn("_k", L(1)).join(med, "_k")
    row = F.struct(F.col(x).alias("x"), "accuracy", "avg_cost_per_query", "cost_efficiency")
    acc, eff = F.col("accuracy"), F.col("cost_efficiency")
    crit = {
        "best_accuracy": -acc, "lowest_cost": F.when(acc > min_accuracy, F.col("avg_cost_per_query")), "best_efficiency": -eff,
        "most_balanced": F.round(F.abs(F.col(x) - 0.5), 9), "best_product": -F.when(eff > 0, acc * eff).otherwise(acc), "most_stable": F.round(F.abs(F.col(x) - F.col("_med")), 9)}
    a = d.agg(*[F.min_by(F.when(c.isNotNull(), row), F.when(c.isNotNull(), F.struct(c.alias("c"), F.col(x).alias("x")))).alias(k) for k, c in crit.items()])
    long = a.select(F.explode(F.map_from_entries(F.array(*[F.struct(L(k).alias("k"), F.col(k).alias("v")) for k in crit]))).alias("criterion", "r"))
    return long.where("r is not null").select("criterion", F.col("r.x").alias(x), "r.accuracy", "r.avg_cost_per_query", "r.cost_efficiency")


def beats_baseline(s: DataFrame, baseline_accuracy: float, x: str = "performance_weight") -> DataFrame:
    """How many configurations beat the best single model (both on the 0-1 scale) and at which parameter values."""
    win = s.where(F.col("accuracy") > baseline_accuracy)
    total = s.agg(F.count("*").alias("n_configs"), F.count_if(F.col("accuracy") > baseline_accuracy).alias("n_better"), L(1).alias("_k"))
    w = win.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.avg(F.col("accuracy") - L(baseline_accuracy)).alias("mean_gain"), L(1).alias("_k"))
    med = exact_quantiles(win, [], x, [0.5]).select(F.col("quantile").alias("median_x"), L(1).alias("_k"))
    return total.join(w, "_k").join(med, "_k", "left").drop("_k").withColumn("percent", F.try_divide(F.col("n_better") * 100.0, F.col("n_configs")))


def export_sweep(s: DataFrame, path: str, fmt: str = "csv") -> None:
    w = s.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))
