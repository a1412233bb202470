"""Train/test splits, orderings, set operations and window-like labels.

"Random" is always a seeded md5 order. Ranks inside a dataset or task use the bucketed ranks of
``routelab.scale``, because one dataset may hold a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelab.functions.money import avg_money, nano, sum_money
from routelab.scale import distinct_values, join_null_safe, ordered_rank, seeded_hash, shuffled_rank


def _cut(ratio: float, n) :
    return F.floor(n * F.lit(float(ratio)))


def split_by_prompt(records: DataFrame, train_ratio: float = 0.8, seed: int = 42,
                    ood_datasets: Sequence[str] = ()) -> DataFrame:
    """Adds ``is_train``; all rows of a prompt stay together, out-of-distribution datasets are test only."""
    if not 0.0 < train_ratio < 1.0:
        raise ValueError("train_ratio must lie strictly between 0 and 1")
    # ranges of (dataset, hash, prompt) hold every row of a prompt, so the distinct rows need no exchange of their own
    hashed = records.select("dataset_id", seeded_hash(seed, "dataset_id", "prompt").alias("_h"), "prompt")
    prompts = hashed.repartitionByRange("dataset_id", "_h", "prompt").distinct()
    ranked = ordered_rank(prompts, ["dataset_id"], ["_h", "prompt"], "_rn", total="_n", ranged=True)
    ood = F.col("dataset_id").isin(list(ood_datasets)) if ood_datasets else F.lit(False)
    flags = ranked.select(
        "dataset_id", "prompt", (~ood & (F.col("_rn") <= _cut(train_ratio, F.col("_n")))).alias("is_train"))
    return join_null_safe(records, flags, ["dataset_id", "prompt"])


def flag_prompts(prompts: DataFrame, train_ratio: float = 0.8, seed: int = 42, ood_datasets: Sequence[str] = ()) -> DataFrame:
    """The ``is_train`` of ``split_by_prompt`` for a table with one row per prompt: a rank, no join."""
    if not 0.0 < train_ratio < 1.0:
        raise ValueError("train_ratio must lie strictly between 0 and 1")
    ranked = shuffled_rank(prompts, ["dataset_id"], ["prompt"], seed, "_rn", hash_keys=["dataset_id", "prompt"], total="_n")
    ood = F.col("dataset_id").isin(list(ood_datasets)) if ood_datasets else F.lit(False)
    return ranked.withColumn("is_train", ~ood & (F.col("_rn") <= _cut(train_ratio, F.col("_n")))).drop("_rn", "_n")


def split_by_record(records: DataFrame, train_ratio: float = 0.8, seed: int = 42,
                    keys: Sequence[str] = ("split", "record_index", "model_name")) -> DataFrame:
    """Row-level split inside each dataset; ``keys`` identify a row of a dataset."""
    if not 0.0 < train_ratio < 1.0:
        raise ValueError("train_ratio must lie strictly between 0 and 1")
    ranked = shuffled_rank(records, ["dataset_id"], list(keys), seed, "_rn", hash_keys=["dataset_id", *keys], total="_n")
    return ranked.withColumn(
        "is_train", F.col("_rn") <= _cut(train_ratio, F.col("_n"))).drop("_rn", "_n")


def split_sequential(edges: DataFrame, ratio: Sequence[float] = (0.7, 0.1, 0.2), task: str = "task_id",
                     index: str = "record_index") -> DataFrame:
    """Per task in index order: first part train, next part val, rest test; adds ``part``."""
    questions = edges.select(task, index).distinct()
    ranked = ordered_rank(questions, [task], [index], "_rn", total="_n")
    n, rn = F.col("_n"), F.col("_rn")
    train, val = _cut(ratio[0], n), _cut(ratio[1], n)
    flags = ranked.select(task, index, F.when(rn <= train, "train").when(rn <= train + val, "val")
                          .otherwise("test").alias("part"))
    return join_null_safe(edges, flags, [task, index])


def split_shuffled_80_10_10(df: DataFrame, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """One shuffle of the whole set, then cut; ``keys`` identify a row."""
    j = shuffled_rank(df, [], list(keys), seed, "_rn", total="_n")
    rn, n = F.col("_rn"), F.col("_n")
    train, val = _cut(0.8, n), _cut(0.1, n)
    return j.withColumn("part", F.when(rn <= train, "train").when(rn <= train + val, "val").otherwise("test")) \
        .drop("_rn", "_n")


def candidate_ranks(df: DataFrame, score: str = "score", keys: Sequence[str] = ("id",), index: str = "idx") -> DataFrame:
    """0 = best; ties favour the higher index. A group is one prompt's candidate list (pool-sized)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(index))
    return df.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def slopes(points: DataFrame, x: str, ys: Sequence[str], by: Sequence[str] = (),
           positive: Sequence[str] = ()) -> DataFrame:
    """Successive dy/dx along sorted x, one row per step and metric; ``positive`` metrics keep only y > 0."""
    out = []
    for y in ys:
        p = points.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
            F.col("x").isNotNull() & F.col("y").isNotNull())
        if y in positive:
            p = p.where("y > 0")
        # equal x would give dx = 0: one point per x
        p = p.groupBy(*by, "x").agg(F.min("y").alias("y"))
        r = ordered_rank(p, list(by), ["x"], "_rn")
        prev = r.select(*by, (F.col("_rn") + 1).alias("_rn"), F.col("x").alias("px"), F.col("y").alias("py"))
        out.append(r.join(prev, [*by, "_rn"]).select(
            *by, F.lit(y).alias("metric"), "x",
            ((F.col("y") - F.col("py")) / (F.col("x") - F.col("px"))).alias("slope")))
    return reduce(DataFrame.unionByName, out)


def slope_summary(s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    m = F.avg("slope")
    return s.groupBy(*by, "metric").agg(
        F.count("*").alias("n"), m.alias("mean_slope"), F.stddev_pop("slope").alias("std_slope"),
        F.max("slope").alias("max_slope"), F.min("slope").alias("min_slope"),
        F.when(m > 0, "increasing").when(m < 0, "decreasing").otherwise("flat").alias("direction"))


def stable_points(s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """x values whose step is flatter than half the standard deviation of the steps, with their range."""
    keys = [*by, "metric"]
    std = s.groupBy(*keys).agg(F.stddev_pop("slope").alias("_std"))
    return s.join(std, keys).where(F.abs("slope") < 0.5 * F.col("_std")).groupBy(*keys).agg(
        F.count("*").alias("n_stable"), F.min("x").alias("stable_from"), F.max("x").alias("stable_to"))


def dedup_prompts_capped(records: DataFrame, cap: int | None = None) -> DataFrame:
    """First row per prompt over all datasets, then at most ``cap`` prompts per dataset in index order."""
    first = records.groupBy("prompt").agg(
        F.min(F.struct("dataset_id", "split", "record_index")).alias("f")).select("f.*", "prompt")
    if cap is None:
        return first
    return ordered_rank(first, ["dataset_id"], ["split", "record_index", "prompt"], "_rn").where(
        F.col("_rn") <= cap).drop("_rn")


def upsample_minority(df: DataFrame, major: str, minor: str, key: str, seed: int = 42) -> DataFrame:
    """The rows where ``major`` wins and, drawn with replacement, as many of the rows where ``minor`` wins.

    Rows of neither side are left out, whichever side is larger; without minority rows only the majority comes back. ``major``/``minor`` name boolean columns. Each extra draw picks the minority row at position
    md5(seed, draw number) mod size; the draws are generated by a distributed ``range``.
    """
    big, small = df.where(F.col(major)), df.where(F.col(minor))
    n_big, n_small = big.count(), small.count()
    if n_small == 0:
        return big
    spark = df.sparkSession
    hexpos = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10)
    draws = spark.range(n_big).select((hexpos.cast("bigint") % n_small + 1).alias("_rn"))
    # draws of the same row are counted first, so a drawn row is repeated in place
    times = draws.groupBy("_rn").agg(F.count("*").alias("_k"))
    picked = ordered_rank(small, [], [key], "_rn").join(times, "_rn").withColumn(
        "_i", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).drop("_rn", "_k", "_i")
    return big.unionByName(picked)


def normalize_cost_by_task(edges: DataFrame, task: str = "task_id", cost: str = "cost") -> DataFrame:
    """Min-max cost within a task; a constant task gives 0. Extremes come from an aggregate, not a window."""
    ext = edges.groupBy(task).agg(F.min(cost).alias("_lo"), F.max(cost).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return join_null_safe(edges, ext, [task]).withColumn(
        "cost_norm", F.when(span > 0, (F.col(cost) - F.col("_lo")) / span).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def tie_labels(edges: DataFrame, utility: str = "utility", keys: Sequence[str] = ("task_id", "record_index"),
               atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """1 for every model within tolerance of the question's best utility."""
    top = edges.groupBy(*keys).agg(F.max(utility).alias("_top"))
    close = F.abs(F.col(utility) - F.col("_top")) <= F.lit(atol) + F.lit(rtol) * F.abs("_top")
    return edges.join(top, list(keys)).withColumn("is_best", close.cast("int")).drop("_top")


def cost_percentile(assigned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Share (x100) of a cluster's costs strictly below each model's mean cost.

    The means of a cluster are one small array; each cost falls between two of them, so rows are counted by
    that position and never multiplied by the number of models.
    """
    a = assigned.select(cluster, "model_name", nano("cost").alias("c"))
    means = a.groupBy(cluster, "model_name").agg(F.avg("c").alias("m"))
    packed = means.groupBy(cluster).agg(F.array_sort(F.array_distinct(F.collect_list("m"))).alias("ms"))
    pos = F.size(F.filter("ms", lambda m: m <= F.col("c")))
    hist = a.join(packed, cluster).groupBy(cluster, pos.alias("p")).agg(F.count("*").alias("n"))
    h = hist.groupBy(cluster).agg(F.sum("n").alias("total"), F.collect_list(F.struct("p", "n")).alias("h"))
    place = F.array_position("ms", F.col("m"))  # 1-based: costs with p < place lie strictly below the mean
    below = F.aggregate(F.filter("h", lambda s: s["p"] < place), F.lit(0).cast("bigint"), lambda acc, s: acc + s["n"])
    return means.join(packed, cluster).join(h, cluster).select(
        cluster, "model_name", (below * 100.0 / F.col("total")).alias("cost_percentile"))


# ordering, limits, set operations

def order_by_dataset_index(df: DataFrame) -> DataFrame:
    return df.orderBy("dataset_id", "record_index")


def top_k_experts(scored: DataFrame, max_router: int = 1, keys: Sequence[str] = ("dataset_id", "record_index"),
                  score: str = "expert_score") -> DataFrame:
    """Best ``max_router`` models per query. Spark prunes with a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "model_name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_router)


def top_models_by_cost(decisions: DataFrame, n: int = 10) -> DataFrame:
    c = decisions.groupBy("model_name").agg(F.sum(nano("cost")).alias("_c"), sum_money("cost").alias("total_cost"))
    total = Window.partitionBy()
    return c.withColumn("share", F.try_divide(F.col("_c") * 100.0, F.sum("_c").over(total))).orderBy(
        F.desc("_c"), "model_name").limit(n).drop("_c")


def edges_sorted_by_split(edges: DataFrame, test_keys: DataFrame, task: str = "task_id",
                          index: str = "record_index") -> DataFrame:
    """Edges with an ``is_test`` flag, ordered by task, flag, index, model."""
    keys = test_keys.select(task, index).distinct().withColumn("is_test", F.lit(True))
    return edges.join(keys, [task, index], "left").withColumn("is_test", F.coalesce("is_test", F.lit(False))).orderBy(
        task, "is_test", index, "llm")


def demo_limit(items: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return items.orderBy(*order).limit(n)


def union_splits(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def ood_only_tasks(train: DataFrame, test: DataFrame, task: str = "task_id") -> DataFrame:
    return test.select(task).distinct().join(train.select(task).distinct(), task, "left_anti")


def merge_splits_long(wide: DataFrame, threshold: float = 0.0, score_map: str = "scores") -> DataFrame:
    """Per-dataset question files -> one long table with a running index per part.

    ``wide``: (task, part, index, question, scores map). Test rows of tasks without training rows go to "ood".
    """
    only = ood_only_tasks(wide.where("part = 'train'"), wide.where("part = 'test'"), "task").withColumn("_ood", F.lit(True))
    t = wide.join(only, "task", "left").withColumn(
        "target", F.when(F.col("_ood") & (F.col("part") == "test"), "ood").otherwise(F.col("part")))
    ranked = ordered_rank(t.select("part", "task", "index", "question"), ["part"], ["task", "index", "question"], "rn")
    long = t.select("target", "part", "task", "index", "question", F.explode(score_map).alias("model_name", "score"))
    return ranked.join(long, ["part", "task", "index", "question"]).select(
        "target", (F.col("rn") - 1).alias("global_index"), "task", "question", "model_name", "score",
        (F.col("score") > threshold).cast("int").alias("is_correct"))


def available_vs_requested(runs: DataFrame, requested: Sequence[str], column: str = "model_name") -> DataFrame:
    """Requested names that no run has."""
    have = set(distinct_values(runs, column))
    spark = runs.sparkSession
    return spark.createDataFrame([(r,) for r in sorted(set(requested)) if r not in have], f"{column} string")


def rank_models_in_cluster(assigned: DataFrame, models: Sequence[str] | None = None, cluster: str = "cluster_id") -> DataFrame:
    """Mean score and mean cost per (cluster, model); pool models without a row score 0.0; rank 1 = best."""
    names = list(models) if models is not None else distinct_values(assigned, "model_name")
    s = assigned.where(F.col("model_name").isin(names)).groupBy(cluster, "model_name").agg(
        F.avg("score").alias("s"), F.count("*").alias("n"), avg_money("cost").alias("c"))
    grid = assigned.select(cluster).distinct().withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in names])))
    w = Window.partitionBy(cluster).orderBy(F.desc("mean_score"), "model_name")
    return grid.join(s, [cluster, "model_name"], "left").select(
        cluster, "model_name", F.coalesce("s", F.lit(0.0)).alias("mean_score"), F.coalesce("n", F.lit(0)).alias("n"),
        "c").withColumn("rank", F.row_number().over(w)).withColumnRenamed("c", "mean_cost")
