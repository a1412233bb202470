"""Grouped statistics of evaluation facts: per model, per dataset, oracle, best model and random choice.

"Correct" is ``score > 0`` everywhere; averages use the raw score. Every choice of "one row per group" is an
aggregate (``max_by``/``min_by``), which combines before the shuffle, and not a window over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelab.functions.money import avg_money, dollars, nano, sum_money
from routelab.scale import distinct_values, ordered_running, seeded_hash, stable

QUESTION = ["dataset_id", "split", "record_index"]
DATASET = ["dataset_id", "split"]


def exclude(df: DataFrame, models: Sequence[str]) -> DataFrame:
    return df.where(~F.col("model_name").isin(list(models))) if models else df


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the largest ``order`` tuple; the other columns break ties."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    tail = [c for c in rest if c not in lead]
    loose = [c for c in tail if _unordered(df, c)]
    packed = F.struct(*lead, *[c for c in tail if c not in loose])
    # the largest tuple carries the row itself; maps have no order and ride along
    best = F.max_by(F.struct(*rest), packed) if loose else F.max(packed)
    best = df.groupBy(*keys).agg(best.alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def _unordered(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith("map")


def best_first(score: str | Column, name: str | Column = "model_name") -> Column:
    """Order for min_by: highest score first, then name ascending."""
    s = F.col(score) if isinstance(score, str) else score
    return F.struct((-s).alias("s"), (F.col(name) if isinstance(name, str) else name).alias("n"))


def stats_by_dataset_model(records: DataFrame) -> DataFrame:
    return records.groupBy(*DATASET, "model_name").agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("score") > 0).alias("correct_records"),
        F.avg("score").alias("avg_score"),
        F.sum("score").alias("sum_score"),
        sum_money("cost").alias("total_cost"),
        avg_money("cost").alias("avg_cost_per_record"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
        F.avg("prompt_tokens").alias("avg_prompt_tokens"),
        F.avg("completion_tokens").alias("avg_completion_tokens"),
    ).withColumn("total_tokens", F.col("total_prompt_tokens") + F.col("total_completion_tokens")) \
     .withColumn("accuracy", F.col("correct_records") / F.col("total_records"))


_PACK = ["avg_score", "total_records", "correct_records", "total_cost"]


def stats_by_model(records: DataFrame) -> DataFrame:
    """One row per model with its datasets as an array; the group is the small per-dataset table."""
    s = stats_by_dataset_model(records)
    return s.groupBy("model_name").agg(
        F.count("*").alias("n_datasets"), F.sum("total_records").alias("total_records"),
        F.array_sort(F.collect_list(F.struct(*DATASET, *_PACK))).alias("datasets"))


def stats_by_dataset(records: DataFrame) -> DataFrame:
    s = stats_by_dataset_model(records)
    return s.groupBy(*DATASET).agg(
        F.count("*").alias("n_models"), F.sum("total_records").alias("total_records"),
        F.array_sort(F.collect_list(F.struct("model_name", *_PACK))).alias("models"))


def global_stats(records: DataFrame) -> DataFrame:
    """One row. Distinct questions are counted after a combine per question, never in one task."""
    q = records.groupBy(*QUESTION).agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(nano("cost")).alias("c"),
        F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("t"))
    d = q.groupBy(*DATASET).agg(
        F.count("*").alias("q"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"),
        F.sum("p").alias("p"), F.sum("t").alias("t"))
    models = records.select("model_name").distinct().agg(
        F.count("*").alias("total_models"), F.array_sort(F.collect_list("model_name")).alias("models"))
    g = d.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count("*").alias("total_datasets"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("total_prompts"),
        F.coalesce(F.sum("s") / F.sum("n"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(dollars(F.sum("c")), F.lit(0.0)).alias("total_cost"),
        F.coalesce(dollars(F.sum("c")) / F.sum("n"), F.lit(0.0)).alias("avg_cost_per_record"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_completion_tokens"),
        F.array_sort(F.collect_list(F.concat_ws("/", *DATASET))).alias("datasets"))
    return g.withColumn("one", F.lit(1)).join(models.withColumn("one", F.lit(1)), "one").drop("one")


def question_outcomes(records: DataFrame, exclude_models: Sequence[str] = (), seed: int = 42,
                      tie: Sequence[str] = ()) -> DataFrame:
    """One grouped pass per question: oracle hit, oracle cost and one randomly drawn row.

    The draw is uniform over the question's rows; ``tie`` names extra columns that tell repeats apart.
    """
    draw = F.struct(seeded_hash(seed, *QUESTION, "model_name", *tie).alias("h"), *tie, "score", "cost", "model_name")
    correct = F.col("score") > 0
    return exclude(records, exclude_models).groupBy(*QUESTION).agg(
        F.max(correct).alias("any_correct"),
        F.coalesce(F.min(F.when(correct, nano("cost"))), F.min(nano("cost"))).alias("oracle_nano"),
        F.min(draw).alias("pick")).select(
        *QUESTION, F.coalesce("any_correct", F.lit(False)).alias("any_correct"), "oracle_nano",
        F.col("pick.model_name").alias("random_model"), F.col("pick.score").alias("random_score"),
        nano(F.col("pick.cost")).alias("random_nano"))


def dataset_outcomes(records: DataFrame, exclude_models: Sequence[str] = (), seed: int = 42,
                     tie: Sequence[str] = ()) -> DataFrame:
    """Question outcomes rolled up to (dataset, split)."""
    return question_outcomes(records, exclude_models, seed, tie).groupBy(*DATASET).agg(
        F.count("*").alias("n_questions"), F.count_if("any_correct").alias("n_correct"),
        F.sum("oracle_nano").alias("oracle_nano"), F.sum("random_score").alias("random_score"),
        F.sum("random_nano").alias("random_nano"))


def _money_metric(total: Column, n: Column, metric: str) -> Column:
    if metric == "total_cost":
        return dollars(total)
    if metric == "avg_cost_per_record":
        return dollars(total) / n
    raise ValueError(f"unknown cost metric {metric}")


def oracle_accuracy(records: DataFrame, exclude_models: Sequence[str] = ()) -> DataFrame:
    q = exclude(records, exclude_models).groupBy(*QUESTION).agg(F.max(F.col("score") > 0).alias("hit"))
    return q.groupBy(*DATASET).agg(F.count("*").alias("n_questions"),
                                   F.avg(F.coalesce("hit", F.lit(False)).cast("int")).alias("oracle_accuracy"))


def oracle_cost(records: DataFrame, cost_metric: str = "total_cost", exclude_models: Sequence[str] = ()) -> DataFrame:
    q = exclude(records, exclude_models).groupBy(*QUESTION).agg(
        F.coalesce(F.min(F.when(F.col("score") > 0, nano("cost"))), F.min(nano("cost"))).alias("c"))
    return q.groupBy(*DATASET).agg(_money_metric(F.sum("c"), F.count("*"), cost_metric).alias("oracle_cost"))


def best_model_per_dataset(records: DataFrame, exclude_models: Sequence[str] = ()) -> DataFrame:
    s = stats_by_dataset_model(exclude(records, exclude_models))
    return s.groupBy(*DATASET).agg(F.min_by(F.struct(*[c for c in s.columns if c not in DATASET]),
                                            best_first("avg_score")).alias("b")).select(*DATASET, "b.*")


def max_expert_cost(records: DataFrame, cost_metric: str = "total_cost", exclude_models: Sequence[str] = ()) -> DataFrame:
    if cost_metric not in ("total_cost", "avg_cost_per_record"):
        raise ValueError(f"unknown cost metric {cost_metric}")
    return best_model_per_dataset(records, exclude_models).select(
        *DATASET, "model_name", F.col(cost_metric).alias("max_expert_cost"))


def random_router(records: DataFrame, seed: int = 42, exclude_models: Sequence[str] = (),
                  cost_metric: str = "total_cost", tie: Sequence[str] = ()) -> DataFrame:
    """Accuracy and cost per dataset of one shared uniform draw per question."""
    return question_outcomes(records, exclude_models, seed, tie).groupBy(*DATASET).agg(
        F.count("*").alias("n_questions"), F.avg("random_score").alias("random_accuracy"),
        _money_metric(F.sum("random_nano"), F.count("*"), cost_metric).alias("random_cost"))


def sample_level_avg(records: DataFrame, dataset_filter: Sequence[str] | None = None,
                     exclude_models: Sequence[str] = (), seed: int = 42, tie: Sequence[str] = ()) -> DataFrame:
    """Pooled averages: one row per model, then AVG, Max Expert, Random Router and Oracle.

    An empty filter list means no filter. Models without a row in the filter count as 0.0.
    """
    keep = F.col("dataset_id").isin(list(dataset_filter)) if dataset_filter else F.lit(True)
    s = stable(stats_by_dataset_model(records).select(*DATASET, "model_name", "total_records", "sum_score", "avg_score"))
    o = dataset_outcomes(records.where(keep), exclude_models, seed, tie)
    n, score = F.when(keep, F.col("total_records")), F.when(keep, F.col("sum_score"))
    per_model = s.groupBy("model_name").agg(F.coalesce(F.try_divide(F.sum(score), F.sum(n)), F.lit(0.0)).alias("value"))
    rows = per_model.select(F.col("model_name").alias("row_name"), "value")
    avg = exclude(per_model, exclude_models).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))
    best = exclude(s.where(keep), exclude_models).groupBy(*DATASET).agg(
        F.min_by(F.struct("sum_score", "total_records"), best_first("avg_score")).alias("b"))
    top = best.agg(F.coalesce(F.try_divide(F.sum("b.sum_score"), F.sum("b.total_records")), F.lit(0.0)).alias("value"))
    rest = o.agg(F.sum("n_questions").alias("q"), F.sum("random_score").alias("r"), F.sum("n_correct").alias("c"))
    return (rows.unionByName(avg.select(F.lit("AVG").alias("row_name"), "value"))
            .unionByName(top.select(F.lit("Max Expert").alias("row_name"), "value"))
            .unionByName(rest.select(F.lit("Random Router").alias("row_name"),
                                     F.coalesce(F.try_divide("r", "q"), F.lit(0.0)).alias("value")))
            .unionByName(rest.select(F.lit("Oracle").alias("row_name"),
                                     F.coalesce(F.try_divide("c", "q"), F.lit(0.0)).alias("value"))))


def dataset_oracle(records: DataFrame, exclude_models: Sequence[str] = ()) -> DataFrame:
    """The best model of each dataset answers all its questions."""
    return best_model_per_dataset(records, exclude_models).select(
        *DATASET, "model_name", "total_records", "avg_score", "total_cost")


def format_table(df: DataFrame, as_percent: bool = True, precision: int = 2) -> DataFrame:
    """Numbers as text with fixed digits, missing as "-"."""
    scale = 100.0 if as_percent else 1.0
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            text = F.round(c * scale, precision).cast(f"decimal(38,{precision})").cast("string")
            out.append(F.coalesce(text, F.lit("-")).alias(name))
        else:
            out.append(c)
    return df.select(*out)


def baseline_scores(records: DataFrame) -> DataFrame:
    return records.groupBy("model_name", "dataset_id").agg(F.round(F.avg("score") * 100, 2).alias("score"))


def baseline_scores_map(records: DataFrame) -> DataFrame:
    return baseline_scores(records).groupBy("model_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset_id", "score")))).alias("scores"))


def run_aggregates(records: DataFrame, keys: Sequence[str] = ("dataset_id", "split", "model_name")) -> DataFrame:
    """Run header numbers: mean of the non-null scores (0 if none) and token and cost sums."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("counts"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("performance"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        sum_money("cost").alias("cost"))


def extra_metric_means(records: DataFrame, keys: Sequence[str], extras: str = "extra_fields") -> DataFrame:
    """Mean of every numeric extra field over the rows that have it (true/false texts are not numbers)."""
    long = records.select(*keys, F.explode(extras).alias("metric", "raw"))
    return long.select(*keys, "metric", F.col("raw").try_cast("double").alias("x")).where(
        F.col("x").isNotNull()).groupBy(*keys, "metric").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def suite_metric_means(records: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                       positive_only: Sequence[str] = (), extras: str = "extra_fields") -> DataFrame:
    """Fixed metrics over all rows with missing = 0; ``positive_only`` ones average values > 0, else -1."""
    x = {m: F.col(extras)[m].try_cast("double") for m in [*metrics, *positive_only]}
    return records.groupBy(*keys).agg(
        *[F.avg(F.coalesce(x[m], F.lit(0.0))).alias(m) for m in metrics],
        *[F.coalesce(F.avg(F.when(x[m] > 0, x[m])), F.lit(-1.0)).alias(m) for m in positive_only])


def task_accuracy(question_scores: DataFrame) -> DataFrame:
    """One sentence list per model from (task, model_name, score); right means score exactly 1."""
    per = question_scores.groupBy("model_name", "task").agg(
        F.avg((F.col("score") == 1.0).cast("int")).alias("acc"))
    pct = F.round(F.col("acc") * 100, 2).cast("decimal(10,2)").cast("string")
    line = F.concat(F.lit("The model achieves accuracy "), pct, F.lit("% on the task of "), F.col("task"))
    return per.select("model_name", "task", line.alias("line")).groupBy("model_name").agg(
        F.concat_ws(". ", F.transform(F.array_sort(F.collect_list(F.struct("task", "line"))), lambda s: s["line"]))
        .alias("description"))


def model_avg_cost(df: DataFrame) -> DataFrame:
    return df.where(F.col("cost").isNotNull()).groupBy("model_name").agg(avg_money("cost").alias("avg_cost"))


def fill_report(grid: DataFrame, top_n: int = 5) -> DataFrame:
    """Models with the most filled (missing) cells; ``grid`` has a ``filled`` flag."""
    return grid.groupBy("model_name").agg(F.count_if("filled").alias("n_filled"), F.count("*").alias("n_cells")) \
        .where("n_filled > 0").orderBy(F.desc("n_filled"), "model_name").limit(top_n)


def routing_distribution(decisions: DataFrame, by_dataset: bool = False) -> DataFrame:
    keys = ["dataset_id"] if by_dataset else []
    c = decisions.groupBy(*keys, "model_name").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    return c.select(*keys, "model_name", "n", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("percent"),
                    F.count("*").over(w).alias("models_used"),
                    (F.max("n").over(w) * 100.0 / F.sum("n").over(w)).alias("top_share"))


def label_majority(labels: DataFrame) -> DataFrame:
    return labels.groupBy("model_name", "prompt").agg(F.max("label").alias("label"))


def correctness_matrix(labels: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    names = list(models) if models is not None else distinct_values(labels, "model_name")
    return labels.groupBy("prompt").pivot("model_name", names).agg(F.max("label")).na.fill(0, names)


def pair_statistics(prompt_models: DataFrame, top_k: int = 32, max_pos: int = 1) -> DataFrame:
    """Per dataset: prompts, same-accuracy pairs, and possible and capped negatives, from group sizes only."""
    sizes = prompt_models.select("dataset_id", F.size("models").alias("total"), F.size(
        F.filter("models", lambda m: m["correct"])).alias("right")).groupBy("dataset_id", "right", "total").agg(
        F.count("*").alias("n"))
    all_n = F.sum("n").over(Window.partitionBy("dataset_id"))
    capped = F.least(F.lit(max_pos).cast("bigint"), F.col("n") - 1)
    # sum over anchors of min(max_pos, remaining): full ones, then the falling tail
    pairs = F.when((F.col("n") < 2) | F.lit(max_pos <= 0), F.lit(0).cast("bigint")).otherwise(
        capped * (F.col("n") - 1 - capped) + F.floor(capped * (capped + 1) / 2))
    d = sizes.withColumn("all_n", all_n).withColumn("pairs", pairs).withColumn("neg", F.col("all_n") - F.col("n"))
    return d.groupBy("dataset_id").agg(
        F.max("all_n").alias("total_prompts"), F.sum("pairs").alias("pair_count"),
        F.sum(F.col("pairs") * F.least("neg", F.lit(top_k))).alias("estimated_negative_assignments"),
        F.sum(F.col("pairs") * F.col("neg")).alias("potential_negative_assignments"))


def vote_tally(votes: DataFrame, win_gate: int = 3, novelty_gate: int = 4, lose_gate: int = 2) -> DataFrame:
    """``votes``: (item_id, judgments map dimension -> win_A|win_B), already flipped where the order was swapped."""
    v = votes.select("item_id", F.explode("judgments").alias("dimension", "judgment")).groupBy(
        "item_id", "dimension").agg(F.count_if(F.col("judgment") == "win_A").alias("original_votes"),
                                    F.count_if(F.col("judgment") == "win_B").alias("generated_votes"))
    gate = F.when(F.col("dimension") == "novelty", novelty_gate).otherwise(win_gate)
    g = F.col("generated_votes")
    return v.withColumn("result", F.when(g > gate, "win").when(g <= lose_gate, "lose").otherwise("tie"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once: counts first, then a semi join (no group is collected)."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return df.join(twice, key, "left_semi")


def rank_sums(df: DataFrame, partition: Sequence[str], value: str) -> DataFrame:
    """Distinct values of a group with their count and average rank (1-based), computed without a group sort."""
    counts = df.groupBy(*partition, value).agg(F.count("*").alias("_n"))
    r = ordered_running(counts, partition, [value], {"_upto": ("sum", "_n")})
    return r.withColumn("avg_rank", F.col("_upto") - (F.col("_n") - 1) / 2.0)


def exact_quantiles(df: DataFrame, partition: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(partition, prob, quantile) with linear interpolation, from running counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*partition, value).agg(F.count("*").alias("n"))
    r = stable(ordered_running(counts, partition, [value], {"upto": ("sum", "n")}))
    total = r.groupBy(*partition).agg(F.sum("n").alias("total"))
    targets = total.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    targets = targets.withColumn("pos", F.col("prob") * (F.col("total") - 1))
    # a value covers 0-based positions [upto-n, upto-1]; each target needs the values at floor and ceil
    packed = targets.groupBy(*partition).agg(F.collect_list(F.struct("prob", "pos")).alias("t")) if partition \
        else targets.agg(F.collect_list(F.struct("prob", "pos")).alias("t"))
    j = r.join(packed, list(partition)) if partition else r.withColumn("_o", F.lit(1)).join(
        packed.withColumn("_o", F.lit(1)), "_o").drop("_o")
    lo, hi = F.col("upto") - F.col("n"), F.col("upto") - 1
    hit = j.withColumn("t", F.explode("t")).select(
        *partition, F.col("t.prob").alias("prob"), F.col("t.pos").alias("pos"), value,
        ((F.floor("t.pos") >= lo) & (F.floor("t.pos") <= hi)).alias("is_lo"),
        ((F.ceil("t.pos") >= lo) & (F.ceil("t.pos") <= hi)).alias("is_hi")).where("is_lo or is_hi")
    a, b = F.max(F.when(F.col("is_lo"), F.col(value))), F.max(F.when(F.col("is_hi"), F.col(value)))
    return hit.groupBy(*partition, "prob").agg(
        (a + (b - a) * (F.max("pos") - F.floor(F.max("pos")))).alias("quantile"))

