"""Reports on routing decisions: accuracy, cost, comparison with single models, pairwise and candidate selection.

``decisions`` has one row per selected model of a question; the facts have one row per (question, model). All
reports reduce to one row per question first, then to datasets; the overall rows come from grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelab.functions.money import clean_usage_cost, dollars, nano, sum_money
from routelab.operators.stats import best_first, rank_sums
from routelab.scale import join_null_safe, stable

L = F.lit
KEYS = ("dataset_id", "record_index")


def _is_in(names: Sequence[str], c: str = "dataset_id") -> Column:
    return F.col(c).isin(list(names)) if names else L(False)


def judged_questions(decisions: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per question: correctness = best score among the selected models (0 if none), and their summed cost."""
    facts = records.select(*keys, "model_name", "score", nano(clean_usage_cost("cost")).alias("nano"))
    j = decisions.select(*keys, "model_name").join(facts, [*keys, "model_name"], "left")
    return j.groupBy(*keys).agg(F.greatest(L(0.0), F.coalesce(F.max("score"), L(0.0))).alias("correct"),
                                F.coalesce(F.sum("nano"), L(0)).alias("nano"))


def evaluate_selection(decisions: DataFrame, records: DataFrame, ood_datasets: Sequence[str] = (),
                       excluded_datasets: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Accuracy and cost per dataset, for OOD / non-OOD, and overall: pooled and macro, in percent."""
    q = judged_questions(decisions, records, keys).where(~_is_in(excluded_datasets))
    spent = F.col("correct") > 0
    per = q.groupBy("dataset_id").agg(
        F.count("*").alias("n"), F.sum("correct").alias("correct"), F.sum("nano").alias("nano"),
        F.sum(F.when(spent, F.col("nano")).otherwise(0)).alias("good"), F.sum(F.when(spent, 0).otherwise(F.col("nano"))).alias("bad"))
    per = per.withColumn("side", F.when(_is_in(ood_datasets), "ood").otherwise("non_ood")).withColumn(
        "acc", F.col("correct") / F.col("n")).withColumn("scope", F.explode(F.array(
            F.struct(L("dataset").alias("level"), F.col("dataset_id").alias("name")),
            F.struct(L("side").alias("level"), F.col("side").alias("name")),
            F.struct(L("all").alias("level"), L("all").alias("name")))))
    return per.groupBy("scope.level", "scope.name").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"), (F.avg("acc") * 100).alias("macro_accuracy"),
        (F.sum("correct") * 100 / F.sum("n")).alias("pooled_accuracy"), dollars(F.sum("nano")).alias("total_cost"),
        dollars(F.sum("good")).alias("correct_cost"), dollars(F.sum("bad")).alias("incorrect_cost"))


def routing_costs(decisions: DataFrame, records: DataFrame, ood_datasets: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Costs of the selections with the derived rates; efficiency is macro accuracy % per average dollar."""
    e = evaluate_selection(decisions, records, ood_datasets, (), keys)
    avg = F.col("total_cost") / F.col("n")
    return e.select("level", "name", "n", "total_cost", avg.alias("avg_cost_per_query"), "correct_cost", "incorrect_cost",
                    F.coalesce(F.try_divide("correct_cost", "correct"), L(0.0)).alias("cost_per_correct"),
                    (F.col("macro_accuracy") / (avg + L(1e-8))).alias("cost_efficiency"))


def model_costs(decisions: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    facts = records.select(*keys, "model_name", clean_usage_cost("cost").alias("cost"))
    return decisions.select(*keys, "model_name").join(facts, [*keys, "model_name"], "left").groupBy("model_name").agg(
        F.count("*").alias("n_queries"), F.coalesce(sum_money("cost"), L(0.0)).alias("total_cost"))


def baseline_comparison(records: DataFrame, report: DataFrame, ood_datasets: Sequence[str] = (), scope: str = "all") -> DataFrame:
    """Single models against the router: macro accuracy %, coverage, total cost, and who is best.

    ``report`` is the output of ``evaluate_selection`` (its dataset rows are compared).
    """
    side = {"all": L(True), "ood": _is_in(ood_datasets), "non_ood": ~_is_in(ood_datasets)}[scope]
    cell = records.where(side).groupBy("model_name", "dataset_id").agg(F.avg("score").alias("a"), F.sum(nano(clean_usage_cost("cost"))).alias("c"))
    m = cell.groupBy("model_name").agg((F.avg("a") * 100).alias("mean_score"), F.count("*").alias("n_datasets"), dollars(F.sum("c")).alias("total_cost"))
    router = report.where("level = 'dataset'").select(F.col("name").alias("dataset_id"), "pooled_accuracy").where(side).agg(
        F.avg("pooled_accuracy").alias("router_accuracy"), F.count("*").alias("n_all"))
    w = Window.partitionBy()  # one row per model from here on
    j = m.withColumn("_k", L(1)).join(router.withColumn("_k", L(1)), "_k").drop("_k")
    return j.select("model_name", "mean_score", F.concat_ws("/", F.col("n_datasets").cast("string"), F.col("n_all").cast("string")).alias("coverage"),
                    "total_cost", "router_accuracy", (F.col("router_accuracy") - F.col("mean_score")).alias("improvement"),
                    (F.row_number().over(w.orderBy(F.desc("mean_score"), "model_name")) == 1).alias("is_best"))


def dataset_best_join(report: DataFrame, baseline: DataFrame) -> DataFrame:
    """Router accuracy per dataset against the best single model there; ``baseline``: (model_name, dataset_id, score %)."""
    best = baseline.groupBy("dataset_id").agg(F.min_by(F.struct("model_name", "score"), best_first("score")).alias("b"))
    r = report.where("level = 'dataset'").select(F.col("name").alias("dataset_id"), F.col("pooled_accuracy").alias("router_accuracy"))
    return r.join(best, "dataset_id").select("dataset_id", "router_accuracy", F.col("b.model_name").alias("best_model"),
                                             F.col("b.score").alias("best_score"), (F.col("router_accuracy") - F.col("b.score")).alias("improvement"))


def threshold_router(df: DataFrame, winrate: str = "winrate", threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted", F.when(F.col(winrate) >= threshold, "model_a").otherwise("model_b"))


def pairwise_report(pairs: DataFrame, winrate: str = "winrate", threshold: float = 0.5, ood_prefixes: Sequence[str] = ()) -> DataFrame:
    """Per dataset, OOD side and overall; macro columns average the datasets of the level."""
    p = threshold_router(pairs, winrate, threshold)
    ood = L(False)
    for prefix in ood_prefixes:
        ood = ood | F.col("dataset_id").startswith(prefix)
    strong = F.col("predicted") == "model_a"
    right = F.when(strong, F.col("score_model_a")).otherwise(F.col("score_model_b")) > 0
    decisive = F.col("winner") != "tie"
    cost = nano(F.coalesce(F.when(strong, F.col("cost_model_a")).otherwise(F.col("cost_model_b")), L(0.0)))
    w = F.round(F.col(winrate) * L(1e9)).cast("bigint")  # whole units, so sums do not depend on row order
    per = p.withColumn("side", F.when(ood, "ood").otherwise("in_domain")).groupBy("dataset_id", "side").agg(
        F.count("*").alias("n"), F.count_if(strong).alias("n_strong"), F.count_if(~decisive).alias("n_ties"), F.count_if(decisive).alias("n_decisive"),
        F.count_if(right).alias("n_right"), F.count_if(right & decisive).alias("n_right_decisive"),
        F.count_if(decisive & (F.col("predicted") == F.col("winner"))).alias("n_routed"), F.sum(cost).alias("nano"),
        F.sum(w).alias("w"), F.sum((w / L(1e9)) * (w / L(1e9))).alias("w2"))
    per = per.withColumn("acc", F.col("n_right") / F.col("n")).withColumn("scope", F.explode(F.array(
        F.struct(L("dataset").alias("level"), F.col("dataset_id").alias("name")), F.struct(L("side").alias("level"), F.col("side").alias("name")),
        F.struct(L("all").alias("level"), L("all").alias("name")))))
    n, dec = F.sum("n"), F.sum("n_decisive")
    mean = F.sum("w") / L(1e9) / n
    return per.groupBy("scope.level", "scope.name").agg(
        n.alias("n"), F.sum("n_strong").alias("n_strong"), F.sum("n_ties").alias("n_ties"), dec.alias("n_decisive"),
        (F.sum("n_right") / n).alias("selection_accuracy"),
        F.coalesce(F.try_divide(F.sum("n_right_decisive"), dec), L(0.0)).alias("selection_accuracy_decisive"),
        F.coalesce(F.try_divide(F.sum("n_routed"), dec), L(0.0)).alias("routing_accuracy"), F.avg("acc").alias("macro_accuracy"),
        mean.alias("winrate_mean"), F.when(n > 1, F.sqrt(F.greatest(F.sum("w2") / n - mean * mean, L(0.0)))).otherwise(0.0).alias("winrate_std"),
        dollars(F.sum("nano")).alias("total_cost"), (dollars(F.sum("nano")) / F.count("*")).alias("avg_cost_per_dataset"))


def cheapest_positive(scored: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("dataset_id", "sample_id")) -> DataFrame:
    """Cheapest model predicted positive (ties: higher probability); without one the most probable (ties: cheaper)."""
    pos = F.col("probability") >= threshold
    order = F.struct((~pos).cast("int").alias("neg"), F.when(pos, F.col("cost")).otherwise(-F.col("probability")).alias("a"),
                     F.when(pos, -F.col("probability")).otherwise(F.col("cost")).alias("b"), F.col("model_name").alias("m"))
    c = scored.groupBy(*keys).agg(F.min_by(F.struct("model_name", "label", "probability", "cost"), order).alias("s"))
    return c.select(*keys, "s.*")


def choice_report(chosen: DataFrame, cost: str = "cost") -> DataFrame:
    """Accuracy (label = 1) and cost per dataset plus the overall row with macro accuracy."""
    per = chosen.groupBy("dataset_id").agg(F.count("*").alias("n"), F.avg((F.col("label") == 1).cast("int")).alias("acc"), F.sum(nano(cost)).alias("c"))
    per = per.withColumn("name", F.explode(F.array(F.col("dataset_id"), L("ALL"))))
    return per.groupBy("name").agg(F.sum("n").alias("n"), F.avg("acc").alias("accuracy"), dollars(F.sum("c")).alias("total_cost"),
                                   (dollars(F.sum("c")) / F.sum("n")).alias("avg_cost"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with average ranks; one class only gives null. Ranks come from counts per distinct value."""
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_pos"))
    ranks = rank_sums(df.select(*by, score), list(by), score)
    j = join_null_safe(ranks, counts, [*by, score])
    p, n = F.sum("_pos").cast("double"), F.sum("_n").cast("double")
    return j.groupBy(*by).agg(F.try_divide(F.sum(F.col("_pos") * F.col("avg_rank")) - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def binary_scores(scored: DataFrame, threshold: float = 0.5, sample: str = "sample_id") -> DataFrame:
    """Accuracy and AUC of records and of prompts (maximum of probability, label and prediction)."""
    rec = scored.select(sample, "probability", "label", (F.col("probability") >= threshold).cast("int").alias("prediction"))
    prompt = rec.groupBy(sample).agg(F.max("probability").alias("probability"), F.max("label").alias("label"), F.max("prediction").alias("prediction"))
    both = rec.withColumn("level", L("record")).unionByName(prompt.withColumn("level", L("prompt")))
    acc = both.groupBy("level").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))
    return acc.join(auc(both, "probability", "label", ["level"]), "level", "left")


def selection_report(candidates: DataFrame, selected: DataFrame, keys: Sequence[str] = ("dataset_id", "id")) -> DataFrame:
    """Mean selected and oracle score, share of rank 0, mean index and cost: per dataset, micro and macro.

    ``candidates``: one row per (question, idx) with score and cost; ties at rank 0 favour the higher index.
    """
    c = candidates.join(selected.select(*keys, F.col("idx").alias("sel")), list(keys))
    q = c.groupBy(*keys).agg(
        F.max(F.when(F.col("idx") == F.col("sel"), F.col("score"))).alias("sel_score"), F.max("sel").alias("sel"),
        F.max_by("idx", F.struct("score", "idx")).alias("rank0"), F.min_by("idx", F.struct((-F.col("score")).alias("s"), "idx")).alias("oracle"),
        F.max("score").alias("oracle_score"), F.sum(F.when(F.col("idx") == F.col("sel"), nano("cost"))).alias("c"))
    agg = [F.count("*").alias("n"), F.avg("sel_score").alias("sel_score"), F.avg((F.col("sel") == F.col("rank0")).cast("int")).alias("sel_acc"),
           F.avg("sel").alias("sel_index"), F.avg("oracle_score").alias("oracle_score"), F.avg("oracle").alias("oracle_index"),
           (dollars(F.sum("c")) / F.count("*")).alias("avg_cost")]
    q = stable(q)
    per = q.groupBy(F.col("dataset_id").alias("name")).agg(*agg)
    micro = q.agg(*agg).select(L("MICRO").alias("name"), *per.columns[1:])
    macro = per.agg(F.sum("n").alias("n"), *[F.avg(x).alias(x) for x in per.columns[2:]]).select(L("MACRO").alias("name"), *per.columns[1:])
    return per.unionByName(micro).unionByName(macro)


def select_candidate(df: DataFrame, loss_type: str, mode: str = "bubble", logits: str = "logits") -> DataFrame:
    """0-based selected index from an array of logits (or of head margins for ``prob_nlabels``)."""
    a = F.col(logits)
    arg_max = (F.array_position(a, F.array_max(a)) - 1).cast("int")
    if loss_type in ("det_2cls", "det_ncls", "prob_2cls"):
        pick = arg_max
    elif loss_type == "det_nlabels":
        # sigmoid(x) >= 0.5 is x >= 0
        first = (F.array_position(F.transform(a, lambda x: x >= 0), L(True)) - 1).cast("int")
        pick = F.when(first >= 0, first).otherwise(F.size(a) - 1) if mode == "bubble" else arg_max
    elif loss_type == "prob_nlabels":
        pick = F.when(F.array_max(a) < 0, F.size(a)).otherwise(arg_max)
    else:
        raise ValueError(f"unknown loss type {loss_type}")
    return df.withColumn("selected", pick)


def rank_correlation(df: DataFrame, pred: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation with average ranks, mean squared error and sign agreement."""
    by = list(by)
    rp = rank_sums(df.select(*by, pred), by, pred).select(*by, pred, F.col("avg_rank").alias("_rp"))
    rt = rank_sums(df.select(*by, truth), by, truth).select(*by, truth, F.col("avg_rank").alias("_rt"))
    # equal (pred, truth) pairs are counted first, so the joins run on distinct pairs
    c = df.groupBy(*by, pred, truth).agg(F.count("*").alias("_n"))
    j = join_null_safe(join_null_safe(c, rp, [*by, pred]), rt, [*by, truth])
    n, x, y, k = F.sum("_n").cast("double"), F.col("_rp"), F.col("_rt"), F.col("_n")
    cov = F.sum(k * x * y) / n - (F.sum(k * x) / n) * (F.sum(k * y) / n)
    vx = F.sum(k * x * x) / n - (F.sum(k * x) / n) * (F.sum(k * x) / n)
    vy = F.sum(k * y * y) / n - (F.sum(k * y) / n) * (F.sum(k * y) / n)
    d = F.col(pred) - F.col(truth)
    return j.groupBy(*by).agg(n.cast("bigint").alias("n"), F.try_divide(cov, F.sqrt(vx * vy)).alias("spearman"), (F.sum(k * d * d) / n).alias("mse"),
                              (F.sum(F.when(F.signum(pred) == F.signum(truth), k).otherwise(0)) / n).alias("sign_accuracy"))


def arg_best_match(decisions: DataFrame, records: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of questions whose chosen model reaches the best score, and the chosen score raw and binarised."""
    top = records.groupBy(*keys).agg(F.max("score").alias("top"))
    c = decisions.select(*keys, "model_name").join(records.select(*keys, "model_name", "score"), [*keys, "model_name"]).join(top, list(keys))
    per = c.groupBy("dataset_id").agg(F.count("*").alias("n"), F.avg((F.col("score") == F.col("top")).cast("int")).alias("m"),
                                      F.avg("score").alias("s"), F.avg((F.col("score") > 0).cast("int")).alias("b"))
    per = per.withColumn("name", F.explode(F.array(F.col("dataset_id"), L("MACRO"), L("POOLED"))))
    def level(c):
        pooled = F.sum(F.col(c) * F.col("n")) / F.sum("n")
        return F.when(F.col("name") == "POOLED", pooled).otherwise(F.avg(c))
    return per.groupBy("name").agg(F.sum("n").alias("n"), level("m").alias("match"), level("s").alias("score"), level("b").alias("binary_score"))


def highest_confidence_match(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The model with the highest yes-probability answers; accuracy per dataset and macro."""
    c = scored.groupBy(*keys).agg(F.min_by("label", best_first("probability")).alias("label"))
    per = c.groupBy("dataset_id").agg(F.count("*").alias("n"), F.avg("label").alias("acc"))
    per = per.withColumn("name", F.explode(F.array(F.col("dataset_id"), L("MACRO"))))
    return per.groupBy("name").agg(F.sum("n").alias("n"), F.avg("acc").alias("accuracy"))


def utility_report(edges: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("task_id", "record_index")) -> DataFrame:
    """Mean utility of the chosen and the ideal model, accuracy and cost per task, and macro-F1 of the labels."""
    ideal = edges.groupBy(*keys).agg(F.min_by(F.struct("llm", "utility"), best_first("utility", "llm")).alias("i"))
    q = stable(decisions.select(*keys, F.col("model_name").alias("llm")).join(edges, [*keys, "llm"]).join(ideal, list(keys)).select(
        *keys, "llm", "utility", "effect", "cost_usd", F.col("i.llm").alias("ideal"), F.col("i.utility").alias("ideal_utility")))
    side = q.select(F.explode(F.array(F.struct(F.col("llm").alias("m"), (F.col("llm") == F.col("ideal")).alias("tp"), L(1).alias("p"), L(0).alias("a")),
                                      F.struct(F.col("ideal").alias("m"), L(False).alias("tp"), L(0).alias("p"), L(1).alias("a")))).alias("x")).select("x.*")
    f1 = side.groupBy("m").agg((2 * F.count_if("tp") / (F.sum("p") + F.sum("a"))).alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    per = q.groupBy("task_id").agg(F.count("*").alias("n"), F.sum("utility").alias("u"), F.sum("ideal_utility").alias("iu"),
                                   F.count_if(F.col("effect") > 0).alias("hit"), F.sum(nano("cost_usd")).alias("c"))
    per = per.withColumn("name", F.explode(F.array(F.col("task_id"), L("ALL"))))
    rep = per.groupBy("name").agg(F.sum("n").alias("n"), (F.sum("u") / F.sum("n")).alias("utility"), (F.sum("iu") / F.sum("n")).alias("ideal_utility"),
                                  (F.sum("hit") / F.sum("n")).alias("accuracy"), dollars(F.sum("c")).alias("total_cost"))
    return rep.withColumn("_k", L(1)).join(f1.withColumn("_k", L(1)), "_k").drop("_k")


def headline_metrics(accuracy: DataFrame, sweep: DataFrame, best_single_accuracy: float, best_single_cost: float) -> DataFrame:
    """Gain over random and best single, gap to the oracle, PerfGain, CostSave and ParetoDist.

    ``accuracy``: one row (router, random, best_single, oracle). ``sweep``: rows (method, accuracy, cost). The
    distance to the frontier is measured on accuracy and on cost scaled by the best single model's cost.
    """
    from routelab.operators.tradeoffs import pareto_join
    a = accuracy.select((F.try_divide("router", "random") - 1).alias("gain_at_random"), (F.try_divide("router", "best_single") - 1).alias("gain_at_best"),
                        (1 - F.try_divide("router", "oracle")).alias("gap_at_oracle"), L(1).alias("_k"))
    s = stable(sweep.select("method", F.col("accuracy").alias("acc"), F.col("cost").alias("cost")))
    gain = s.agg((F.try_divide(F.max("acc"), L(float(best_single_accuracy))) - 1).alias("perf_gain"),
                 F.coalesce(F.max(F.when(F.col("acc") >= best_single_accuracy, 1 - F.try_divide("cost", L(float(best_single_cost))))), L(0.0)).alias("cost_save"), L(1).alias("_k"))
    front = pareto_join(s, "cost", "acc").agg(F.array_sort(F.collect_set(F.struct("cost", "acc"))).alias("f"), L(1).alias("_k"))
    near = F.array_min(F.transform("f", lambda p: F.sqrt(F.pow(p["acc"] - F.col("acc"), 2) + F.pow(F.try_divide(p["cost"] - F.col("cost"), L(float(best_single_cost))), 2))))
    dist = s.withColumn("_k", L(1)).join(front, "_k").agg(F.avg(near).alias("pareto_dist"), L(1).alias("_k"))
    return a.join(gain, "_k").join(dist, "_k").drop("_k")


def merge_run_reports(reports: DataFrame, metric: str = "selection_accuracy", datasets: Sequence[str] | None = None) -> DataFrame:
    """Reports of several seeds side by side: one row per seed, one column per dataset, then the overall columns.

    ``reports`` comes from ``sources.runs.read_reports``: (seed, all_dataset_avg, sample_avg, total_cost, datasets
    map). Accuracies are in percent, ``total_cost`` in dollars.
    """
    names = list(datasets) if datasets is not None else sorted(
        r[0] for r in reports.select(F.explode(F.map_keys("datasets"))).distinct().collect())
    scale = 100.0 if metric == "selection_accuracy" else 1.0
    cell = [(F.try_element_at("datasets", L(n))[metric] * scale).alias(n) for n in names]
    tail = [(F.col("all_dataset_avg") * 100).alias("all_dataset_avg"), (F.col("sample_avg") * 100).alias("sample_avg")] \
        if metric == "selection_accuracy" else [F.col("total_cost")]
    return reports.select("seed", *cell, *tail).orderBy("seed")
