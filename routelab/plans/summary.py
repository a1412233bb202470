"""The summary table: models and aggregate rows by dataset keys and average columns, for scores and for cost.

Two scans of the facts: one grouped by (dataset, split, model), one by question. Everything after that works
on tables of dataset x model size.

Row and column definitions differ from each other on purpose (they are the benchmark's published rules):
the ``Dataset-Avg`` of Max Expert is the mean of per-dataset maxima, but its ``In-Dist-Avg``/``OOD-Avg`` and all
its cost sums are the best single model's value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.functions.money import dollars
from routelab.operators.splits import split_by_prompt
from routelab.operators.stats import (DATASET, best_first, dataset_outcomes, format_table,
                                      stats_by_dataset_model)
from routelab.scale import distinct_values, stable

AGGREGATE_ROWS = ["AVG", "Random Router", "Max Expert", "Oracle"]


def summary_long(records: DataFrame, cost_metric: str = "total_cost", test_mode: bool = False, seed: int = 42,
                 train_ratio: float = 0.8, ood_datasets: Sequence[str] | None = None,
                 reference_models: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """(section, row_name, metric, column_name, value): the table in long form."""
    if cost_metric not in ("total_cost", "avg_cost_per_record"):
        raise ValueError(f"unknown cost metric {cost_metric}")
    if test_mode:
        records = split_by_prompt(records, train_ratio, seed, ood_datasets or ()).where(~F.col("is_train"))
    ood = list(ood_datasets or ())
    refs = list(reference_models)
    is_ref = F.col("model_name").isin(refs) if refs else F.lit(False)
    cells = stable(stats_by_dataset_model(records).select(
        *DATASET, "model_name", "total_records", "sum_score", "avg_score", F.col(cost_metric).alias("cost"),
        is_ref.alias("is_ref")).withColumn("key", F.concat_ws("/", *DATASET)))
    o = dataset_outcomes(records, refs, seed, tie).withColumn("key", F.concat_ws("/", *DATASET))
    n = F.col("n_questions")
    per = n if cost_metric == "avg_cost_per_record" else F.lit(1)
    outcomes = stable(o.select(
        *DATASET, "key", "n_questions", "n_correct", "random_score",
        (F.col("n_correct") / n).alias("Oracle"), (F.col("random_score") / n).alias("Random Router"),
        (dollars(F.col("oracle_nano")) / per).alias("Oracle_cost"),
        (dollars(F.col("random_nano")) / per).alias("Random Router_cost")))
    main = cells.where("not is_ref")
    # per-dataset cells
    perf, cost = F.lit("performance"), F.lit("cost")
    best = stable(main.groupBy("dataset_id", "key").agg(
        F.avg("avg_score").alias("avg"), F.avg("cost").alias("avg_cost"), F.max("avg_score").alias("max"),
        F.min_by(F.struct("cost", "sum_score", "total_records"), best_first("avg_score")).alias("b")))

    def long(df, row, pairs):
        return [df.select(row.alias("row_name"), m.alias("metric"), c.alias("column_name"), v.cast("double").alias("value"))
                for m, c, v in pairs]

    key = F.col("key")
    parts = long(cells, F.col("model_name"), [(perf, key, F.col("avg_score")), (cost, key, F.col("cost"))])
    parts += long(best, F.lit("AVG"), [(perf, key, F.col("avg")), (cost, key, F.col("avg_cost"))])
    parts += long(best, F.lit("Max Expert"), [(perf, key, F.col("max")), (cost, key, F.col("b.cost"))])
    for row in ("Random Router", "Oracle"):
        parts += long(outcomes, F.lit(row), [(perf, key, F.col(row)), (cost, key, F.col(f"{row}_cost"))])

    # average and sum columns per scope
    side = F.when(F.col("dataset_id").isin(ood) if ood else F.lit(False), "OOD").otherwise("In-Dist")
    ids = distinct_values(cells, "dataset_id")
    has_ood = any(i in ood for i in ids)
    names = ["All"] + ([s for s, hit in (("In-Dist", any(i not in ood for i in ids)), ("OOD", True)) if hit] if has_ood else [])
    scopes = F.explode(F.array(F.lit("All"), side) if has_ood else F.array(F.lit("All")))
    scoped = cells.withColumn("scope", scopes)
    n_main = main.select("model_name").distinct().count()
    per_model = stable(scoped.groupBy("scope", "model_name", "is_ref").agg(
        F.avg("avg_score").alias("ds_avg"), F.sum("cost").alias("ds_sum"),
        (F.sum("sum_score") / F.sum("total_records")).alias("sample")))
    over_main = per_model.where("not is_ref").groupBy("scope").agg(
        F.avg("ds_avg").alias("avg"), F.max("ds_avg").alias("max"), F.avg("ds_sum").alias("avg_sum"),
        F.max("ds_sum").alias("max_sum"), (F.sum("sample") / F.lit(max(n_main, 1))).alias("avg_sample"))
    maxima = best.withColumn("scope", scopes).groupBy("scope").agg(
        F.avg("max").alias("mean_max"), (F.sum("b.sum_score") / F.sum("b.total_records")).alias("max_sample"))
    agg = stable(over_main.join(maxima, "scope"))
    by_scope = outcomes.withColumn("scope", scopes).groupBy("scope").agg(
        *[F.avg(r).alias(r) for r in ("Random Router", "Oracle")],
        *[(F.sum if cost_metric == "total_cost" else F.avg)(f"{r}_cost").alias(f"{r}_cost")
          for r in ("Random Router", "Oracle")],
        (F.sum("random_score") / F.sum("n_questions")).alias("Random Router_sample"),
        (F.sum("n_correct") / F.sum("n_questions")).alias("Oracle_sample"))

    def name(suffix, all_name):
        return F.when(F.col("scope") == "All", all_name).otherwise(F.concat("scope", F.lit(suffix)))

    c_avg, c_sum, c_smp = name("-Avg", "Dataset-Avg"), name("-Sum", "Dataset-Sum"), name("-Sample-Avg", "Sample-Avg")
    absent = cells.select("model_name").distinct().withColumn("scope", F.explode(F.array(*[F.lit(n) for n in names])))
    sample = absent.join(per_model, ["model_name", "scope"], "left").withColumn("sample", F.coalesce("sample", F.lit(0.0)))
    parts += long(per_model, F.col("model_name"), [(perf, c_avg, F.col("ds_avg")), (cost, c_sum, F.col("ds_sum"))])
    parts += long(sample, F.col("model_name"), [(perf, c_smp, F.col("sample"))])
    parts += long(agg, F.lit("AVG"), [(perf, c_avg, F.col("avg")), (cost, c_sum, F.col("avg_sum")),
                                      (perf, c_smp, F.col("avg_sample"))])
    top = F.when(F.col("scope") == "All", F.col("mean_max")).otherwise(F.col("max"))
    parts += long(agg, F.lit("Max Expert"), [(perf, c_avg, top), (cost, c_sum, F.col("max_sum")),
                                             (perf, c_smp, F.col("max_sample"))])
    for row in ("Random Router", "Oracle"):
        parts += long(by_scope, F.lit(row), [(perf, c_avg, F.col(row)), (cost, c_sum, F.col(f"{row}_cost")),
                                             (perf, c_smp, F.col(f"{row}_sample"))])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    r = F.col("row_name")
    section = F.when(r.isin(AGGREGATE_ROWS), "aggregate").when(r.isin(refs) if refs else F.lit(False), "reference") \
        .otherwise("main")
    return out.select(section.alias("section"), "row_name", "metric", "column_name", "value")


def summary_table(records: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(performance, cost) as wide tables in row order: main models, aggregates, reference models."""
    ood = list(kwargs.get("ood_datasets") or ())
    long = stable(summary_long(records, **kwargs))
    keys = distinct_values(long.where(F.col("column_name").contains("/")), "column_name")
    inside = [k for k in keys if k.split("/")[0] not in ood]
    outside = [k for k in keys if k.split("/")[0] in ood]
    tables = []
    for metric, tail in (("performance", ["In-Dist-Avg", "OOD-Avg", "In-Dist-Sample-Avg", "OOD-Sample-Avg",
                                          "Dataset-Avg", "Sample-Avg"]),
                         ("cost", ["In-Dist-Sum", "OOD-Sum", "Dataset-Sum"])):
        part = long.where(F.col("metric") == metric)
        cols = inside + outside + [c for c in tail if not c.startswith(("In-", "OOD")) or outside]
        order = F.when(F.col("section") == "main", 0).when(F.col("section") == "aggregate", 1).otherwise(2)
        place = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in AGGREGATE_ROWS]), F.col("row_name")), F.lit(0))
        wide = part.groupBy("section", "row_name").pivot("column_name", cols).agg(F.first("value"))
        tables.append(wide.orderBy(order, F.when(F.col("section") == "aggregate", place).otherwise(0), "row_name")
                      .drop("section"))
    return tables[0], tables[1]


def formatted_summary(records: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    perf, cost = summary_table(records, **kwargs)
    return format_table(perf), format_table(cost, as_percent=False, precision=4)
