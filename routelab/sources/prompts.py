"""Prompt files, item shards and training-set exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelab.sources.runs import ROWS_PER_FILE, dealt_by

L = F.lit

WIDE_TEXT = ("query string, dataset string, index bigint, records map<string,string>, "
             "usages map<string,struct<completion_tokens:bigint,cost:double,prompt_tokens:bigint>>, _bad string")


def _score(v: Column) -> Column:
    """Number, true/false as 1/0, null as 0.0; anything else null."""
    return F.when(v.isNull(), 0.0).when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))


def clean_wide_prompts(raw: DataFrame) -> DataFrame:
    """Rows with a query and at least one record whose scores are all usable; ``records`` holds texts."""
    d = raw.where("query is not null and query <> '' and records is not null and size(records) > 0")
    ok = F.forall(F.map_values("records"), lambda v: _score(v).isNotNull())
    return d.where(ok).withColumn("records", F.transform_values("records", lambda k, v: _score(v)))


def read_wide_prompts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Wide JSON lines; lines that are not JSON are skipped."""
    raw = spark.read.schema(WIDE_TEXT).option("columnNameOfCorruptRecord", "_bad").json(path)
    return clean_wide_prompts(raw.where("_bad is null").drop("_bad"))


def explode_wide_prompts(wide: DataFrame, split: str) -> DataFrame:
    """Long rows (sample_id, model_name, score, cost); a missing score or cost drops the cell."""
    d = wide.select("dataset", "index", "query", "usages", F.explode("records").alias("model_name", "score"))
    cost = F.try_element_at("usages", F.col("model_name"))["cost"]
    return d.select(F.concat_ws("::", "dataset", F.col("index").cast("string")).alias("sample_id"), F.col("dataset").alias("dataset_id"),
                    L(split).alias("split"), F.col("index").alias("record_index"), "model_name", "score", cost.alias("cost")).where(
        "score is not null and cost is not null")


def write_training_sets(df: DataFrame, path: str, fmt: str = "json", by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    # a folder's rows go to a few tasks, so that it gets files of a useful size
    w = (dealt_by(df, by) if by else df).write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    if by:
        w = w.partitionBy(*by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        # names and keys repeat in every line
        w.option("compression", "gzip").json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def read_item_shards(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType, fmt: str = "json") -> DataFrame:
    """Several shard files or globs of one schema as one table."""
    return spark.read.schema(schema).format(fmt).load(list(paths))


def unify_qa(sources: Sequence[tuple[DataFrame, str, Column, Column, str, str]], sample_size: int | None = None, order: str = "id") -> DataFrame:
    """(frame, task, query, ground truth, metric, description) per source -> one table; with ``sample_size`` the first rows of each only."""
    parts = []
    for df, task, query, truth, metric, text in sources:
        d = df if sample_size is None else df.orderBy(order).limit(sample_size)
        parts.append(d.select(L(task).alias("task_id"), query.alias("query"), truth.alias("ground_truth"), L(metric).alias("metric"), L(text).alias("task_description")))
    return reduce(DataFrame.unionByName, parts)
