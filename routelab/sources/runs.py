"""Evaluation runs on disk: reading, filtering, newest-run selection, planning and writing.

The exchange format is one JSON document per run file (header fields and a ``records`` array). Reading such files
needs one task per file. Runs that this library writes are JSON lines in ``dataset_id=/split=/model_name=``
folders, so a run of any size is written and read by many tasks, and filters prune folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelab.functions.money import nano, sum_money
from routelab.functions.text import build_scorer_text
from routelab.operators.stats import run_aggregates
from routelab.scale import stable

L = F.lit
RUN_KEYS = ("dataset_id", "split", "model_name")

RUN_SCHEMA = (
    "performance double, time_taken double, cost double, prompt_tokens bigint, completion_tokens bigint, counts bigint, model_name string, "
    "dataset_name string, split string, data_fingerprint string, demo boolean, extra_metrics map<string,double>, "
    "records array<struct<index:bigint, origin_query:string, prompt:string, prompt_tokens:bigint, completion_tokens:bigint, cost:double, "
    "score:double, prediction:string, ground_truth:string, raw_output:string, extra_fields:map<string,string>>>, _bad string")


def _stamp(path: Column, mtime: Column) -> Column:
    """YYYYMMDDHHMMSS of the file name as a number, else the modification time in seconds (always smaller)."""
    p = r"(\d{8})_(\d{6})\.json$"
    text = F.concat(F.regexp_extract(path, p, 1), F.regexp_extract(path, p, 2))
    return F.coalesce(text.try_cast("bigint"), F.unix_timestamp(mtime))


@dataclass
class RunFiles:
    """The files of one scan: ``runs`` (a row per good file), ``rejects`` (path, reason, detail of the others) and ``counts`` (of all files, good ones, each reason)."""
    runs: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


# reasons of a reject, the first that fits
REASONS = ["unreadable", "no_model", "no_dataset", "no_records"]


def scan_run_files(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType = RUN_SCHEMA) -> RunFiles:
    """Reads run files once and tells good ones from rejects, which are kept with their reason instead of being dropped.

    The scan is checkpointed, so both outputs and the counts come from one reading of the files (an observation would count on the way, but its listener
    keeps fitted models of the session from being sent to tasks). A file of several reasons is listed under the first of ``REASONS``; a file without records is a reject, an empty list of records is not.
    """
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), L("")).isNull()
    reason = (F.when(F.col("_bad").isNotNull(), "unreadable").when(blank("model_name"), "no_model").when(blank("dataset_name"), "no_dataset").when(F.col("records").isNull(), "no_records"))
    seen = raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("_mtime"), reason.alias("reason"))
    rows = stable(seen)
    each = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    counts = rows.agg(F.count("*").alias("files"), F.count_if(F.col("reason").isNull()).alias("good"), *each).first().asDict()
    good = rows.where("reason is null").withColumn("run_ts", _stamp(F.col("path"), F.col("_mtime"))).withColumnRenamed("dataset_name", "dataset_id").drop("_bad", "_mtime", "reason")
    return RunFiles(good, rows.where("reason is not null").select("path", "reason", F.left("_bad", L(200)).alias("detail")), counts)


def read_run_files(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType = RUN_SCHEMA) -> DataFrame:
    """One row per run file; files that do not parse or have no model name are left out (``scan_run_files`` lists them)."""
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("_mtime")).where(
        "_bad is null and model_name is not null").withColumn("run_ts", _stamp(F.col("path"), F.col("_mtime"))).withColumnRenamed(
        "dataset_name", "dataset_id").drop("_bad", "_mtime")


def explode_records(runs: DataFrame) -> DataFrame:
    """Run rows -> record rows. Filters on run columns belong before this step."""
    return runs.select("dataset_id", "split", "model_name", "demo", "run_ts", "path", F.explode("records").alias("r")).select(
        "dataset_id", "split", "model_name", "demo", "run_ts", "path", F.col("r.index").alias("record_index"), "r.origin_query", "r.prompt", "r.prediction",
        "r.ground_truth", "r.raw_output", "r.score", "r.prompt_tokens", "r.completion_tokens", "r.cost", "r.extra_fields")


def read_runs(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType = RUN_SCHEMA) -> DataFrame:
    return explode_records(read_run_files(spark, path, schema))


def filter_runs(runs: DataFrame, *, skip_demo: bool = True, datasets: Sequence[str] | None = None, models: Sequence[str] | None = None,
                splits: Sequence[str] | None = None, exclude_datasets: Sequence[str] | None = None, exclude_models: Sequence[str] | None = None,
                exclude_splits: Sequence[str] | None = None, reference_models: Sequence[str] | None = None,
                include_reference: bool = False) -> DataFrame:
    """Include lists win over exclude lists; an empty include list keeps nothing."""
    refs = reference_models if include_reference else None
    if models is not None or refs is not None:
        models = sorted({*(models or ()), *(refs or ())})
    keep = ~F.coalesce(F.col("demo"), L(False)) if skip_demo else L(True)
    for name, inc, exc in (("dataset_id", datasets, exclude_datasets), ("model_name", models, exclude_models), ("split", splits, exclude_splits)):
        if inc is not None:
            keep = keep & (F.col(name).isin(list(inc)) if inc else L(False))
        elif exc:
            keep = keep & ~F.coalesce(F.col(name).isin(list(exc)), L(False))
    return runs.where(keep)


def keep_latest_run(runs: DataFrame, keys: Sequence[str] = RUN_KEYS, ts: str = "run_ts", tie: str = "path") -> DataFrame:
    """Rows of the newest run per key; a null in a key is a value of its own. The newest stamp is an aggregate; rows are matched by it, not ranked."""
    newest = runs.groupBy(*keys).agg(F.max(F.struct(ts, tie)).alias("_m")).select(*keys, F.col(f"_m.{ts}").alias(ts), F.col(f"_m.{tie}").alias(tie))
    wanted = newest.select(*[F.col(c).alias(f"_n_{c}") for c in (*keys, ts, tie)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in (*keys, ts, tie)])
    return runs.join(wanted, same, "left_semi")


def normalize_records(runs: DataFrame) -> DataFrame:
    """Missing text "", nested values as JSON text, missing score 0.0 and tokens 0 and cost 0.0."""
    out = []
    for f in runs.schema.fields:
        c = F.col(f.name)
        if f.name in ("origin_query", "prompt", "prediction", "ground_truth"):
            text = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
            out.append(F.coalesce(text, L("")).alias(f.name))
        elif f.name in ("score", "cost"):
            out.append(F.coalesce(c.cast("double"), L(0.0)).alias(f.name))
        elif f.name in ("prompt_tokens", "completion_tokens"):
            out.append(F.coalesce(c.cast("bigint"), L(0).cast("bigint")).alias(f.name))
        else:
            out.append(c)
    return runs.select(*out)


def select_columns(df: DataFrame, include: Sequence[str]) -> DataFrame:
    """Listed columns that exist, in list order; unknown names are ignored."""
    return df.select(*[c for c in include if c in df.columns])


def validate_model_lists(models: Sequence[str] | None, reference_models: Sequence[str] | None) -> None:
    both = sorted(set(models or ()) & set(reference_models or ()))
    if both:
        raise ValueError(f"models are also reference models: {both}")


def read_cascade_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records with text, score and cost; header fields that are missing come from ``bench/<dataset>/<split>/<model>/``."""
    return cascade_records(_records_with_path(spark, paths))


def _records_with_path(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option(
        "columnNameOfCorruptRecord", "_bad").json(path)
    p = F.col("_metadata.file_path")
    part = r"/bench/([^/]+)/([^/]+)/([^/]+)/[^/]*$"
    fill = lambda c, i: F.coalesce(F.nullif(F.col(c), L("")), F.nullif(F.regexp_extract(p, part, i), L("")))
    return raw.where("records is not null").select(
        F.coalesce(fill("dataset_name", 1), L("unknown")).alias("dataset_id"), fill("split", 2).alias("split"),
        F.coalesce(fill("model_name", 3), L("unknown")).alias("model_name"), p.alias("path"), F.explode("records").alias("r")).select(
        "dataset_id", "split", "model_name", "path", F.col("r.index").alias("record_index"), "r.prompt", "r.origin_query", "r.prediction", "r.raw_output", "r.score", "r.cost")


def cascade_records(records: DataFrame) -> DataFrame:
    """(sample_id, dataset_id, split, model_name, record_index, text, score, cost) of complete records."""
    blank = lambda c: F.nullif(F.col(c), L(""))
    text = build_scorer_text(F.coalesce(blank("prompt"), blank("origin_query")), F.coalesce(blank("prediction"), F.col("raw_output")))
    d = records.withColumn("text", text)
    return d.where("text <> '' and score is not null and cost is not null").select(
        F.concat_ws("::", "dataset_id", F.col("record_index").cast("string")).alias("sample_id"), "dataset_id", "split", "model_name", "record_index",
        "text", "score", "cost")


ROWS_PER_FILE = 1_000_000
SALTS = 8


def dealt_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by folder keys and a salt: a folder is written by ``SALTS`` tasks at most, however many tasks read the input."""
    return rows.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]), L(SALTS)))


def write_runs(records: DataFrame, path: str, run_ts: str, mode: str = "append") -> None:
    """Records as JSON lines per run folder, and the run headers as a table next to them.

    Spark's commit protocol moves finished files into place; no run is packed into one row. Files are compressed; as their rows are bounded, a run is still read by many tasks.
    """
    stamped = records.withColumn("run_ts", L(run_ts))
    dealt_by(stamped, [*RUN_KEYS, "run_ts"]).write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "gzip").partitionBy(
        "dataset_id", "split", "model_name", "run_ts").json(f"{path}/records")
    run_aggregates(records).withColumn("run_ts", L(run_ts)).write.mode(mode).json(f"{path}/headers")


def read_written_runs(spark: SparkSession, path: str, record_schema: T.StructType) -> DataFrame:
    keys = T.StructType([T.StructField(k, T.StringType()) for k in (*RUN_KEYS, "run_ts")])
    body = [f for f in record_schema.fields if f.name not in keys.names]
    return spark.read.schema(T.StructType([*body, *keys.fields])).json(f"{path}/records")


def list_runs(runs: DataFrame) -> DataFrame:
    """Newest non-demo run per key with its counts, newest first."""
    live = runs.where(~F.coalesce(F.col("demo"), L(False)))
    return keep_latest_run(live).groupBy(*RUN_KEYS).agg(
        F.max("run_ts").alias("updated_at"), F.count("*").alias("counts"), F.avg("score").alias("performance"), sum_money("cost").alias("cost")).orderBy(
        F.desc("updated_at"), *RUN_KEYS)


def fingerprint(items: DataFrame, keys: Sequence[str] = ("dataset_id", "split")) -> DataFrame:
    """A digest of all rows of a split that does not depend on their order.

    Each row is hashed with the length of every value (columns in name order, so no two different rows read alike) and the hash parts are
    summed as decimals, so any number of rows combines map-side; the sums and the count are hashed once more.
    """
    body = sorted(c for c in items.columns if c not in keys)
    value = lambda c: F.coalesce(F.concat(F.length(c), L(":"), c), L("-"))
    row = F.sha2(F.concat(*[value(F.col(c).cast("string")) for c in body]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    g = items.withColumn("_h", row).groupBy(*keys).agg(F.count("*").alias("n_items"), *[part(i).alias(f"_p{i}") for i in range(8)])
    return g.select(*keys, "n_items", F.sha2(F.concat_ws(":", "n_items", *[f"_p{i}" for i in range(8)]), 256).alias("fingerprint"))


def plan_runs(items_fp: DataFrame, models: Sequence[str], done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Runs still needed: not done, or done on other data. A done run without a fingerprint stays.

    ``done``: (dataset_id, split, model_name, fingerprint) of the newest non-demo runs.
    """
    want = items_fp.select("dataset_id", "split", "fingerprint").withColumn("model_name", F.explode(F.array(*[L(m) for m in models])))
    plan = want.withColumn("run_key", F.concat_ws("/", "dataset_id", "split", "model_name"))
    if not overwrite:
        have = done.select(*RUN_KEYS, F.coalesce("fingerprint", L("")).alias("_old"))
        plan = plan.join(have, list(RUN_KEYS), "left").where(
            F.col("_old").isNull() | ((F.col("_old") != "") & (F.coalesce("fingerprint", L("")) != "") & (F.col("_old") != F.col("fingerprint")))).drop("_old")
    return plan.select("dataset_id", "split", "model_name", "run_key")


def summarize_external_run(records: DataFrame, model: str, dataset: str = "external_bench", split: str = "test") -> DataFrame:
    """One run header row for the records of another harness."""
    return records.agg(
        F.coalesce(F.avg((F.col("score") > 0).cast("int")), L(0.0)).alias("performance"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), (F.sum(nano("cost")).cast("double") / 1e9).alias("cost"), F.count("*").alias("counts")).select(
        L(dataset).alias("dataset_id"), L(split).alias("split"), L(model).alias("model_name"), "performance", "prompt_tokens", "completion_tokens", "cost", "counts")



REPORT_SCHEMA = ("all_dataset_avg double, sample_avg double, total_cost double, "
                 "datasets map<string,struct<total:bigint,selection_accuracy:double,routing_accuracy:double,total_cost:double>>")


def read_reports(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Pairwise reports, one JSON document per file; the seed is the number after ``seed`` in the path."""
    raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    path = F.col("_metadata.file_path")
    seed = F.regexp_extract(path, r"seed=?(\d+)", 1)
    return raw.select(F.when(seed != "", seed).otherwise(path).alias("seed"), *raw.columns)
