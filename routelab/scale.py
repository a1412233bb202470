"""Building blocks that keep ordered work distributed when one group holds most of the rows.

A plain ``row_number() over (partition by g order by x)`` sorts a whole group in one task. The helpers here
split every group into ordered buckets, count the buckets (a small table), and add the totals of the
earlier buckets to the position inside the bucket. The result is the same number, with no group in one task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names, or a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that partition numbers and sampled ranges stay fixed if executors are lost."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A small table written below the shared folder and read again: unlike a checkpoint, Spark knows its size and broadcasts it if it is small."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def seeded_hash(seed: int | str, *keys: str | Column) -> Column:
    """md5 of ``seed|key|key...``: the deterministic stand-in for a random draw."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def _running(buckets: DataFrame, partition: Sequence[str], order: Sequence[Column], bucket: str,
             aggs: dict[str, tuple[str, str]], total: str | None = None) -> DataFrame:
    """Running aggregates over ordered buckets; ``aggs`` maps output -> (count|sum|max|min, column).

    ``total`` names a column for the whole group's value of the first aggregate (a count or sum); it comes from the same small bucket table.
    """
    partition = list(partition)
    make = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
    per_bucket = buckets.groupBy(*partition, bucket).agg(
        *[make[fn](F.lit(1) if c == "*" else F.col(c)).alias(f"_t_{out}") for out, (fn, c) in aggs.items()])
    before = Window.partitionBy(*partition).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(
        *partition, bucket,
        *[(F.sum if fn in ("count", "sum") else make[fn])(f"_t_{out}").over(before).alias(f"_c_{out}")
          for out, (fn, _) in aggs.items()],
        *([F.sum(f"_t_{next(iter(aggs))}").over(Window.partitionBy(*partition)).alias("_total")] if total else []))
    # null-safe join keys: a null group is a group too
    keys = partition + [bucket]
    right = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_c_{o}" for o in aggs], *(["_total"] if total else []))
    cond = None
    for i, k in enumerate(keys):
        this = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = this if cond is None else cond & this
    joined = buckets.join(right, cond, "left")
    inside = Window.partitionBy(*partition, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    result = []
    for out, (fn, c) in aggs.items():
        local = make[fn](F.lit(1) if c == "*" else F.col(c)).over(inside)
        carried = F.col(f"_c_{out}")
        if fn in ("count", "sum"):
            result.append((F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))).alias(out))
        elif fn == "max":
            result.append(F.greatest(carried, local).alias(out))
        else:
            result.append(F.least(carried, local).alias(out))
    kept = [F.col(c) for c in buckets.columns if c != bucket]
    return joined.select(*kept, *result, *([F.col("_total").alias(total)] if total else []))


def ordered_running(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column],
                    aggs: dict[str, tuple[str, str]], total: str | None = None) -> DataFrame:
    """Running aggregates (current row included) along ``order`` inside ``partition``.

    ``order`` must be unique inside a group. Rows are range-partitioned on (partition, order), so a hot group
    spreads over many tasks; the ranges are checkpointed because they come from a sample.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = stable(df.repartitionByRange(*[F.col(p) for p in partition], *cols))
    return _running(ranged.withColumn("_bucket", F.spark_partition_id()), partition, cols, "_bucket", aggs, total)


def _numbered(df: DataFrame, partition: Sequence[str], order: Sequence[Column], out: str, total: str | None, ranged: bool = False) -> DataFrame:
    """1-based positions along ``order`` inside ``partition`` from one exchange.

    Rows are range-partitioned on (partition, order), sorted and checkpointed, so each row's place in its range is fixed. A small table says how many rows of
    each group every range holds and where they begin; with the counts of earlier ranges a place becomes a position, without a window over the rows. The
    table is written, so Spark knows its size and broadcasts it only if it is small.
    """
    keys = [F.col(p) for p in partition]
    dealt = df if ranged else df.repartitionByRange(*keys, *order)
    rows = stable(dealt.sortWithinPartitions(*keys, *order)).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    held = rows.groupBy(*partition, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*partition)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_k{i}" for i in range(len(partition))]
    counts = held.select(*[F.col(p).alias(k) for p, k in zip(partition, names)], F.col("_range").alias("_r"), (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(w).alias("_total"))
    counts = written(counts)
    # a null group is a group too
    same = F.col("_range") == F.col("_r")
    for p, k in zip(partition, names):
        same = same & F.col(p).eqNullSafe(F.col(k))
    extra = [F.col("_total").alias(total)] if total else []
    return rows.join(counts, same).select(*[F.col(c) for c in df.columns], (F.col("_at") + F.col("_shift")).alias(out), *extra)


def ordered_rank(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], out: str = "rn", total: str | None = None, ranged: bool = False) -> DataFrame:
    """1-based position along ``order`` inside ``partition``; ``total`` names a column for the group's size, ``ranged`` says that ``df`` is range-partitioned that way."""
    return _numbered(df, partition, [F.col(o) if isinstance(o, str) else o for o in order], out, total, ranged)


def shuffled_rank(df: DataFrame, partition: Sequence[str], keys: Sequence[str], seed: int | str,
                  out: str = "rn", hash_keys: Sequence[str] | None = None, total: str | None = None) -> DataFrame:
    """1-based position in a seeded pseudo-random order inside ``partition``; ``keys`` identify a row.

    The order is that of an md5 of the seed and the row's keys, so a hot group spreads over many ranges. ``total`` names a column for the group's size.
    """
    d = df.withColumn("_h", seeded_hash(seed, *(hash_keys or keys)))
    return _numbered(d, partition, [F.col("_h"), *[F.col(k) for k in keys]], out, total).drop("_h")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where null matches null; key columns of ``left`` are kept."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        this = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = this if cond is None else cond & this
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def distinct_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a parameter-sized column (model names, dataset keys) for pivots and grids."""
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def with_models(prompts: DataFrame, models: Sequence[str], out: str = "model_name") -> DataFrame:
    """Every prompt once per model, from an array literal: no join and no broadcast."""
    return prompts.withColumn(out, F.explode(F.array(*[F.lit(m) for m in models])))

