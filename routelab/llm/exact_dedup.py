"""Exact de-duplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

The hash groups are built from slim rows with partial sums, so a group with a third of all rows costs one row per task. The bytes of
documents in groups of two or more are then compared with the bytes of the group's kept row. Large groups are dealt over salts (one copy
of the kept text for every ``rows_per_salt`` members), so no task gets a whole hot group. Rows whose bytes differ although the hash is
equal are grouped once more by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import collapse_white, renamed, stable, text_of

ROWS_PER_SALT = 512


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = ROWS_PER_SALT,
                     hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of ASCII white space become one space; null is the empty text. The smallest id of a group
    stays; a null id never wins against another one, and a group of null ids keeps null. A row that repeats both the id and the text is
    the same document again: its rows count in ``group_size`` and carry the same values. A very long text is hashed and compared whole. An empty
    table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), collapse_white(text_of(text_col)).alias("norm")).withColumn("h", hash_fn(F.col("norm")))
    slim = stable(base.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")))
    # both sides of the join come from tables, so that Spark can split a hot hash
    groups = stable(slim.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    placed = slim.join(groups, "h")

    members = (placed.where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "keep_id", "group_size").distinct()
               .withColumn("_salts", F.ceil(F.col("group_size") / rows_per_salt).cast("int")))
    # written once, as it is read twice: the texts of documents that have copies
    texts = stable(base.join(members, base["doc_id"].eqNullSafe(members["_id"]) & (base["h"] == members["_h"])).select(
        "doc_id", "h", "norm", "keep_id", "_salts", F.pmod(F.xxhash64("doc_id"), F.col("_salts")).cast("int").alias("_salt")))
    # any text under the kept id may stand for the group: rows that differ from it are grouped by their bytes below
    kept = (texts.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("h", "_salts", F.col("norm").alias("kept_norm")).dropDuplicates(["h"])
            .select("h", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "kept_norm"))
    strays = texts.join(kept, ["h", "_salt"]).where(F.col("norm") != F.col("kept_norm")).select("doc_id", "h", "norm")
    regrouped = strays.groupBy("h", "norm").agg(F.min("doc_id").alias("stray_keep"), F.count("*").alias("stray_size"))
    stray_rows = (strays.join(regrouped, ["h", "norm"]).select(F.col("doc_id").alias("_id"), "h", F.sha2("norm", 256).alias("text_sha256"), "stray_keep", "stray_size").distinct())
    stray_rows = stable(stray_rows)
    lost = stable(stray_rows.select("h", "text_sha256", "stray_size").distinct().groupBy("h").agg(F.sum("stray_size").alias("lost")))

    out = (placed.join(stray_rows, placed["doc_id"].eqNullSafe(stray_rows["_id"]) & (placed["h"] == stray_rows["h"])
                       & (placed["text_sha256"] == stray_rows["text_sha256"]), "left")
           .select(placed["doc_id"], placed["h"], placed["keep_id"], placed["group_size"], placed["text_sha256"], "stray_keep", "stray_size")
           .join(lost, "h", "left"))
    is_stray = F.col("stray_size").isNotNull()
    keep = F.when(is_stray, F.col("stray_keep")).otherwise(F.col("keep_id"))
    size = F.when(is_stray, F.col("stray_size")).otherwise(F.col("group_size") - F.coalesce(F.col("lost"), F.lit(0)))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns; of rows that repeat both id and text one stays."""
    rows, (i, t) = renamed(docs, id_col, text_col)
    marks = exact_duplicates(rows, i, t).where("kept").groupBy(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")).agg(F.count("*").alias("_rows"))
    marks = stable(marks)
    sha = rows.withColumn("_sha", F.sha2(collapse_white(text_of(t)), 256))
    hits = sha.join(marks, sha[i].eqNullSafe(marks["_keep_id"]) & (sha["_sha"] == marks["_keep_sha"]))
    once = hits.where("_rows = 1")
    if not marks.where("_rows > 1").isEmpty():
        once = once.unionByName(hits.where("_rows > 1").dropDuplicates(["_keep_id", "_keep_sha"]))
    return once.select(*rows.columns).toDF(*docs.columns)
