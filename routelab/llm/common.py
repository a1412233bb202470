"""What the text operators share: reading a table, checkpoints and plain column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.scale import shared_dir, stable

__all__ = ["stable", "table", "text_of", "held_out", "collapse_white", "WHITE", "read_text_column", "scratch", "written", "renamed"]

# ASCII white space of the contracts.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def collapse_white(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that a classifier may not learn from: crc32 of the id as text is a multiple of ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def read_text_column(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` of a table with any other columns."""
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def renamed(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The table with neutral column names, which clash with nothing that an operator adds, and the new names of the wanted columns."""
    return docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))]), [f"_in{docs.columns.index(c)}" for c in wanted]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written below the shared folder and read again: like a checkpoint, but compressed and by column."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
