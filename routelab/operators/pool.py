"""Model pools, prices and prompt texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.functions import text as T

L = F.lit


def filter_pool(df: DataFrame, excluded_models: Sequence[str] = (), excluded_datasets: Sequence[str] = (), mode: str = "hard") -> DataFrame:
    """``hard`` drops excluded datasets everywhere, ``soft`` only from the test rows (``is_train`` false)."""
    if mode not in ("hard", "soft"):
        raise ValueError(f"unknown mode {mode}")
    keep = ~F.col("model_name").isin(list(excluded_models)) if excluded_models else L(True)
    if excluded_datasets:
        out = F.col("dataset_id").isin(list(excluded_datasets))
        keep = keep & (~out if mode == "hard" else (~out | F.col("is_train")))
    return df.where(keep)


def mark_ood(df: DataFrame, ood_datasets: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("is_ood", F.col("dataset_id").isin(list(ood_datasets)) if ood_datasets else L(False))


def _price(df: DataFrame, prices: DataFrame) -> DataFrame:
    return df.join(prices.select("model_name", F.col("prompt_price").alias("_pp"), F.col("completion_price").alias("_cp")), "model_name", "left")


def _computed() -> Column:
    pp, cp = F.coalesce("_pp", L(0.0)), F.coalesce("_cp", L(0.0))
    value = F.col("prompt_tokens") / 1e6 * pp + F.col("completion_tokens") / 1e6 * cp
    return F.when((pp > 0) | (cp > 0), value).otherwise(0.0)


def token_cost(df: DataFrame, prices: DataFrame, provider: str = "provider_cost") -> DataFrame:
    """The provider's cost if given, else tokens x price per million, else 0."""
    given = F.col(provider) if provider in df.columns else L(None).cast("double")
    return _price(df, prices).withColumn("cost", F.coalesce(given, _computed())).drop("_pp", "_cp")


def reprice_zero_cost(df: DataFrame, prices: DataFrame) -> DataFrame:
    return _price(df, prices).withColumn("cost", F.when(F.col("cost") == 0, _computed()).otherwise(F.col("cost"))).drop("_pp", "_cp")


# prompt styles: what a list column turns into
STYLES = {"options": T.lettered_options, "bullets": T.bullets, "table": T.pipe_table, "option_map": T.lettered_map}


def format_prompts(items: DataFrame, template: str, style: str | dict[str, str] = "plain") -> DataFrame:
    """``{column}`` placeholders of the template filled; list columns rendered by their style.

    ``style`` maps list columns to one of: options (A. x), option_map, bullets, table.
    """
    styles = style if isinstance(style, dict) else {}
    values = {c: STYLES[styles[c]](F.col(c)) if c in styles else F.col(c).cast("string") for c in items.columns if "{" + c + "}" in template}
    return items.withColumn("prompt", T.fill_template(template, values))
