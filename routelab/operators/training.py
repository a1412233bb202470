"""Sampling for training sets: positive pairs, stratified negatives, best-of-n, source mixing.

Nothing here compares all members of a group with each other. Members get a rank inside their group and an
anchor addresses the ones it needs by rank, so work grows with anchors x samples per anchor.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.operators.shapes import to_prompt_models  # noqa: F401  (input of this module's operators)
from routelab.scale import join_null_safe, seeded_hash, shuffled_rank, stable


def prompt_accuracy(prompt_models: DataFrame) -> DataFrame:
    """(dataset_id, prompt, record_index, accuracy); accuracy is the share of correct models, 9 digits."""
    n = F.size("models")
    right = F.size(F.filter("models", lambda m: m["correct"]))
    return prompt_models.select("dataset_id", "prompt", "record_index",
                                F.when(n > 0, F.round(right / n, 9)).otherwise(0.0).alias("accuracy"))


def ranked_prompts(prompts: DataFrame, seed: int = 42) -> DataFrame:
    """dataset_id, accuracy, prompt, rn (place in the shuffled (dataset, accuracy) group), n (its size), kept, as anchors, positives and negatives all use it."""
    cols = ["dataset_id", "accuracy", "prompt"]
    return stable(shuffled_rank(prompts.select(*cols), cols[:2], ["prompt"], seed, "rn", hash_keys=["dataset_id", "prompt"], total="n"))


def positive_pairs(prompts: DataFrame, max_pos: int = 1, seed: int = 42, ranked: DataFrame | None = None) -> DataFrame:
    """In each (dataset, accuracy) group in shuffled order, an anchor pairs with the next ``max_pos`` prompts."""
    r = ranked if ranked is not None else ranked_prompts(prompts, seed)
    ahead = r.select("dataset_id", "accuracy", F.col("prompt").alias("positive"), F.explode(
        F.sequence(F.lit(1), F.lit(max(max_pos, 1)))).alias("offset"), (F.col("rn") - F.col("offset")).alias("rn"))
    if max_pos <= 0:
        ahead = ahead.limit(0)
    return r.select("dataset_id", "accuracy", F.col("prompt").alias("anchor"), "rn").join(
        ahead, ["dataset_id", "accuracy", "rn"]).drop("rn")


def _hash_int(*parts: Column) -> Column:
    """60-bit integer from md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def stratified_negatives(anchors: DataFrame, prompts: DataFrame, top_k: int = 32, seed: int = 42, ranked: DataFrame | None = None) -> DataFrame:
    """Up to ``top_k`` prompts of other accuracy per anchor, near/mid/far 5:3:2 by accuracy gap.

    The other-accuracy prompts of a dataset are ordered by (gap, accuracy, shuffled rank). Their positions are
    cut at ceil(50 %) and ceil(80 %). In each stratum an anchor takes a run of neighbouring positions from an
    anchor-specific start, wrapping round: the order is shuffled, so a run is a sample without repeats. Spill-over
    fills from the leftovers in position order from an anchor-specific start. Only group sizes are needed to
    turn positions into (accuracy, rank), so no candidate list is ever built.
    """
    r = ranked if ranked is not None else ranked_prompts(prompts, seed)
    # a row per (dataset, accuracy): the first of each group carries its size
    sizes = r.where("rn = 1").select("dataset_id", "accuracy", "n")
    levels = sizes.groupBy("dataset_id").agg(F.collect_list(F.struct("accuracy", "n")).alias("levels"))
    blocks = levels.select("dataset_id", F.explode("levels.accuracy").alias("accuracy"), "levels")
    others = F.array_sort(F.transform(F.filter("levels", lambda x: x["accuracy"] != F.col("accuracy")), lambda x: F.struct(
        F.round(F.abs(x["accuracy"] - F.col("accuracy")), 9).alias("gap"), x["accuracy"].alias("acc"), x["n"].alias("n"))))
    blocks = blocks.select("dataset_id", "accuracy", others.alias("o"))
    ends = F.transform("o", lambda x, i: F.struct(
        x["acc"].alias("acc"), x["n"].alias("n"),
        F.aggregate(F.slice("o", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y["n"]).alias("end")))
    blocks = blocks.withColumn("b", ends).withColumn("total", F.coalesce(F.try_element_at("b", F.lit(-1))["end"], F.lit(0))) \
        .where("total > 0").drop("o")
    total, k = F.col("total"), F.least(F.lit(top_k).cast("bigint"), F.col("total"))
    near_cut, mid_cut = F.ceil(total * F.lit(0.5)), F.ceil(total * F.lit(0.8))
    near_t, mid_t = F.floor(k * F.lit(0.5)), F.floor(k * F.lit(0.3))
    strata = F.array(
        F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("lo"), near_cut.alias("hi"), near_t.alias("want")),
        F.struct(F.lit(1).alias("s"), near_cut.alias("lo"), mid_cut.alias("hi"), mid_t.alias("want")),
        F.struct(F.lit(2).alias("s"), mid_cut.alias("lo"), total.alias("hi"), (k - near_t - mid_t).alias("want")))
    blocks = blocks.withColumn("k", k).withColumn("strata", F.transform(strata, lambda x: x.withField(
        "take", F.least(x["want"], x["hi"] - x["lo"]))))
    taken = F.aggregate("strata", F.lit(0).cast("bigint"), lambda a, x: a + x["take"])
    blocks = blocks.withColumn("spill", F.col("k") - taken)
    a = join_null_safe(anchors.select("dataset_id", "accuracy", F.col("prompt").alias("anchor")), blocks,
                       ["dataset_id", "accuracy"])

    def start(tag, size):
        return F.pmod(_hash_int(F.lit(str(seed)), tag, F.col("dataset_id"), F.col("anchor")), F.greatest(size, F.lit(1)))
    # leftovers of stratum s are the positions after the run; spill-over walks near, mid, far leftovers in turn
    rich = F.transform("strata", lambda x: x.withField("start", start(x["s"].cast("string"), x["hi"] - x["lo"]))
                       .withField("left", x["hi"] - x["lo"] - x["take"]))
    a = a.withColumn("strata", rich)
    left_total = F.aggregate("strata", F.lit(0).cast("bigint"), lambda acc, x: acc + x["left"])
    a = a.withColumn("left_total", left_total).withColumn("spill", F.least("spill", "left_total")).withColumn(
        "spill_start", start(F.lit("spill"), F.col("left_total")))

    def ring(x, j):
        return x["lo"] + F.pmod(x["start"] + j, F.greatest(x["hi"] - x["lo"], F.lit(1)))
    own = F.flatten(F.transform("strata", lambda x: F.when(x["take"] > 0, F.transform(
        F.sequence(F.lit(0).cast("bigint"), x["take"] - 1), lambda j: ring(x, j))).otherwise(F.array().cast("array<bigint>"))))
    # leftover number q -> stratum by cumulative leftovers -> position
    def leftover(q):
        l0, l1 = F.col("strata")[0]["left"], F.col("strata")[1]["left"]
        s = F.when(q < l0, 0).when(q < l0 + l1, 1).otherwise(2)
        off = F.when(q < l0, q).when(q < l0 + l1, q - l0).otherwise(q - l0 - l1)
        x = F.element_at("strata", s + 1)
        return ring(x, x["take"] + off)
    spilled = F.when(F.col("spill") > 0, F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("spill") - 1),
        lambda j: leftover(F.pmod(F.col("spill_start") + j, F.col("left_total"))))).otherwise(F.array().cast("array<bigint>"))
    pos = a.select("dataset_id", "accuracy", "anchor", "b", F.posexplode(F.concat(own, spilled)).alias("slot", "pos"))
    block = F.try_element_at(F.filter("b", lambda x: x["end"] > F.col("pos")), F.lit(1))
    addr = pos.withColumn("x", block).select(
        "dataset_id", "anchor", F.col("accuracy").alias("anchor_accuracy"), "slot", F.col("x.acc").alias("accuracy"),
        (F.col("pos") - (F.col("x.end") - F.col("x.n")) + 1).alias("rn"))
    return addr.join(r.select("dataset_id", "accuracy", "rn", F.col("prompt").alias("negative")),
                     ["dataset_id", "accuracy", "rn"]).select(
        "dataset_id", "anchor", "slot", "negative", "anchor_accuracy", F.col("accuracy").alias("negative_accuracy"))


def to_triplets(prompt_models: DataFrame, top_k: int = 32, max_pos: int = 1, seed: int = 42) -> DataFrame:
    """channel, anchor, positive and the negatives (at most ``top_k`` per anchor) with their accuracies."""
    p = prompt_accuracy(prompt_models)
    r = ranked_prompts(p, seed)
    pairs = stable(positive_pairs(p, max_pos, seed, r))
    anchors = pairs.select("dataset_id", "accuracy", F.col("anchor").alias("prompt")).distinct()
    neg = stratified_negatives(anchors, p, top_k, seed, r).groupBy("dataset_id", "anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "negative", "negative_accuracy"))), lambda x: F.struct(
            F.lit("user").alias("role"), x["negative"].alias("content"), x["negative_accuracy"].alias("accuracy"))).alias("n"))
    j = pairs.join(neg, ["dataset_id", "anchor"], "left")

    def message(content):
        return F.array(F.struct(F.lit("user").alias("role"), content.alias("content"), F.col("accuracy").alias("accuracy")))
    return j.select(F.col("dataset_id").alias("channel"), message(F.col("anchor")).alias("messages"),
                    message(F.col("positive")).alias("positive_messages"), F.col("n").alias("negative_messages"))


def best_of_n(samples: DataFrame, n: int = 5, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Draw 1..n responses with replacement, keep the best by proxy score, report its oracle score.

    Per (id, model, size, repeat): the chosen index is the first in the whole list with the drawn maximum; tokens
    are summed over the drawn responses.
    """
    d = samples.where(F.size("proxy_scores") > 0).withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    picks = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: (F.pmod(_hash_int(
        F.lit(str(seed)), F.col("id").cast("string"), F.col("model"), F.col("size").cast("string"),
        F.col("rep").cast("string"), i.cast("string")), F.size("proxy_scores").cast("bigint")) + 1).cast("int"))
    d = d.withColumn("picks", picks)
    top = F.array_max(F.transform("picks", lambda i: F.element_at("proxy_scores", i)))
    d = d.withColumn("chosen", F.array_position("proxy_scores", top).cast("int"))
    return d.select("id", "model", "size", "rep", (F.col("chosen") - 1).alias("chosen"),
                    F.element_at("oracle_scores", F.col("chosen")).alias("oracle_score"),
                    F.aggregate("picks", F.lit(0).cast("bigint"), lambda a, i: a + F.element_at("token_num_responses", i)).alias("tokens"))


def mix_sources(sources: Sequence[tuple[str, DataFrame]], sizes: Sequence[int | None], seed: int = 1) -> DataFrame:
    """Flagged rows only (if a ``keep`` column exists), one row per prompt, n drawn per source, prefixed ids."""
    parts = []
    for (name, df), size in zip(sources, sizes):
        d = df.where("keep") if "keep" in df.columns else df
        one = d.groupBy("prompt").agg(F.min("id").alias("id"))
        if size is not None:
            # top-n by hash: Spark keeps n rows per task before the merge
            one = one.withColumn("_h", seeded_hash(seed, F.lit(name), "id")).orderBy("_h", "id").limit(size).drop("_h")
        parts.append(one.select(F.concat(F.lit(name + "/"), F.col("id").cast("string")).alias("id"), "prompt"))
    return reduce(DataFrame.unionByName, parts)
