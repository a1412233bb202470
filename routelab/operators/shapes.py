"""Reshaping of facts: full grids, dense ids, wide rows, pairs, candidates, edges, and small lookups.

A question's rows are packed only after they are reduced to one row per model, so a packed group is never
larger than the model pool.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from routelab.operators.splits import flag_prompts, normalize_cost_by_task, split_by_prompt
from routelab.operators.stats import keep_last
from routelab.scale import distinct_values, ordered_rank

CELL = ["score", "cost", "prompt_tokens", "completion_tokens"]


def _per_question(records: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Sequence[str] = CELL,
                  extra: Sequence[Column] = ()) -> DataFrame:
    """One row per question: smallest index and a map model -> last record."""
    last = keep_last(records.select(*keys, "model_name", *[c for c in dict.fromkeys(["record_index", *order, *cell])
                                                           if c not in keys]), [*keys, "model_name"], order)
    index = [] if "record_index" in keys else [F.min("record_index").alias("record_index")]
    return last.groupBy(*keys).agg(
        *index, *extra,
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", F.struct(*cell).alias("r"))))).alias("m"))


def complete_grid(records: DataFrame, keys: Sequence[str] = ("dataset_id", "prompt"), models: Sequence[str] | None = None,
                  fill: float = 0.0, order: Sequence[str] = ("record_index",)) -> DataFrame:
    """Every question x every model; missing cells get ``fill`` and zero usage and are flagged.

    The models are an array literal exploded over packed questions: one shuffle by question, no join.
    """
    names = list(models) if models is not None else distinct_values(records, "model_name")
    q = _per_question(records, list(keys), list(order))
    g = q.withColumn("model_name", F.explode(F.array(*[F.lit(n) for n in names])))
    r = F.try_element_at("m", F.col("model_name"))
    index = [] if "record_index" in keys else ["record_index"]
    return g.select(*keys, *index, "model_name", r.isNull().alias("filled"),
                    F.coalesce(r["score"], F.lit(float(fill))).alias("score"),
                    F.coalesce(r["cost"], F.lit(0.0)).alias("cost"),
                    F.coalesce(r["prompt_tokens"], F.lit(0)).alias("prompt_tokens"),
                    F.coalesce(r["completion_tokens"], F.lit(0)).alias("completion_tokens"))


def dense_ids(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(value, id): 0-based ids over the sorted distinct values."""
    return ordered_rank(df.select(col).where(F.col(col).isNotNull()).distinct(), [], [col], "_rn").select(
        col, (F.col("_rn") - 1).alias(out or f"{col}_id"))


def encode_ids(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.join(dense_ids(df, col, out), col)


def to_label_grid(records: DataFrame, order: Sequence[str] = ("record_index",)) -> DataFrame:
    """Equal prompts of different datasets are one prompt; its category is the first dataset by index."""
    names = distinct_values(records, "model_name")
    first = records.groupBy("prompt").agg(F.min(F.struct("record_index", "dataset_id")).alias("f")).select(
        "prompt", F.col("f.dataset_id").alias("category"))
    grid = complete_grid(records, ["prompt"], names, 0.0, order)
    model_id = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model_name")) - 1
    return encode_ids(grid.select("prompt", "model_name", F.col("score").alias("label")), "prompt", "prompt_id").join(
        first, "prompt").select("prompt_id", model_id.alias("model_id"), F.col("category").alias("category_id"),
                                "label", "model_name", "category", "prompt")


def to_wide_prompts(records: DataFrame, models: Sequence[str] | None = None,
                    order: Sequence[str] = ("record_index",)) -> DataFrame:
    names = list(models) if models is not None else distinct_values(records, "model_name")
    q = _per_question(records, ["dataset_id", "prompt"], list(order))
    pool = F.array(*[F.lit(n) for n in names])

    def at(m):
        return F.try_element_at("m", m)
    return q.select(
        F.col("prompt").alias("query"), F.col("dataset_id").alias("dataset"), F.col("record_index").alias("index"),
        F.map_from_arrays(pool, F.transform(pool, lambda m: F.coalesce(at(m)["score"], F.lit(0.0)))).alias("records"),
        F.map_from_arrays(pool, F.transform(pool, lambda m: F.struct(
            F.coalesce(at(m)["completion_tokens"], F.lit(0)).alias("completion_tokens"),
            F.coalesce(at(m)["cost"], F.lit(0.0)).alias("cost"),
            F.coalesce(at(m)["prompt_tokens"], F.lit(0)).alias("prompt_tokens")))).alias("usages"))


def to_question_scores(records: DataFrame, models: Sequence[str] | None = None,
                       order: Sequence[str] = ("record_index",)) -> DataFrame:
    return to_wide_prompts(records, models, order).select(
        "dataset", "index", F.col("query").alias("question"), F.col("records").alias("scores"))


def lookup_descriptions(df: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """Left join on a description table; raises if a key has no description.

    The check runs on the distinct keys; Spark broadcasts the table only if its size allows.
    """
    missing = df.select(key).distinct().join(descriptions, key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no description for {[r[0] for r in missing]}")
    return df.join(descriptions, key, "left")


def to_edges(records: DataFrame, descriptions: DataFrame, vectors: DataFrame | None = None, train_ratio: float = 0.7,
             seed: int = 42, order: Sequence[str] = ("record_index",), sort: bool = True) -> DataFrame:
    """Query-model edges: every model per query, dollars kept, cost min-max scaled per task, train rows first."""
    grid = complete_grid(records, ["dataset_id", "prompt"], None, 0.0, order)
    split = split_by_prompt(grid, train_ratio, seed)
    e = split.select(F.col("dataset_id").alias("task_id"), F.col("prompt").alias("query"), "record_index",
                     F.col("model_name").alias("llm"), F.col("score").alias("effect"), F.col("cost").alias("cost_usd"),
                     (~F.col("is_train")).alias("is_test"))
    e = normalize_cost_by_task(e, "task_id", "cost_usd").withColumnRenamed("cost_norm", "cost")
    e = lookup_descriptions(e, descriptions, "task_id")
    if vectors is not None:
        e = e.join(vectors.select(F.col("prompt").alias("query"), F.col("embedding").alias("query_embedding")), "query", "left")
    return e.orderBy("task_id", "is_test", "record_index", "llm") if sort else e


# pairs

def pair_models(records: DataFrame, strong: str, weak: str, include_ties: bool, order: Sequence[str] = ("record_index",),
                carry: Sequence[str] = ("score", "cost")) -> DataFrame:
    """Both models of one prompt side by side; one grouped pass instead of a self join."""
    out = _pair_columns(_both_sides(records, strong, weak, order, carry), strong, weak, carry)
    return out if include_ties else out.where("not is_tie")


def _both_sides(records: DataFrame, strong: str, weak: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """(dataset_id, prompt, a, b, record_index) of every prompt; a model without a row is null."""
    if strong == weak:
        raise ValueError("strong and weak must differ")
    rank = F.struct(*order, *[c for c in carry if c not in order])

    def side(name):
        return F.max_by(F.when(F.col("model_name") == name, F.struct(*carry)),
                        F.when(F.col("model_name") == name, rank))
    return records.groupBy("dataset_id", "prompt").agg(side(strong).alias("a"), side(weak).alias("b"), F.min("record_index").alias("record_index"))


def _pair_columns(sides: DataFrame, strong: str, weak: str, carry: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    a, b = F.col("a.score"), F.col("b.score")
    return sides.where("a is not null and b is not null").select(
        "dataset_id", "prompt", "record_index", F.lit(strong).alias("model_a"), F.lit(weak).alias("model_b"),
        *[F.col(f"a.{c}").alias(f"{c}_model_a") for c in carry], *[F.col(f"b.{c}").alias(f"{c}_model_b") for c in carry],
        (a == b).alias("is_tie"), F.when(a == b, "tie").when(a > b, "model_a").otherwise("model_b").alias("winner"), *keep)


def prune_pairs(train: DataFrame, test: DataFrame) -> DataFrame:
    """Prompt table 0..n-1 in (dataset, index) order over the prompts that either side uses."""
    keys = ["dataset_id", "prompt", "record_index"]
    used = train.select(*keys).unionByName(test.select(*keys)).distinct()
    return ordered_rank(used, [], ["dataset_id", "record_index", "prompt"], "_rn").select(
        *keys, (F.col("_rn") - 1).alias("idx"))


def check_pair_coverage(records: DataFrame, pairs: DataFrame, strong: str, weak: str) -> DataFrame:
    """Prompts that both models answered but that have no pair row (must be empty)."""
    both = records.where(F.col("model_name").isin(strong, weak)).groupBy("dataset_id", "prompt").agg(
        F.max(F.when(F.col("model_name") == strong, 1)).alias("s"), F.max(F.when(F.col("model_name") == weak, 1)).alias("w"))
    return both.where("s = 1 and w = 1").select("dataset_id", "prompt").join(pairs, ["dataset_id", "prompt"], "left_anti")


def to_pairs(records: DataFrame, strong: str, weak: str, train_ratio: float = 0.8, seed: int = 42,
             order: Sequence[str] = ("record_index",), ood_datasets: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train pairs without ties, test pairs with ties, prompt index).

    Records are read once, into a row per prompt; the split and the index are ranks over these rows, which the outputs share.
    """
    carry = ("score", "cost")
    sides = flag_prompts(_both_sides(records, strong, weak, order, carry), train_ratio, seed, ood_datasets)
    used = _pair_columns(sides, strong, weak, carry, ["is_train"]).where("not is_train or not is_tie")
    pairs = ordered_rank(used, [], ["dataset_id", "record_index", "prompt"], "_rn").withColumn("idx", F.col("_rn") - 1).drop("_rn")
    return (pairs.where("is_train").drop("is_train"), pairs.where("not is_train").drop("is_train"), pairs.select("dataset_id", "prompt", "record_index", "idx"))


# candidates

def to_candidates(records: DataFrame, models: Sequence[str], order: Sequence[str] = ("record_index",),
                  text: str = "prediction", truth: str = "ground_truth", metric: str = "bartscore") -> DataFrame:
    if len(models) != 2:
        raise ValueError("exactly two models are needed")
    cell = ["score", "cost", "prompt_tokens", "completion_tokens", text, truth]
    q = _per_question(records, ["dataset_id", "prompt", "record_index"], list(order), cell)

    def cand(name):
        r = F.try_element_at("m", F.lit(name))
        return F.struct(
            F.lit(name).alias("model"), F.coalesce(r[text], F.lit("")).alias("text"), F.lit("greedy").alias("decoding_method"),
            F.create_map(F.lit(metric), F.coalesce(r["score"], F.lit(0.0))).alias("scores"),
            F.coalesce(r["prompt_tokens"], F.lit(0)).alias("token_num_prompt"),
            F.coalesce(r["completion_tokens"], F.lit(0)).alias("token_num_responses"),
            F.array(F.coalesce(r["cost"], F.lit(0.0))).alias("cost"))
    return q.select(
        F.concat_ws("/", "dataset_id", F.col("record_index").cast("string")).alias("id"), F.lit("").alias("instruction"),
        F.col("prompt").alias("input"), F.element_at(F.map_values("m"), 1)[truth].alias("output"),
        F.array(*[cand(m) for m in models]).alias("candidates"))


def filter_candidates(df: DataFrame, models: Sequence[str] | None = None, methods: Sequence[str] | None = None,
                      n: int = 2) -> DataFrame:
    """First candidate per listed model (or decoding method), in list order; a row without exactly n fails."""
    field, order = ("model", models) if models is not None else ("decoding_method", methods)
    if order is None:
        raise ValueError("give models or methods")
    picked = F.filter(F.transform(F.array(*[F.lit(o) for o in order]), lambda o: F.try_element_at(
        F.filter("candidates", lambda c: c[field] == o), F.lit(1))), lambda c: c.isNotNull())
    ok = F.size("_p") == n
    return df.withColumn("_p", picked).withColumn("candidates", F.when(ok, F.col("_p")).otherwise(
        F.raise_error(F.concat(F.lit("candidates missing for row "), F.col("id").cast("string"))))).drop("_p")


def format_window(candidates: DataFrame, prices: Sequence[tuple[str, float, float]], window: int = 10) -> DataFrame:
    """Scores and response tokens as arrays of ``window``; cost per element by the first matching model prefix.

    ``candidates``: (id, model, score array, scalar_score, token_num_prompt, token array, scalar tokens).
    """
    def widen(array, scalar):
        return F.when(F.col(array).isNotNull(), F.slice(F.col(array), 1, window)).otherwise(
            F.array_repeat(F.col(scalar).cast("double"), window))
    model = F.col("model")
    price = F.coalesce(*[F.when(model.startswith(p), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")))
                         for p, i, o in prices])
    tokens = widen("response_tokens", "response_token")
    return candidates.withColumn("scores", widen("scores", "score")).withColumn("_t", tokens).withColumn("_p", price) \
        .withColumn("cost", F.when(F.col("_p").isNotNull(), F.transform("_t", lambda t: F.col("_p.i") * F.col("token_num_prompt")
                                                                        + F.col("_p.o") * t))).drop("_t", "_p")


def merge_responses(base: DataFrame, others: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """Adds each source's (model -> response) to the base rows: one union and one grouped pass, not n joins."""
    stacked = base.select(key, "model", "response")
    for o in others:
        stacked = stacked.unionByName(o.select(key, "model", "response"))
    per_model = stacked.groupBy(key, "model").agg(F.max("response").alias("response"))
    packed = per_model.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "response")))).alias("responses"))
    return base.select(key).distinct().join(packed, key)


# small lookups

def _rule_heads(rules: DataFrame, shots: DataFrame, max_shots: int | None) -> DataFrame:
    """(rule_id, head): the rule and its few-shot questions and answers in order, the beginning of every prompt of that rule."""
    s = shots.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("shot_no", "question", "answer"))).alias("s"))
    lines = F.transform("s", lambda x: F.concat(x["question"], F.lit("\n"), x["answer"]))
    if max_shots is not None:
        lines = F.slice(lines, 1, max_shots)
    shot_text = s.select("rule_id", F.array_join(lines, "\n").alias("shots"))
    both = rules.select("rule_id", "rule_content").join(shot_text, "rule_id", "full").where("rule_id is not null")
    some = F.col("rule_content").isNotNull() | F.col("shots").isNotNull()
    return both.select("rule_id", F.when(some, F.concat_ws("\n", "rule_content", "shots")).alias("head"))


def join_rule_and_fewshot(items: DataFrame, rules: DataFrame, shots: DataFrame, max_shots: int | None = None) -> DataFrame:
    """Prompt text = rule, then the rule's few-shot questions and answers in order, then the question.

    Few-shot lists are short by design (three per rule); the rule tables are joined by key and Spark broadcasts
    them only when they are small.
    """
    j = items.join(_rule_heads(rules, shots, max_shots), "rule_id", "left")
    return j.withColumn("formatted", F.concat_ws("\n", "head", "question")).drop("head")


def digest_rule_and_fewshot(items: DataFrame, rules: DataFrame, shots: DataFrame, max_shots: int | None = None, spread: int = 16) -> DataFrame:
    """``formatted_md5`` of the prompts of ``join_rule_and_fewshot``, for lists of any length.

    The texts together grow with items x shots, so none is built: the beginning that a rule's prompts share is hashed once per
    part of its items, and each item goes on from that state with its question. ``spread`` is the number of parts of a rule.
    """
    parted = items.withColumn("_part", F.pmod(F.xxhash64("question"), F.lit(spread)))
    heads = _rule_heads(rules, shots, max_shots).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    schema = StructType([*items.schema.fields, StructField("formatted_md5", StringType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.drop_columns(["_part"])
        questions = rows["question"].to_pylist()
        found = []
        for head in (right["head"] if right.num_rows else [pa.scalar(None, pa.string())]):
            known = head.as_py()
            start = hashlib.md5(b"" if known is None else known.encode(), usedforsecurity=False)
            after = start.copy()
            if known is not None:
                after.update(b"\n")
            digests = []
            for q in questions:
                state = (start if q is None else after).copy()
                state.update(b"" if q is None else q.encode())
                digests.append(state.hexdigest())
            found.append(rows.append_column("formatted_md5", pa.array(digests, pa.string())))
        return pa.concat_tables(found)
    keys = ["rule_id", "_part"]
    return parted.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(finish, schema)


def join_baseline_answers(items: DataFrame, settings: DataFrame, answers: DataFrame,
                          default: str = "hard_prompt") -> DataFrame:
    """Item -> baseline model of its category (or of the default), then that model's answer for the uid."""
    known = items.join(settings.select(F.col("category").alias("_c"), F.col("baseline").alias("_b")),
                       F.col("category") == F.col("_c"), "left")
    fallback = settings.where(F.col("category") == default).select(F.col("baseline").alias("_d")).withColumn("_one", F.lit(1))
    j = known.withColumn("_one", F.lit(1)).join(fallback, "_one", "left").withColumn("baseline", F.coalesce("_b", "_d"))
    a = answers.select(F.col("model").alias("baseline"), "uid", F.col("answer").alias("baseline_answer"))
    return j.drop("_c", "_b", "_d", "_one").join(a, ["baseline", "uid"], "left").withColumn(
        "has_baseline", F.col("baseline_answer").isNotNull())


# per-question model lists

def to_prompt_models(records: DataFrame, order: Sequence[str] = ("record_index",)) -> DataFrame:
    q = _per_question(records, ["dataset_id", "prompt"], list(order))
    return q.select("dataset_id", "prompt", "record_index", F.transform(F.map_entries("m"), lambda e: F.struct(
        e["key"].alias("model_name"), e["value"]["score"].alias("score"), (e["value"]["score"] > 0).alias("correct"),
        e["value"]["prompt_tokens"].alias("prompt_tokens"), e["value"]["completion_tokens"].alias("completion_tokens"),
        e["value"]["cost"].alias("cost"))).alias("models"))


def split_difficulty(prompt_models: DataFrame) -> DataFrame:
    n = F.size("models")
    right = F.size(F.filter("models", lambda m: m["correct"]))
    return prompt_models.withColumn("difficulty", F.when(n == 0, "normal").when(right == n, "all_correct")
                                    .when(right == 0, "all_error").otherwise("normal"))


def preference_pairs(samples: DataFrame) -> DataFrame:
    """(chosen, rejected) rows per (prompt, model) from responses with different scores.

    Responses sort by score (ties in list order); the middle is element n//2, counted from zero.
    """
    packed = F.array_sort(F.transform(F.arrays_zip("scores", "responses"), lambda x, i: F.struct(
        x["scores"].alias("s"), i.alias("i"), x["responses"].alias("r"))))
    d = samples.withColumn("p", packed).withColumn("mid", F.try_element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int")))
    lo, hi = F.try_element_at("p", F.lit(1)), F.try_element_at("p", F.lit(-1))
    pair = F.array_compact(F.array(
        F.when(lo["s"] < F.col("mid.s"), F.struct(F.lit("middle_worst").alias("kind"), F.col("mid.r").alias("chosen"), lo["r"].alias("rejected"))),
        F.when(hi["s"] > F.col("mid.s"), F.struct(F.lit("best_middle").alias("kind"), hi["r"].alias("chosen"), F.col("mid.r").alias("rejected")))))
    text = "Human: {} Assistant: "
    lead = F.concat(F.lit(text.split("{}")[0]), F.col("prompt"), F.lit(text.split("{}")[1]))
    return d.select("id", "prompt", "model", F.explode(pair).alias("x")).select(
        "id", "model", F.col("x.kind").alias("kind"), F.concat(lead, F.col("x.chosen")).alias("chosen"),
        F.concat(lead, F.col("x.rejected")).alias("rejected"))


def positives_negatives(question_scores: DataFrame, top_k: int, last_k: int) -> DataFrame:
    """Per prompt the top-k models with score > 0 and the bottom-k with score <= 0.5 (ties by name)."""
    e = F.map_entries("scores")
    down = F.array_sort(F.transform(e, lambda x: F.struct((-x["value"]).alias("s"), x["key"].alias("m"))))
    up = F.array_sort(F.transform(e, lambda x: F.struct(x["value"].alias("s"), x["key"].alias("m"))))
    return question_scores.select(
        "dataset", "index", "question",
        F.transform(F.filter(F.slice(down, 1, top_k), lambda x: x["s"] < 0), lambda x: x["m"]).alias("positives"),
        F.transform(F.filter(F.slice(up, 1, last_k), lambda x: x["s"] <= 0.5), lambda x: x["m"]).alias("negatives"))
