"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same number of copies, target / source size. The whole part is taken outright; the fraction is
settled by the pivotal method: two fractional documents trade mass (words, so the total stays) in a random direction until one of them is
taken or left, the other goes on. Blocks of documents are folded in parallel, one fractional document remains per block, and blocks of
those are folded again, up a tree, until one remains per source. That one is cut at the word, so a source's words equal its target up to
rounding. Nothing is random but a hash of the seed and the ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import renamed, stable, text_of
from routelab.scale import join_null_safe, ordered_rank, ordered_running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN_IN = 64
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-12
_UNIT = "struct<h:bigint,doc_id:bigint,k:bigint,size:bigint,x:double>"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target from rows (source, size).

    Sources in code point order, null last, take the weights in turn. Together they get ``share`` of all words by weight; a target stops at
    ``most`` times its source, and the excess is shared again by weight. That ends where each target is the smaller of its limit and one
    common level times its weight; the level follows from running sums over the sources by limit / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).withColumn("_last", F.col("source").isNull())
    ranked = ordered_rank(per, [], ["_last", "source"], "_rn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rn") - 1).cast("int") % len(weights) + 1)
    ranked = ranked.withColumn("_w", w).withColumn("_limit", most * F.col("source_size"))
    ranked = ranked.withColumn("_ratio", F.col("_limit") / F.col("_w"))
    run = ordered_running(ranked, [], ["_ratio", "_rn"], {"_cl": ("sum", "_limit"), "_cw": ("sum", "_w")})
    total, all_w = run.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    words = share * total
    left_w = F.lit(float(all_w)) - F.col("_cw") + F.col("_w")
    run = run.withColumn("_full", F.col("_limit") * left_w <= F.col("_w") * (F.lit(words) - F.col("_cl") + F.col("_limit")))
    full, full_w = run.where("_full").agg(F.coalesce(F.sum("_limit"), F.lit(0.0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    level = (words - full) / (all_w - full_w) if all_w > full_w else 0.0
    return run.select("source", "source_size", "n_docs", F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("_w") * level).alias("target"))


def _uniform(seed: int, level: int, a: Column, b: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), a, b), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _fold(units: Column, seed: int, level: int) -> Column:
    """A block's documents one after the other: struct(rest, done); ``done`` are settled (x is 0 or 1), ``rest`` may be fractional."""

    def unit(u: Column, x: Column) -> Column:
        return F.struct(u["h"].alias("h"), u["doc_id"].alias("doc_id"), u["k"].alias("k"), u["size"].alias("size"), x.alias("x"))

    def whole(x: Column) -> Column:
        return F.when(x < _EPS, 0.0).when(x > 1 - _EPS, 1.0).otherwise(x)

    def step(acc: Column, u: Column) -> Column:
        r = acc["rest"]
        a, b, x, y = r["size"], u["size"], r["x"], u["x"]
        mass = a * x + b * y
        high, low = F.least(F.lit(1.0), mass / a), F.greatest(F.lit(0.0), (mass - b) / a)
        up = _uniform(seed, level, r["h"], u["h"]) * (high - low) < x - low
        new_x = whole(F.when(up, high).otherwise(low))
        new_y = whole((mass - a * F.when(up, high).otherwise(low)) / b)
        fixed = (x <= 0) | (x >= 1)
        # the rest is settled already, or the trade settles it: the new one goes on; otherwise the new one is settled
        swap = fixed | (new_x <= 0) | (new_x >= 1)
        out_r = unit(r, F.when(fixed, x).otherwise(new_x))
        out_u = unit(u, F.when(fixed, y).otherwise(new_y))
        return F.struct(F.when(swap, out_u).otherwise(out_r).alias("rest"), F.concat(acc["done"], F.array(F.when(swap, out_r).otherwise(out_u))).alias("done"))

    start = F.struct(F.element_at(units, 1).alias("rest"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    return F.aggregate(F.slice(units, 2, 1 << 30), start, step)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, fan_in: int = FAN_IN,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, k (hash of id, source and text), size, source_size, target, taken.

    ``size`` is the number of words (runs of other than ASCII white space), 0 for null. ``taken`` is a multiple of ``size``, but for one
    document of each source, which is cut at the word. A document without words is taken 0 times; a source without words has target 0.
    Null ids, null sources and repeated rows are documents like others. Blocks hold ``fan_in`` documents on average at the leaves and at
    most ``fan_in`` above, whatever the source's size. A very long text counts with all its words; an empty table gives an empty result; other columns are
    ignored.
    """
    slim = stable(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"),
                              F.xxhash64(F.col(id_col), F.col(source_col), text_of(text_col)).alias("k")))
    targets = stable(source_targets(slim, weights, share, most))
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = join_null_safe(slim, targets, ["source"]).withColumn("_whole", F.floor(per + _EPS)).withColumn("_x", F.greatest(per - F.col("_whole"), F.lit(0.0)))
    open_ = (F.col("_x") > _EPS) & (F.col("size") > 0)
    settled = rows.where(~open_).select("doc_id", "k", "source", "size", F.lit(0.0).alias("x"))
    n_blocks = F.ceil(F.col("n_docs") / fan_in)
    leaf = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "k")
    level_rows = rows.where(open_).select("source", F.pmod(leaf, n_blocks).alias("block"), F.struct(leaf.alias("h"), "doc_id", "k", "size", F.col("_x").alias("x")).alias("u"))
    blocks, level = -(-most_docs // fan_in), 0
    while True:
        folded = (level_rows.groupBy("source", "block").agg(F.sort_array(F.collect_list("u")).alias("us"))
                  .select("source", "block", _fold(F.col("us"), seed, level).alias("f")))
        folded = stable(folded.select("source", "block", "f.rest", "f.done"))
        settled = settled.unionByName(folded.select("source", F.explode("done").alias("u")).select("u.doc_id", "u.k", "source", "u.size", "u.x"))
        if blocks <= 1:
            break
        level_rows = folded.select("source", F.floor(F.col("block") / fan_in).cast("long").alias("block"), F.col("rest").alias("u"))
        blocks, level = -(-blocks // fan_in), level + 1
    settled = settled.unionByName(folded.select(F.col("rest.doc_id").alias("doc_id"), F.col("rest.k").alias("k"), "source", F.col("rest.size").alias("size"), F.col("rest.x").alias("x")))
    out = join_null_safe(settled, targets, ["source"])
    taken = F.floor(per + _EPS) * F.col("size") + F.round(F.col("x") * F.col("size"))
    return out.select("doc_id", "k", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus, columns of ``docs``: a row for every whole copy and one for the part of a cut document (its first words, one space between)."""
    rows, (i, t, s) = renamed(docs, id_col, text_col, source_col)
    marks = stable(mix(rows, i, t, s, **options).groupBy(F.col("doc_id").alias("_id"), F.col("k").alias("_k"))
                   .agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"), F.count("*").alias("_rows")).where("_taken > 0"))
    keyed = rows.withColumn("_key", F.xxhash64(F.col(i), F.col(s), text_of(t)))
    all_hits = keyed.join(marks, keyed[i].cast("long").eqNullSafe(marks["_id"]) & (keyed["_key"] == marks["_k"]))
    hits = all_hits.where("_rows = 1")
    if not marks.where("_rows > 1").isEmpty():  # repeated rows: one of them stands for what all take
        hits = hits.unionByName(all_hits.where("_rows > 1").dropDuplicates(["_id", "_k"]))
    full, part = F.floor(F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    copy = hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), full + F.when(part > 0, 1).otherwise(0))))
    words = F.regexp_extract_all(F.col(t), F.lit(WORD), 0)
    cut = F.when(F.col("_copy") <= full, F.col(t)).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(part, F.lit(1))), " "))
    return copy.withColumn("_text", cut).select(*["_text" if c == t else c for c in rows.columns]).toDF(*docs.columns)
