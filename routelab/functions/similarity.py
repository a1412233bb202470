"""Vector math, set and sequence similarity, idea-text penalties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelab.functions.text import let

L = F.lit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), L(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def cosine(a: Column, b: Column) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n == 0, L(0.0)).otherwise(dot(a, b) / n))


def softmax(a: Column) -> Column:
    def scaled(e: Column) -> Column:
        return let(F.aggregate(e, L(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))
    shifted = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(shifted, scaled)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def kendall_similarity(a: Column, b: Column) -> Column:
    """1 - inversions / pairs over two equally long sequences; 0 for different lengths, 1 for at most one element."""
    n = F.size(a)
    z = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    inv = F.aggregate(F.transform(z, lambda p, i: F.size(F.filter(F.slice(z, i + 2, F.greatest(n - i - 1, L(0))), lambda q: (
        (p["x"] < q["x"]) & (p["y"] > q["y"])) | ((p["x"] > q["x"]) & (p["y"] < q["y"]))))), L(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), L(0.0)).when(n <= 1, L(1.0)).otherwise(1.0 - inv / (n * (n - 1) / 2))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Set overlap; two empty sets give ``both_empty``."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, L(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def length_penalty(c: Column) -> Column:
    """0 for 300-700 characters, else distance/100, at most 10; empty text 0."""
    n = F.length(c)
    return F.when(F.coalesce(n, L(0)) == 0, L(0.0)).otherwise(
        F.least(L(10.0), F.greatest(n - 700, 300 - n, L(0)) / 100.0))


def completeness(m: Column, sections: Sequence[str]) -> Column:
    """Share of non-empty sections x 10."""
    filled = sum((F.when(F.coalesce(F.length(F.try_element_at(m, L(s))), L(0)) > 0, 1).otherwise(0) for s in sections), L(0))
    return filled * 10.0 / len(sections)


def repetition_penalty(vectors: Column) -> Column:
    """Mean pairwise cosine of sentence vectors above 0.2, x 10, at most 10.

    With unit vectors the sum over pairs is (|sum|^2 - n) / 2, so no pair list is built.
    """
    def penalty(unit: Column) -> Column:
        n = F.size(unit)
        total = F.aggregate(F.slice(unit, L(2), F.greatest(n - 1, L(0))), unit[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        zero = F.size(F.filter(unit, lambda v: norm(v) == 0))
        mean = let(total, lambda t: dot(t, t)) - (n - zero)
        return F.when(n < 2, L(0.0)).otherwise(F.least(L(10.0), F.greatest(L(0.0), (mean / (n * (n - 1)) - 0.2) * 10)))
    return let(F.transform(vectors, l2_normalize), penalty)
