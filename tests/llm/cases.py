"""Small tables that every operator of the subpackage must survive, and helpers."""

from __future__ import annotations

import random

WORDS = "the of and to in is that it was for on as with his they at be this from have or by one had not but what all were when we there can an your which their".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, source): nulls anywhere, empty, one character, white space, a very long text, ties and repeated rows, other scripts."""
    long = prose(1, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "x", None), (5, prose(2, 120), "b"), (6, prose(2, 120), "b"), (7, prose(2, 120).replace(" ", "  "), "c"),
            (7, prose(2, 120).replace(" ", "  "), "c"), (8, long, "a"), (9, long + " end", "a"), (10, "日本語 ﬁ 🙂 ▁ é", "é"), (None, prose(3, 40), "b"), (None, None, None),
            (11, "a" * 1500, "b"), (12, "word " * 300, "c"), (13, prose(4, 90), "d"), (14, prose(4, 90), "d")]


def documents(spark, rows=None):
    """A documents table whose extra columns clash with names that operators use inside."""
    data = [(*r, "h", "norm", 1, "role") for r in (edge_rows() if rows is None else rows)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, h string, norm string, cid int, _keep string")


def labels(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, quality int, toxic int, y string")
