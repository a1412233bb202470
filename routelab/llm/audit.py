"""How filters interact: survivors of every subset of filters by truth-table words and carry-save counts.

A document fails some of n filters (n up to 5). Bit S of its survival word, one of 2 ** n, says that it passes all filters of the subset S.
The words of a part and label class are added bit by bit with carry-save adders: three words become a sum word and a carry word of twice the
weight, so every pass shortens the list to two thirds with five logical operations per word, and at most two words per weight are counted bit by
bit at the end. A task gives one row of 2 ** n counts per part; Spark adds those. Each report line (orders, steps, Shapley values) follows from
the survivors of two subsets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import stable

FILTERS = "ABCDE"
TASK_PARTS = 4096  # parts held at once by a counting task
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))
_MARKS = re.compile(rb"[#$%&*|]")
REPORT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def text_fails(text: bytes) -> int:
    """Bits 0 to 3: fails A (under 100 words), B (under 80 % distinct words), C (over 10 % capitals), D (a mark)."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (_MARKS.search(text) is not None) << 3


def survival_words(n: int = len(FILTERS)) -> np.ndarray:
    """The word of each set of failed filters: bit S is set if no filter of S failed."""
    return np.array([sum(1 << s for s in range(1 << n) if not s & fails) for fails in range(1 << n)], dtype=np.uint32)


def positional_popcount(words: np.ndarray, bits: int = 32) -> np.ndarray:
    """How many words have each bit set."""
    counts, weight = np.zeros(bits, dtype=np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            k = len(words) // 3
            a, b, c = words[:k], words[k:2 * k], words[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * k:]])
        counts += weight * ((words[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, fails (bit i: filter i) for every row: filters A to D of the text, E for a text that a smaller id has too.

    Null text is empty, a null part is the empty string; a null id is larger than all others; rows with one id are no copies of each other. Texts
    are equal by a 128-bit hash. A very long text is read whole. A hot text is counted before the shuffle and Spark may split its join.
    """
    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fails, hashes = [], []
            for t in b.column(2).cast(pa.binary()):
                data = t.as_py() or b""
                fails.append(text_fails(data))
                hashes.append(hashlib.blake2b(data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fails, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "part", "fails", "h"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    slim = stable(rows.mapInArrow(read, f"doc_id {kind}, part string, fails int, h binary"))
    copied = stable(slim.groupBy("h").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")).where("rows > 1").select("h", "first", F.lit(True).alias("copied")))
    later = F.col("copied").isNotNull() & F.coalesce(F.col("doc_id") > F.col("first"), F.col("first").isNotNull())
    return slim.join(copied, "h", "left").select("doc_id", "part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("fails"))


def subset_survivors(fails: DataFrame, labels: DataFrame, n: int = len(FILTERS), id_col: str = "doc_id") -> DataFrame:
    """part, survivors, good, toxic: arrays with the number of documents that pass each subset of the filters, of all, with quality 1 and with toxic 1.

    ``fails`` has doc_id, part and fails. Labels of one id agree or count as set if any of them is; null ids have no label.
    """
    words = survival_words(n)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    marked = fails.join(known, "doc_id", "left").select("part", (F.col("fails") + 32 * F.coalesce("good", F.lit(0)) + 64 * F.coalesce("toxic", F.lit(0))).alias("code"))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in it:
            parts = b.column(0).dictionary_encode()
            at, code = parts.indices.to_numpy(), b.column(1).to_numpy()
            order = np.argsort(at, kind="stable")
            cut = np.searchsorted(at[order], np.arange(len(parts.dictionary) + 1))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                mine = code[order[cut[i]:cut[i + 1]]]
                word = words[mine & 31]
                found = np.stack([positional_popcount(w, 1 << n) for w in (word, word[mine & 32 > 0], word[mine & 64 > 0])])
                held[part] = held[part] + found if part in held else found
            if len(held) > TASK_PARTS:
                yield _counts(held)
                held = {}
        if held:
            yield _counts(held)

    def _counts(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), *(pa.array([x[k].tolist() for x in held.values()], pa.list_(pa.int64())) for k in range(3))], ["part", "survivors", "good", "toxic"])

    per_task = marked.mapInArrow(count, "part string, survivors array<bigint>, good array<bigint>, toxic array<bigint>")
    added = [F.array(*[F.sum(F.col(c)[s]) for s in range(1 << n)]).alias(c) for c in ("survivors", "good", "toxic")]
    return per_task.groupBy("part").agg(*added)


def report_rows(part: str, survivors: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> Iterator[tuple]:
    """The lines of one part for every order of the filters."""
    n, full = len(filters), (1 << len(filters)) - 1
    lost = {(s, f): int(survivors[s] - survivors[s | 1 << f]) for f in range(n) for s in range(full + 1) if not s >> f & 1}
    # a set of k filters stands before f in k! (n - 1 - k)! orders
    shapley = [sum(math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) * v for (s, g), v in lost.items() if g == f) for f in range(n)]
    for order in itertools.permutations(range(n)):
        before, name = 0, "".join(filters[f] for f in order)
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            yield (part, name, step, int(survivors[after]), lost[before, f], lost[0, f] - lost[before, f], lost[full ^ 1 << f, f],
                   int(good[before] - good[after]), int(toxic[before] - toxic[after]), shapley[f])
            before = after


def audit(fails: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of filters whose failures are known: a row per part, order and step, zeros included.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier), ``unique_fails`` (fail only its filter),
    ``good_lost`` and ``toxic_lost`` (removed here, label 1), ``shapley`` (removed by its filter, summed over all orders). No rows, no parts.
    """
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    names = [f.split()[0] for f in REPORT.split(", ")]

    def spell(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, *sets in zip(*(c.to_pylist() for c in b.columns)):
                rows = list(report_rows(part, *(np.array(s, dtype=np.int64) for s in sets), filters))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return subset_survivors(fails, labels, len(filters)).mapInArrow(spell, REPORT)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The report of the five text filters over a table of documents.

    Null text is empty and fails A only (and E after a first empty one); a null part is the empty string; rows with repeated ids each count; an empty table
    gives no rows; other columns of either table are ignored.
    """
    return audit(failed_filters(docs, id_col, text_col, part_col), labels.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else labels)
