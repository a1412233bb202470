"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences.

A text is cut, without losing a byte, into paragraphs (a line with its newline), sections (up to ``PARAGRAPHS`` paragraphs, or up to a
blank line) and leaves (sentences; longer ones every ``LEAF`` bytes). Node hashes cover their children's hashes, so equal roots mean equal
texts, and differing branches lead to the edit. The fingerprint is the tree as text:

    root|section:paragraph=leaf.length leaf.length,paragraph=...;section:...

with 32 hex digits for the root and 8 for other nodes. Likeness is the share of bytes in common leaves (Dice), 1 for equal roots.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm.common import read_text_column

PARAGRAPHS = 8
LEAF = 256
RANGES_PER_PARTITION = 4
_SENTENCE = re.compile(rb"(?<=[.!?] )")
Leaves = dict[str, int]


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def _leaves(paragraph: bytes) -> Iterator[bytes]:
    for s in _SENTENCE.split(paragraph):
        if len(s) <= LEAF:
            yield s
        else:
            for i in range(0, len(s), LEAF):
                yield s[i:i + LEAF]


def fingerprint(text: bytes) -> tuple[str, Leaves]:
    """The tree as text, and the bytes held by each leaf hash."""
    sections: list[list[bytes]] = [[]]
    for p in text.splitlines(keepends=True) if b"\r" not in text else re.findall(rb"[^\n]*\n|[^\n]+", text):
        sections[-1].append(p)
        if len(sections[-1]) == PARAGRAPHS or p == b"\n":
            sections.append([])
    if not sections[-1]:
        sections.pop()
    held: Leaves = {}
    tops, shown = [], []
    for section in sections:
        nodes, lines = [], []
        for p in section:
            leaves = []
            digests = []
            for leaf in _leaves(p):
                d = _digest(leaf)
                digests.append(d)
                name = d[:4].hex()
                held[name] = held.get(name, 0) + len(leaf)
                leaves.append(f"{name}.{len(leaf):x}")
            node = _digest(b"p" + b"".join(digests))
            nodes.append(node)
            lines.append(f"{node[:4].hex()}={' '.join(leaves)}")
        top = _digest(b"s" + b"".join(nodes))
        tops.append(top)
        shown.append(f"{top[:4].hex()}:{','.join(lines)}")
    return f"{_digest(b'r' + b''.join(tops)).hex()}|{';'.join(shown)}", held


def parse(printed: str) -> Leaves:
    """The bytes held by each leaf hash of a printed tree."""
    held: Leaves = {}
    for name, size in re.findall(r"([0-9a-f]{8})\.([0-9a-f]+)", printed.partition("|")[2]):
        held[name] = held.get(name, 0) + int(size, 16)
    return held


def likeness(a: tuple[str, Leaves], b: tuple[str, Leaves]) -> float:
    if a[0][:32] == b[0][:32]:
        return 1.0
    x, y = a[1], b[1]
    total = sum(x.values()) + sum(y.values())
    return 2 * sum(min(x[k], y[k]) for k in x.keys() & y.keys()) / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers at which two printed trees differ, without a look at branches whose hashes agree."""
    if a[:32] == b[:32]:
        return []
    x, y = ([s.partition(":") for s in t.partition("|")[2].split(";")] for t in (a, b))
    found = []
    for i in range(max(len(x), len(y))):
        s, t = (z[i] if i < len(z) else ("", "", "") for z in (x, y))
        if s[0] != t[0]:
            p, q = (z[2].split(",") for z in (s, t))
            found += [(i, j) for j in range(max(len(p), len(q))) if p[j:j + 1] != q[j:j + 1]]
    return found


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text is the text with its last floor(n / 4) code points replaced by the first as many (or all) of the next document by
    ascending id; after the last comes the first. Null is the empty text; null ids come first; rows with one id go by the text's hash, so
    repeats of an id spread over ranges too. One document alone is its own next. Documents are dealt to ranges of (id, hash) that begin
    with one of the documents; the first document of a range also goes to the range before, so
    every task has each next document at hand and reads its sorted rows once. A very long text is one row of its task. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the least key of each range, exactly: as many keys as there are tasks, each that of a document
    ranged = rows.select("doc_id", "tie").repartitionByRange(ranges, F.asc_nulls_first("doc_id"), "tie")
    found = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "tie")).alias("k")).collect()
    heads = sorted({_key(r["k"]["doc_id"], r["k"]["tie"]) for r in found})

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(heads)
        for b in it:
            keys = list(map(_key, b.column(0).to_pylist(), b.column(1).to_pylist()))
            own = np.array([bisect_right(heads, k) - 1 for k in keys], dtype=np.int32)
            first = np.array([k in known for k in keys], dtype=bool)
            names = ["r", "copy", "doc_id", "tie", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), bool)), *b.columns], names)
            at = pa.array(np.flatnonzero(first))
            yield pa.RecordBatch.from_arrays([pa.array((own[first] - 1) % len(heads), pa.int32()), pa.array(np.ones(len(at), bool)), *(c.take(at) for c in b.columns)], names)

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0
        for b in it:
            for r, copy, i, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or held[0] != r:
                    if copy:
                        continue
                    held = (r, i, text, fingerprint(text.encode()))
                    continue
                _, pi, pt, pf = held
                nf = fingerprint(text.encode())
                n = len(pt)
                edited = (pt[:n - n // 4] + text[:n // 4]).encode()
                ef = fingerprint(edited)
                out.append((pi, n, sha256(edited).hexdigest(), pf[0], ef[0], likeness(pf, ef), likeness(pf, nf)))
                size += len(pf[0]) + len(ef[0])
                # after the first copy the range is over
                held = None if copy else (r, i, text, nf)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    placed = rows.select("doc_id", "tie", "text").mapInArrow(place, "r int, copy boolean, doc_id bigint, tie bigint, text string")
    dealt = placed.repartition("r").sortWithinPartitions("r", "copy", F.asc_nulls_first("doc_id"), "tie")
    return dealt.mapInArrow(walk, schema)


def _key(i: int | None, tie: int) -> tuple[bool, int, int]:
    return i is not None, i or 0, tie


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
