"""Repeated passages: depth-limited radix sort of suffixes, most significant digit first.

A window is the first ``length`` bytes of a suffix; equal windows are what a suffix array would put next to each other. Suffixes are only
ordered through that depth, digit by digit, and a group of one drops out after each pass; the groups left at the end are exactly the
repeated windows. Digits are hashes of parts of the window, the most telling one first, and runs of consecutive suffixes that share a
digit travel as one row:

1. the window's anchor: its ``GRAM``-byte gram of least hash (leftmost of equals), with the place in the window. Equal windows have equal
   anchors at the same place, and about 150 consecutive windows share one, so a pass over runs stands for all suffixes.
2. the core: the bytes that all windows of a block of ``BLOCK`` consecutive offsets to the anchor have in common.
3. the window itself.

A run whose whole reach occurs twice is repeated throughout and settled without its windows, which covers copies and the inside of
passages; the next pass then needs one representative of it. Only blocks at the edge of a passage come to single windows. All passes are
counts by key, combined before the shuffle; nothing is paired. Keys have 128 bits from two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelab.llm import textbytes as tb
from routelab.llm.common import read_text_column, stable, written

LENGTH = 400
GRAM = 100
BLOCK = 32
_PLACE = np.uint64((1 << 30) - 1)
_NULL_ID = -(1 << 63)
_C = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks forwards and backwards."""
    n = len(x)
    rows = -(-n // width)
    pad = np.full(rows * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    pad[:n] = x
    pad = pad.reshape(rows, width)
    forward = np.minimum.accumulate(pad, axis=1).ravel()
    backward = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1:n])


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: text number, first start, last start, anchor (in the text), gram hash, reach hash."""
    buf, starts = tb.joined(texts)
    sizes = np.diff(starts) - 1
    long = np.flatnonzero(sizes >= length)
    empty = np.zeros(0, dtype=np.int64)
    if not len(long):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = tb.Sums(buf, tb.byte_values())
    n = len(buf)
    h = tb.mix64((sums.sums[gram:] - sums.sums[:-gram]) * sums.inverse[: n - gram + 1])
    least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[starts[long]] = 1
    edge[starts[long] + sizes[long] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    anchor = (least[at] & _PLACE).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(anchor) != 0))
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    anchor = anchor[np.concatenate([[0], cut + 1])]
    doc = np.searchsorted(starts, first, side="right") - 1
    other = tb.Sums(buf, tb.byte_values(1), 1)
    reach = tb.mix64(other.of(first, last + length) + (anchor - first).astype(np.uint64) * _C[0] + (last - first).astype(np.uint64) * _C[1])
    return doc, first - starts[doc], last - starts[doc], anchor - starts[doc], h[anchor], reach


def block_rows(texts: list[bytes], runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int, block: int) -> dict[str, np.ndarray]:
    """Blocks of the given runs (first, last, anchor, gram hash of each text): text, run, starts from ``lo`` to ``hi``, core and whole keys, window keys."""
    buf, starts = tb.joined(texts)
    a, b = tb.Sums(buf, tb.byte_values()), tb.Sums(buf, tb.byte_values(1), 1)
    per = np.array([len(r[0]) for r in runs])
    doc = np.repeat(np.arange(len(texts)), per)
    first, last, anchor, gram = (np.concatenate([r[i] for r in runs]) for i in range(4))
    first, last, anchor = first + starts[doc], last + starts[doc], anchor + starts[doc]
    low, high = (anchor - last) // block, (anchor - first) // block
    count = high - low + 1
    run = np.repeat(np.arange(len(first)), count)
    number = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    near, far = np.maximum(number * block, (anchor - last)[run]), np.minimum(number * block + block - 1, (anchor - first)[run])
    mid = anchor[run]
    core_at = mid - number * block
    core = tb.mix64(a.of(core_at, core_at + length - block + 1) * _C[0] + gram[run] * _C[1] + number.astype(np.uint64) * _C[2])
    whole = tb.mix64(b.of(mid - far, mid - near + length) + near.astype(np.uint64) * _C[0] + far.astype(np.uint64) * _C[1])
    width = far - near + 1
    offset = near.repeat(width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    start = mid.repeat(width) - offset
    windows = tb.mix64(b.of(start, start + length) + offset.astype(np.uint64) * _C[0])
    # windows of a block by offset from near to far, so starts fall
    return {"doc": doc[run], "lo": mid - far - starts[doc[run]], "hi": mid - near - starts[doc[run]], "core": core, "whole": whole, "windows": windows, "width": width}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def repeated_runs(docs: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """doc_id, tie, start, end: runs of window starts (both ends included) of repeated windows, in rows of ``docs`` (doc_id, tie, text)."""

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.batches(it, 2):
            doc, first, last, anchor, g, reach = anchor_runs(texts, length, gram)
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _signed(g), _signed(reach), _signed(first), pa.array((last - first).astype(np.int32)),
                                              pa.array((anchor - first).astype(np.int32))], ["doc_id", "tie", "g", "reach", "first", "more", "off"])

    # pass 1: anchors
    all_runs = written(docs.mapInArrow(runs, "doc_id bigint, tie int, g bigint, reach bigint, first bigint, more int, off int"), "runs")
    twice = written(all_runs.groupBy("g").count().where("count > 1").select("g"), "anchors")
    left = written(all_runs.join(twice, "g"), "left")
    reaches = written(left.groupBy("g", "reach").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "first", "more", "off")).alias("one")), "reaches")
    settled = left.join(reaches.where("n > 1").select("g", "reach"), ["g", "reach"]).select("doc_id", "tie", F.col("first").alias("start"), (F.col("first") + F.col("more")).alias("end"))

    # pass 2: blocks of one representative of each reach, where an anchor has several
    several = written(reaches.groupBy("g").count().where("count > 1").select("g"), "several")
    ones = (reaches.join(several, "g").groupBy(F.col("one.doc_id").alias("_id"), F.col("one.tie").alias("_tie"))
            .agg(F.collect_list(F.struct(F.col("one.first").alias("first"), F.col("one.more").alias("more"), F.col("one.off").alias("off"), "g", F.col("n").alias("n"))).alias("runs")))

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.batches(it, 2):
            lists = batch.column(3)
            off, flat = lists.offsets.to_numpy(), lists.values
            first, more, anchor, g, n = (flat.field(i).to_numpy() for i in range(5))
            first, more, anchor = first.astype(np.int64), more.astype(np.int64), anchor.astype(np.int64)
            cut = [slice(off[i], off[i + 1]) for i in range(len(texts))]
            r = block_rows(texts, [(first[c], first[c] + more[c], first[c] + anchor[c], g[c].view(np.uint64)) for c in cut], length, block)
            at = pa.array(r["doc"])
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(r["width"])]).astype(np.int32)), _signed(r["windows"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _signed(r["lo"]), _signed(r["hi"]), _signed(r["core"]), _signed(r["whole"]), keys],
                                             ["doc_id", "tie", "lo", "hi", "core", "whole", "windows"])

    texts = docs.join(ones, (docs["doc_id"] == ones["_id"]) & (docs["tie"] == ones["_tie"])).select("doc_id", "tie", "text", "runs")
    all_blocks = written(texts.mapInArrow(blocks, "doc_id bigint, tie int, lo bigint, hi bigint, core bigint, whole bigint, windows array<bigint>"), "blocks")
    cores = written(all_blocks.groupBy("core").count().where("count > 1").select("core"), "cores")
    kept = written(all_blocks.join(cores, "core"), "kept")
    wholes = written(kept.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tie", "lo", "hi")).alias("one")), "wholes")
    settled = settled.unionByName(kept.join(wholes.where("n > 1").select("core", "whole"), ["core", "whole"]).select("doc_id", "tie", F.col("lo").alias("start"), F.col("hi").alias("end")))

    # pass 3: windows of one representative of each whole block, where a core has several
    open_cores = written(wholes.groupBy("core").count().where("count > 1").select("core"), "open")
    chosen = wholes.join(open_cores, "core").select("core", "whole", "n", "one")
    rows = kept.join(chosen, ["core", "whole"]).where(F.struct("doc_id", "tie", "lo", "hi") == F.col("one"))
    windows = written(rows.select("core", "doc_id", "tie", "hi", "n", F.posexplode("windows").alias("k", "w")), "windows")
    equal = windows.groupBy("core", "w").count().where("count > 1").select("core", "w")
    single = windows.where("n = 1").join(written(equal, "equal"), ["core", "w"]).select("doc_id", "tie", (F.col("hi") - F.col("k")).alias("start"), (F.col("hi") - F.col("k")).alias("end"))
    return settled.unionByName(single)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of each removed run of bytes) for every document.

    A byte goes if a ``length``-byte string over it starts anywhere else too, in another document or in the same one, overlapping or not;
    strings are judged on the input. Null is the empty text; texts shorter than ``length`` lose nothing. Documents that share an id are
    told apart by their text; a repeated row is a second document with the same text, so it loses all its windows. A very long text is one
    row of its tasks. An empty table gives an empty result; other columns are ignored. Null ids stay null.
    """
    if not 0 < gram <= length - block:
        raise ValueError("gram and block must leave room in length")
    rows = read_text_column(docs, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).withColumn("tie", F.hash("text"))
    rows = rows.select("doc_id", "tie", "text")
    found = repeated_runs(rows, length, gram, block)
    # start in the high bits, run length in the low ones
    packed = found.groupBy("doc_id", "tie").agg(F.collect_set(F.shiftleft("start", 12) + F.col("end") - F.col("start")).alias("runs"))
    packed = stable(packed.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "runs"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tb.batches(it):
            out = []
            for i, text, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                spans = []
                if runs.is_valid:
                    x = np.sort(runs.values.to_numpy())
                    start = x >> 12
                    end = np.maximum.accumulate(start + (x & 4095) + length)
                    new = np.concatenate([[True], start[1:] > end[:-1]])
                    spans = list(zip(start[new].tolist(), end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(x) - 1]])].tolist()))
                at, parts = 0, []
                for a, b in spans:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept = b"".join(parts)
                out.append((None if i == _NULL_ID else i, len(text), len(text) - len(kept), len(spans), sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    whole = rows.join(packed, (rows["doc_id"] == packed["_id"]) & (rows["tie"] == packed["_tie"]), "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>")
