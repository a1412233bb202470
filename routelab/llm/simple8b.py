"""Token ids in a binary format: Simple-8b, words of 64 bits that hold as many ids as fit.

Word layout: the top 4 bits select one of the rows of ``LAYOUTS`` (count of ids, bits of each), the first id sits in the lowest bits.
Selector 15 is the escape: the next word is one id of up to 64 bits, as it is. Each document's ids are cut into blocks of up to ``BLOCK``
ids that start on a word, and the block offsets are stored, so blocks decode independently and a selector's words decode together.

Files: a table of segments (up to ``SEGMENT_IDS`` ids of consecutive documents) in ascending id order. Spark writes and commits it, so a
lost executor leaves nothing half written. A segment's ``data`` is its header and words, all little-endian:

    magic "S8B1", uint32 documents, uint32 blocks, uint32 words
    int64 document id x documents, uint32 ids x documents, uint32 blocks x documents
    uint32 first word of the block x blocks, uint32 ids of the block x blocks
    uint64 word x words
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.llm.common import stable
from routelab.scale import ordered_running

# Ids in a word and bits of each, by selector.
LAYOUTS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
BLOCK = 1024
SEGMENT_IDS = 1 << 18
END_ID = 1
_MAGIC = b"S8B1"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits of the narrowest layout that holds each id; 64 beyond the widest."""
    if len(x) and x.max() < len(_SMALL):
        return _SMALL[x]
    out = np.full(len(x), 64, dtype=np.uint8)
    for bits in sorted({b for _, b in LAYOUTS}, reverse=True):
        out[(x >> np.uint64(bits)) == 0] = bits
    return out


#: The same for ids of up to 16 bits, by id.
_SMALL = np.array([min(b for _, b in LAYOUTS if b >= i.bit_length()) for i in range(1 << 16)], dtype=np.uint8)


def encode(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of consecutive blocks with ``sizes`` ids, and how many words each takes. A word takes the longest layout that the block's coming ids fit."""
    n = len(ids)
    ids, sizes = ids.astype(np.uint64), np.asarray(sizes, dtype=np.int64)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes).astype(np.int32) - np.arange(n, dtype=np.int32)
    need = _bits(ids)
    # per layout: the ids from i on fit it where the next count - 1 ids that fit are the next ids; each layout looks at the ids of the wider one
    choice = np.full(n, ESCAPE, dtype=np.int8)
    fits = np.arange(n, dtype=np.int32)
    for s in range(len(LAYOUTS) - 1, -1, -1):
        count, bits = LAYOUTS[s]
        fits = fits[need[fits] <= bits]
        if len(fits) < count:
            continue
        first = fits[: len(fits) - count + 1]
        whole = (fits[count - 1:] - first == count - 1) & (left[first] >= count)
        choice[first[whole]] = s
    take = np.array([c for c, _ in LAYOUTS] + [1], dtype=np.int32)[choice]
    # all blocks walk side by side, a word of each at a time
    begins, ends = (ends - sizes).astype(np.int32), ends.astype(np.int32)
    walks, block = [], np.flatnonzero(sizes > 0)
    i = begins[block]
    while len(i):
        walks.append(i)
        i = i + take[i]
        going = i < ends[block]
        i, block = i[going], block[going]
    at = np.sort(np.concatenate(walks)) if walks else []
    at = np.array(at, dtype=np.int64)
    chosen = choice[at]
    escapes = np.concatenate([[0], np.cumsum(chosen == ESCAPE)])
    slot = np.arange(len(at)) + escapes[:-1]
    words = np.zeros(len(at) + int(escapes[-1]), dtype=np.uint64)
    for s in np.unique(chosen):
        hit = chosen == s
        mine = at[hit]
        word = np.full(len(mine), np.uint64(int(s)) << np.uint64(60), dtype=np.uint64)
        if s == ESCAPE:
            words[slot[hit] + 1] = ids[mine]
        else:
            count, bits = LAYOUTS[s]
            for j in range(count if bits else 0):
                word |= ids[mine + j] << np.uint64(j * bits)
        words[slot[hit]] = word
    until = np.searchsorted(at, ends)
    return words, np.diff(until + escapes[until], prepend=0)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of one block or of consecutive blocks."""
    top = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), dtype=bool)
    if (top == ESCAPE).any():
        skip = False
        for i in np.flatnonzero(top == ESCAPE).tolist():  # a raw word may look like an escape itself
            if not raw[i]:
                raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    sel = top[heads]
    counts = np.array([c for c, _ in LAYOUTS] + [1], dtype=np.int64)[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(sel):
        at, w = (ends - counts)[sel == s], words[heads[sel == s]]
        if s == ESCAPE:
            out[at] = words[heads[sel == s] + 1]
        else:
            count, bits = LAYOUTS[s]
            for j in range(count if bits else 0):
                out[at + j] = (w >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out


def pack_documents(docs: list[np.ndarray]) -> list[tuple[list[int], list[int], np.ndarray]]:
    """For each document the words and the ids of its blocks, and all its words."""
    sizes = [[min(BLOCK, len(d) - i) for i in range(0, len(d), BLOCK)] for d in docs]
    words, per = encode(np.concatenate(docs) if docs else np.zeros(0), np.array([x for s in sizes for x in s], dtype=np.int64))
    out, block, at = [], 0, 0
    for s in sizes:
        mine = per[block:block + len(s)].tolist()
        out.append((mine, s, words[at:at + sum(mine)]))
        block, at = block + len(s), at + sum(mine)
    return out


def write_segment(docs: list[tuple[int, int, list[int], list[int], bytes]]) -> bytes:
    """docs: (document id, ids, words of each block, ids of each block, words)."""
    blocks = np.array([w for d in docs for w in d[2]], dtype=np.int64)
    first = (np.cumsum(blocks) - blocks).astype("<u4")
    words = b"".join(d[4] for d in docs)
    return b"".join([_MAGIC, struct.pack("<III", len(docs), len(blocks), len(words) // 8), np.array([d[0] for d in docs], "<i8").tobytes(),
                     np.array([d[1] for d in docs], "<u4").tobytes(), np.array([len(d[2]) for d in docs], "<u4").tobytes(), first.tobytes(),
                     np.array([n for d in docs for n in d[3]], "<u4").tobytes(), words])


def read_segment(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(document id, ids) of each document of a segment; all words are decoded together."""
    if data[:4] != _MAGIC:
        raise ValueError("not a Simple-8b segment")
    n, blocks, words = struct.unpack_from("<III", data, 4)
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += x.nbytes
        return x

    ids, sizes, _ = take("<i8", n), take("<u4", n), take("<u4", n)
    take("<u4", blocks), take("<u4", blocks)
    flat = decode(take("<u8", words))
    ends = np.cumsum(sizes.astype(np.int64))
    for i, a, b in zip(ids.tolist(), (ends - sizes).tolist(), ends.tolist()):
        yield i, flat[a:b]


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by its offset."""
    n, blocks, words = struct.unpack_from("<III", data, 4)
    offsets = np.frombuffer(data, "<u4", blocks, 16 + 16 * n)
    start = 16 + 16 * n + 8 * blocks
    end = int(offsets[block + 1]) if block + 1 < blocks else words
    return decode(np.frombuffer(data, "<u8", end - int(offsets[block]), start + 8 * int(offsets[block])))


_encoders: dict[str, WordIds] = {}
CACHE_WORDS = 900_000
SLICE_BYTES = 4 << 20
# lower-case Latin letters that no normaliser changes
_PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
# a full stop or comma after a letter or digit is a token of its own
_MARKED = "[0-9a-z][.,]$"


def _before(sizes: np.ndarray) -> np.ndarray:
    """Sum of the sizes before each place; 32 bits, as a slice has far fewer ids."""
    return np.cumsum(sizes, dtype=np.int32) - sizes.astype(np.int32)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    return np.repeat(starts.astype(np.int32) - _before(sizes), sizes) + np.arange(int(sizes.sum()), dtype=np.int32)


class WordIds:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    White space separates words for this tokenizer and is dropped, so a text's ids are those of its words in turn. The words are cut at
    ASCII white space only; whatever else separates stays inside and is left to the library.
    """

    def __init__(self, path: str):
        # Spark runs a task per core; threads inside a task would only compete
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case words of Latin letters the library's normaliser and pattern change nothing, so they are left out
        self.latin = Tokenizer.from_file(path)
        self.latin.normalizer = None
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids[0] for m in ".,"}

    def _forget(self) -> None:
        # white space at the ends of a text leaves an empty word, which has no ids
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _add(self, words: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(counts) - counts).astype(np.int32)])
        self.flat, self.counts = np.concatenate([self.flat, flat.astype(np.uint32)]), np.concatenate([self.counts, counts.astype(np.int32)])

    def _learn(self, stems: pa.Array) -> None:
        """Ids by the library. Plain words go in long texts, where a word's last token carries the end mark; others go one by one."""
        plain = pc.match_substring_regex(stems, _PLAIN)
        rest = stems.filter(pc.invert(plain)).to_pylist()
        plain = stems.filter(plain).to_pylist()
        done, counts, flat = [], [], []
        texts = [plain[i:i + 500] for i in range(0, len(plain), 500)]
        for mine, got in zip(texts, self.latin.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False)):
            ids = np.array(got.ids, dtype=np.int64)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(mine):
                done += mine
                counts.append(np.diff(cuts, prepend=0))
                flat.append(ids)
            else:
                rest += mine
        if rest:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            done += rest
            counts.append(np.array([len(g) for g in got], dtype=np.int64))
            flat.append(np.array([i for g in got for i in g], dtype=np.int64))
        if done:
            self._add(done, np.concatenate(counts), np.concatenate(flat))

    def _find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def encode(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text. Words are cut at ASCII white space and numbered by Arrow, so Python sees the distinct words of the batch only."""
        raw = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # ASCII case is folded by the library anyway, but not inside added tokens such as <|endoftext|>, which it looks for in the raw text
        special = pc.match_substring(raw, "<|")
        lists = pc.ascii_split_whitespace(pc.if_else(special, raw, pc.ascii_lower(raw)))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        marked = pc.match_substring_regex(words, _MARKED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        names = stems.dictionary.to_pylist()
        place = self._find(names)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known) + len(new) > CACHE_WORDS:
                self._forget()
                place = self._find(names)
                new = np.flatnonzero(place < 0)
            self._learn(stems.dictionary.take(pa.array(new)))
            place[new] = self._find([names[i] for i in new.tolist()])
        # the ids of each distinct word: those of its stem and the mark
        place = place[stems.indices.to_numpy()]
        mark = np.where(np.asarray(marked), np.where(np.asarray(pc.ends_with(words, ".")), self.marks["."], self.marks[","]), -1)
        own = self.counts[place]
        size = own + (mark >= 0)
        first = _before(size)
        table = np.empty(int(size.sum()), dtype=np.uint32)
        table[_runs(first, own)] = self.flat[_runs(self.starts[place], own)]
        table[(first + own)[mark >= 0]] = mark[mark >= 0]
        counts = size[at]
        flat = table[_runs(first[at], counts)]
        ends = np.cumsum(counts, dtype=np.int64)
        cuts = lists.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        bounds = np.concatenate([[0], ends])[cuts].tolist()
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        return [np.concatenate([flat[a:b], tail]) for a, b in zip(bounds, bounds[1:])]


def slices(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose texts have about ``most`` bytes together, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID,
              segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text and write segment files in ascending id order under ``path``.

    Null is the empty text and has only the end id. Null ids come first, as the smallest 64-bit number; rows with one id go by the text's
    hash. Texts move once, to their range of ids; each task then encodes its rows in order and writes full segments as it goes. A very long text is
    one document of its segment, which is then larger than ``segment_ids``. An empty table writes an empty set of files; other columns are ignored.
    """

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_path)
        if encoder is None:
            encoder = _encoders[tokenizer_path] = WordIds(tokenizer_path)
        held: list[tuple] = []
        count, seq, first = 0, 0, (0, 0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array([count], pa.int64()),
                                               pa.array([write_segment(held)], pa.binary())], ["first_id", "first_tie", "seq", "n_ids", "data"])

        for batch in it:
            for b in slices(batch, 2, SLICE_BYTES):
                ids = encoder.encode(b.column(2), end_id)
                for i, tie, own, (words, sizes, raw) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ids, pack_documents(ids)):
                    if not held:
                        first = (i, tie)
                    held.append((i, len(own), words, sizes, raw.astype("<u8").tobytes()))
                    count += len(own)
                    if count >= segment_ids:
                        yield out()
                        held, count, seq = [], 0, seq + 1
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.mapInArrow(pack, "first_id bigint, first_tie bigint, seq bigint, n_ids bigint, data binary").write.mode("overwrite").option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids: the documents of the files."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data in b.column(0).to_pylist():
                docs = list(read_segment(data))
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1].astype(np.int64) for d in docs], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _null_ids(spark.read.parquet(path).select("data").mapInArrow(run, "doc_id bigint, ids array<bigint>"))


def _null_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document in the files.

    A segment's ids are decoded in its task; starts inside it come from its counts, starts of segments from a running sum of their totals. Files
    without documents give an empty result; null ids are null again; repeated ids each have their row.
    """
    keys = ["first_id", "first_tie", "seq"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, tie, seq, data in zip(*(c.to_pylist() for c in b.columns)):
                docs = list(read_segment(data))
                n = np.array([len(d[1]) for d in docs], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(docs), pa.int64()) for x in (first, tie, seq)), pa.array([d[0] for d in docs], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n),
                                                  pa.array([zlib.crc32(d[1].astype("<u4").tobytes()) for d in docs], pa.int64())], [*keys, "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    order = ordered_running(files.select(*keys, "n_ids"), [], keys, {"upto": ("sum", "n_ids")})
    before = stable(order.select(*keys, (F.col("upto") - F.col("n_ids")).alias("before")))
    rows = files.select(*keys, "data").mapInArrow(run, "first_id bigint, first_tie bigint, seq bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return _null_ids(rows.join(before, keys).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
