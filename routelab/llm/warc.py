"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by (page id, payload hash). The ranges (shards) end at fixed multiples of the running payload bytes, so they
depend on the rows alone, not on a sample or on the cluster. A task streams the records of a shard into gzip members and starts
a new file when the next member would take the file over ``file_bytes`` compressed. Headers, digests and record ids are made anew from
the rows, so a rerun or a retried task writes the same bytes. A file is written under a temporary name and moved to its fixed name; the
manifest (one row per file, with its SHA-256) is published last by Spark's committer. Readers go by the manifest, so a half-written
archive cannot be read and files of lost attempts are never seen.

Files are opened with ``pyarrow.fs``: local and mounted folders, S3, GCS and HDFS. The folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelab.llm.common import stable
from routelab.scale import ordered_running

SHARD_BYTES = 32 << 20
MAX_SHARDS = 20_000
FILE_BYTES = 64 << 20
OVERHEAD = 512  # about the bytes of a record's headers; only the places of the cuts depend on it
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, number int, records bigint, first_page bigint, last_page bigint, bytes bigint, sha256 string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def payload_key(payload: Column) -> Column:
    """SHA-1 (the digest of the headers) followed by MD5: equal keys stand for equal payloads."""
    return F.concat(F.unhex(F.sha1(payload)), F.unhex(F.md5(payload)))


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page: int | None, key: bytes, nth: int) -> str:
    """The same row gives the same id; ``nth`` tells repeats of a row apart."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}|{key.hex()}|{nth}'.encode()).digest())}>"


def _uri(url: str | None, page: int | None) -> str:
    # a header is one line: blanks and control characters are percent-encoded
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:x-page:{page}"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_member(page: int | None, url: str | None, key: bytes, payload: bytes, nth: int, keeper: tuple[int | None, str | None] | None, date: str) -> bytes:
    """A response, or a revisit of the page ``keeper`` with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if keeper is None else http
    fields = [("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", record_id(page, key, nth)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page)),
              ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest32(key[:20])}"), ("WARC-Block-Digest", f"sha1:{digest32(hashlib.sha1(block).digest())}")]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if keeper is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keeper[0], key, 0)), ("WARC-Refers-To-Target-URI", _uri(keeper[1], keeper[0])), ("WARC-Refers-To-Date", date)]
        if keeper[0] is not None:
            fields.append(("X-Refers-To-Page-Id", str(keeper[0])))
    return _member(fields, block)


class _Roll:
    """The files of one shard."""

    def __init__(self, where: str, shard: int, most: int, date: str):
        self.fs, self.root = pafs.FileSystem.from_uri(where)
        self.shard, self.most, self.date, self.number = shard, most, date, 0
        self.temporary = f"{self.root}/_temporary/{shard:08d}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.temporary, recursive=True)
        self.out = None

    def _open(self, page: int | None) -> None:
        self.name = f"shard-{self.shard:08d}-{self.number:05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.temporary}/{self.number:05d}", compression=None)
        self.sha, self.size, self.records, self.first, self.last = hashlib.sha256(), 0, 0, page, page
        self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name.encode(), 0)), ("WARC-Date", self.date), ("WARC-Filename", self.name),
                           ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def add(self, member: bytes, page: int | None) -> Iterator[tuple]:
        if self.out is not None and self.records and self.size + len(member) > self.most:
            yield self.close()
        if self.out is None:
            self._open(page)
        self._put(member)
        self.records, self.last = self.records + 1, page

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.fs.move(f"{self.temporary}/{self.number:05d}", f"{self.root}/{self.name}")
        self.number += 1
        return self.name, self.shard, self.number - 1, self.records, self.first, self.last, self.size, self.sha.hexdigest()


def _place(page: int | None, key: bytes) -> tuple:
    return page is not None, page or 0, key


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0,
                   shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, max_shards: int = MAX_SHARDS, date: str = DATE) -> DataFrame:
    """Writes one record per row below ``path`` and returns the manifest.

    Of the rows with equal payloads of at least ``min_revisit`` bytes the one with the largest id is the response and the others are revisits
    of it; smaller payloads are all responses. A null html is an empty payload. A null id sorts first, loses against every
    other id and leaves its header out; a null or empty url becomes ``urn:x-page:<id>``. Of rows that repeat both id and payload one is the response
    (the largest url) and the rest revisit it. A very long payload is one record, larger than a file if need be; repeats of one row share a shard.
    An empty table gives an empty manifest; other columns are ignored. The shards number at most ``max_shards`` (larger ranges beyond that).
    A folder that already has a manifest is refused.
    """
    spark = pages.sparkSession
    where, root = pafs.FileSystem.from_uri(path)
    if where.get_file_info(f"{root}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("k", payload_key(F.col("payload")))
    slim = stable(rows.select("page_id", "url", "k", F.octet_length("payload").cast("bigint").alias("n")))
    groups = stable(slim.where(F.col("n") >= min_revisit).groupBy("k").agg(F.count("*").alias("rows"), F.max(F.struct("page_id", "url")).alias("keeper")).where("rows > 1"))
    chosen = slim.select("page_id", "k").join(groups.select("k", "keeper"), "k").distinct()

    total = slim.agg(F.sum(F.col("n") + OVERHEAD)).first()[0] or 0
    step = max(shard_bytes, -(-total // max_shards), 1)
    swept = ordered_running(slim.select("page_id", "k", (F.col("n") + OVERHEAD).alias("w")), [], ["page_id", "k"], {"through": ("sum", "w")})
    # one row per shard
    heads = sorted({_place(r["h"]["page_id"], bytes(r["h"]["k"])) for r in swept.groupBy(F.floor((F.col("through") - F.col("w")) / step).alias("s")).agg(F.min(F.struct("page_id", "k")).alias("h")).collect()})

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            shard = [max(bisect.bisect_right(heads, _place(p, k)) - 1, 0) for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, run, keeper, nth, done = None, None, None, 0, []
        for b in it:
            for shard, page, key, is_page, url, payload, of in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), b.column(6).to_pylist()):
                if roll is None or roll.shard != shard:
                    done += [roll.close()] if roll is not None and roll.out is not None else []
                    roll = _Roll(path, shard, file_bytes, date)
                if run != (shard, page, key):
                    run, keeper, nth = (shard, page, key), None, 0
                if not is_page:
                    keeper = (of["page_id"], of["url"])
                    continue
                first = keeper is None or (nth == 0 and keeper[0] == page)
                done += roll.add(page_member(page, url, key, payload.as_py(), nth, None if first else keeper, date), page)
                nth += 1
        done += [roll.close()] if roll is not None and roll.out is not None else []
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * len(kinds), kinds)], names)

    # a decision sorts before the rows that it is about
    keeper_kind = groups.schema["keeper"].dataType
    events = rows.select("page_id", "k", F.lit(True).alias("is_page"), "url", "payload", F.lit(None).cast(keeper_kind).alias("keeper")).unionByName(
        chosen.select("page_id", "k", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keeper"))
    placed = events.mapInArrow(place, "shard int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema))
    ordered = placed.repartition(max(1, len(heads)), "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "k", "is_page", F.desc_nulls_last("url"))
    ordered.mapInArrow(write, MANIFEST).write.json(f"{path}/manifest")
    if where.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        where.delete_dir(f"{root}/_temporary")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed file."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


class _Checked:
    """A file that hashes what is read from it."""

    def __init__(self, f):
        self.f, self.sha = f, hashlib.sha256()

    def read(self, n: int = -1) -> bytes:
        data = self.f.read(n)
        self.sha.update(data)
        return data


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record cut short")
        yield head, block


def page_record(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for a revisit); digests are held against the bytes."""
    if head["warc-block-digest"] != f"sha1:{digest32(hashlib.sha1(block).digest())}":
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    response = head["warc-type"] == "response"
    if response and (len(payload) != size or digest != digest32(hashlib.sha1(payload).digest())):
        raise ValueError("payload digest")
    number = lambda name: int(head[name]) if name in head else None
    return number("x-page-id"), size, digest, head["warc-type"], number("x-refers-to-page-id"), head["warc-target-uri"], payload if response else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True, max_tasks: int = 10_000) -> DataFrame:
    """One row per record of the committed files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Files are dealt to tasks and streamed; a file whose SHA-256 is not the manifest's, or a record whose digest is not its bytes', raises.
    ``payloads=False`` checks the payloads but leaves them out.
    """
    manifest = read_manifest(spark, path)
    tasks = min(max_tasks, max(1, manifest.count()))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        for b in it:
            for name, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                    seen = _Checked(f)
                    rows, held = [], 0
                    for head, block in parse_records(gzip.GzipFile(fileobj=seen, mode="rb")):
                        if head["warc-type"] == "warcinfo":
                            continue
                        row = page_record(head, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(block) if payloads else 256
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if seen.sha.hexdigest() != sha:
                        raise ValueError(f"{name} is not the file of the manifest")
                if rows:
                    yield batch(rows)
    return manifest.select("file", "sha256").repartition(tasks).mapInArrow(read, RECORDS)
