"""WARC archives with a two-level capture index.

Archives: every page is a WARC record, a gzip member of its own, in the file of the task that writes
it. Of equal payloads one is a response and the others revisits of it.

Index: captures are sorted by key (the URL with its host reversed) across range partitions. Each
partition writes a shard: compressed blocks of sorted capture lines, then a sparse directory with the
first key, place and length of each block, then the directory's place. The driver keeps the key range
of each shard only, of which there are as many as partitions.

Lookup: a key is sent to the shards whose range holds it. There its blocks are found by binary search
in the directory and fetched by range reads. Records are then read from the archives by range.

A task that is repeated writes a file of its own, and the stored list of captures names only files of
tasks that ended, so lost executors leave unused files at most.

Defined cases: a null html is an empty payload; a null or malformed URL has the URL itself (or the
empty text) as key; a null ``page_id`` counts as smaller than any other and stays null; rows that
repeat an id are records of their own, and those with the largest id of equal payloads are all
responses; payloads of any length are whole; an empty table gives empty archives; further columns
are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm import text as T
from dugout.llm.store import kept, prepare
from dugout.session import scratch_path

REVISIT_FROM = 1000  # bytes of a payload
BLOCK = 256  # captures in a block of the index
ROLL = 1 << 30  # bytes after which a task starts another file
DATE = "1970-01-01T00:00:00Z"  # of the records; pages have no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "<qq4s"  # offset and length of a shard's directory, mark
MARK = b"CIX1"

CAPTURE = """key string, page_id bigint, url string, file string, offset bigint, length bigint, record_type string,
    digest string"""
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def filesystem(uri: str):
    """The file system of a folder and the folder's path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def key_of(url: Column) -> Column:
    """host reversed by labels, then the rest: ``http://www.a.org/b`` is ``org,a,www)/b``."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?(.*)$"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    whole = F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2))
    return F.coalesce(F.when(url.rlike(parts), whole).otherwise(url), F.lit(""))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool, date: str = DATE) -> bytes:
    """One WARC record, not yet compressed."""
    head = [f"HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    block = "\r\n".join([*head, "", ""]).encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a WARC record (names in lower case) and its payload after the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def resolved(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit) for every row."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("html"),
                        F.sha1(F.encode(body, "UTF-8")).alias("digest"))
    copies = (
        rows.filter(F.octet_length("html") >= REVISIT_FROM).groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    )
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.join(kept(copies, "warc-copies"), "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


class _Rolling:
    """Files of one task, the next begun when one is full."""

    def __init__(self, folder: str, kind: str):
        self.fs, self.path = filesystem(folder)
        self.fs.create_dir(self.path, recursive=True)
        context = TaskContext.get()
        self.name = f"{kind}-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.number, self.out = 0, None

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at > ROLL:
            self.close()
            self.file, self.at = f"{self.name}-{self.number:04d}", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.file}", compression=None)
            self.number += 1
        place = self.file, self.at
        self.out.write(data)
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """The records of ``resolved`` rows as WARC files in ``folder``; the captures, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Rolling(folder, "warc")
        names = ["key", "page_id", "url", "html", "digest", "refers_to", "revisit"]
        for batch in T.slices(batches, "html"):
            out = []
            for key, page, url, html, digest, to, revisit in zip(*(batch.column(c).to_pylist() for c in names)):
                data = gzip.compress(record(page, url, html.encode(), digest, to, revisit), 6, mtime=0)
                file, at = files.add(data)
                out.append((key, page, url, file, at, len(data), "revisit" if revisit else "response", digest))
            yield _captures(out)
        files.close()

    keyed = rows.select(key_of(F.col("url")).alias("key"), "*")
    return kept(keyed.mapInArrow(run, CAPTURE), "warc-captures")


_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in CAPTURE.split(",")]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


@dataclass(frozen=True)
class Index:
    """Folder of archives and shards; per shard its file, first and last key."""

    folder: str
    shards: tuple[tuple[str, str, str], ...]


def write_index(captures: DataFrame, folder: str) -> Index:
    """Sorted shards of compressed blocks in ``folder``, each with its sparse directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, lines, directory, last = _Rolling(folder, "index"), [], [], ""

        def flush() -> None:
            data = gzip.compress("\n".join(json.dumps(r) for r in lines).encode(), 6, mtime=0)
            directory.append((lines[0][0], files.add(data)[1], len(data)))
            lines.clear()

        files_at = None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                lines.append(r)
                last = r[0]
                if len(lines) == BLOCK:
                    flush()
        if lines:
            flush()
        if directory:
            body = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
            files_at, at = files.add(body)
            files.add(struct.pack(END, at, len(body), MARK))
        files.close()
        shard = [(files_at, directory[0][0], last)] if directory else []
        columns = list(zip(*shard)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", "first", "last"])

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions(
        "key", "page_id", "file", "offset")
    shards = kept(ordered.mapInArrow(run, "file string, first string, last string"), "warc-shards")
    return Index(folder, tuple(sorted((tuple(r) for r in shards.collect()), key=lambda s: (s[1], s[2]))))


class _Shard:
    """A shard's directory, read from the end of its file, and its blocks on demand."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        at, length, mark = struct.unpack(END, self.file.read_at(struct.calcsize(END), self.file.size() - struct.calcsize(END)))
        if mark != MARK:
            raise ValueError(f"{path} is no index shard")
        self.directory = json.loads(gzip.decompress(self.file.read_at(length, at)))
        self.first = [d[0] for d in self.directory]
        self.loaded: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list:
        if self.loaded[0] != i:
            _, at, length = self.directory[i]
            lines = gzip.decompress(self.file.read_at(length, at)).decode().split("\n")
            self.loaded = i, [json.loads(x) for x in lines]
        return self.loaded[1]

    def find(self, key: str) -> Iterator[list]:
        i = max(0, bisect.bisect_left(self.first, key) - 1)  # the key may begin before a block of its own
        while i < len(self.first) and self.first[i] <= key:
            rows = self.block(i)
            for r in rows[bisect.bisect_left(rows, key, key=lambda r: r[0]) :]:
                if r[0] != key:
                    return
                yield r
            i += 1


def lookup(index: Index, urls: DataFrame, url: str = "url", spread: int = 16) -> DataFrame:
    """The captures of each distinct URL of ``urls``. ``spread``: tasks per shard at most."""
    first, last = [s[1] for s in index.shards], [s[2] for s in index.shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                i = bisect.bisect_left(last, key)  # the first shard that does not end before the key
                while i < len(first) and first[i] <= key:
                    out.append((i, key))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()),
                                              pa.array([o[1] for o in out], pa.string())], ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(index.folder)
        number, shard, out = None, None, []
        for batch in batches:
            for i, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist()):
                if i != number:
                    number, shard = i, _Shard(fs, f"{path}/{index.shards[i][0]}")
                for r in shard.find(key):
                    out.append(r)
                    if len(out) == 4096:
                        yield _captures(out)
                        out = []
        yield _captures(out)

    keys = urls.select(key_of(F.col(url)).alias("key")).distinct()
    routed = keys.mapInArrow(route, "shard int, key string")
    salt = F.pmod(F.xxhash64("key"), F.lit(spread))
    return routed.repartition("shard", salt).sortWithinPartitions("shard", "key").mapInArrow(search, CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records that ``captures`` point to, by range reads. Revisits have no payload of their own;
    their bytes are null here."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for page, f, at, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "file", "offset", "length"))):
                if f != name:
                    name, file = f, fs.open_input_file(f"{path}/{f}")
                headers, payload = parsed(gzip.decompress(file.read_at(length, at)))
                kind = headers["warc-type"]
                stated = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                to = None
                if kind == "revisit":
                    to, size = int(headers["warc-refers-to"].removeprefix("<urn:page:").rstrip(">")), None
                else:
                    size = len(payload)
                    if (own := hashlib.sha1(payload).hexdigest()) != stated:
                        raise ValueError(f"payload of page {page} in {f} has digest {own}, its record says {stated}")
                out.append((page, size, stated, kind, to))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = captures.select("page_id", "file", "offset", "length").repartitionByRange("file", "offset")
    return ordered.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def with_referred(records: DataFrame) -> DataFrame:
    """``read_records`` with the payload size of revisits from the response they refer to."""
    stored = kept(records, "warc-records")
    referred = kept(
        stored.filter("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_n"))
        .select(F.col("page_id").alias("refers_to"), "payload_digest", "_n"), "warc-responses")
    return stored.join(referred, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
             html: str = "html") -> DataFrame:
    """Write ``pages`` as archives with an index, look every URL up and read its records back."""
    spark = prepare(pages.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    captures = write_archives(resolved(pages, page_id, url, html), folder)
    index = write_index(captures, folder)
    return with_referred(read_records(lookup(index, pages, url), folder))
