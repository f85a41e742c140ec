"""WARC archives as a Spark data source, for reading and writing.

Archives hold one gzip member per record, each with the `sl` extra field of the WARC standard's annex: the member's compressed
and full length. A reader can so inflate a record's first bytes, parse its headers, and leap to the next record where a
predicate or the wanted content makes the payload needless. Files without that field are read too, by inflating through.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import Folder, Settled, scratch

#: Bytes of an archive file after which a task begins the next, and of files that one read task takes on.
FILE_BYTES = TASK_BYTES = 64 << 20
#: A payload under so many bytes is always written in full.
REVISIT_BYTES = 1000
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2_000
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
WRITTEN = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_bytes long, payload_digest string, payload binary"
#: What the manifest of a write is called, with a name of its own between the two.
MANIFEST = ("_manifest-", ".json")
#: Revisits up to which what they refer to is broadcast, at under 100 bytes each; beyond that, pages are shuffled by id.
BROADCAST_REVISITS = 500_000
#: Columns whose predicates the reader takes on, and the header of each.
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "warc_date": "warc-date"}


def member(data: bytes) -> bytes:
    """One gzip member with its lengths in the `sl` extra field."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 24 + len(body) + 8
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(head: dict[str, str | None], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def encoded(row: dict) -> bytes:
    """The record of a row of WRITTEN: a response with its payload, or a revisit that has HTTP headers only."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["warc_date"], "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": digest}
    if row["record_type"] == "revisit":
        head |= {"WARC-Refers-To": row["refers_to"], "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head["Content-Type"] = "application/http;msgtype=response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    return record(head, http + (b"" if row["record_type"] == "revisit" else row["payload"] or b""))


def parse_headers(raw: bytes) -> dict[str, str]:
    """Names in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class Inflater:
    """Bytes of a gzip file, member by member, inflated only as far as asked for."""

    def __init__(self, source: pa.NativeFile, size: int):
        self.source, self.size, self.at = source, size, 0

    def start(self) -> bool:
        """Go to the next member; False at the end."""
        if self.at >= self.size:
            return False
        self.source.seek(self.at)
        head = self.source.read(12)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {self.at}")
        skip, self.length, flags = 10, 0, head[3]
        if flags & 4:
            n = struct.unpack("<H", head[10:12])[0]
            extra, k = self.source.read(n), 0
            while k + 4 <= len(extra):
                size = struct.unpack("<H", extra[k + 2 : k + 4])[0]
                if extra[k : k + 2] == b"sl" and size >= 8:
                    self.length = struct.unpack("<I", extra[k + 4 : k + 8])[0]
                k += 4 + size
            skip = 12 + n
        self.source.seek(self.at + skip)
        for flag in (8, 16):  # a file name, a comment
            while flags & flag and self.source.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            self.source.read(2)
        self.z, self.ended = zlib.decompressobj(-15), False
        return True

    def more(self, most: int = 1 << 16) -> bytes:
        """Some more bytes of this member; none at its end."""
        while not self.ended:
            data = self.z.unconsumed_tail or self.source.read(min(most, 1 << 16))
            out = self.z.decompress(data, most)  # without more input, zlib may still hold some output
            if not data and not out and not self.z.eof:
                raise EOFError("the archive ends within a record")
            if self.z.eof:
                self.ended = True
                self.next = self.source.tell() - len(self.z.unused_data) + 8
            if out:
                return out
        return b""

    def skip(self) -> None:
        """Leave this member, by its length if that is known."""
        if self.length:
            self.at += self.length
            return
        while not self.ended:
            self.more()
        self.at = self.next


def read_records(source: pa.NativeFile, size: int, wanted, content: str) -> Iterator[dict]:
    """Records whose headers `wanted` accepts. content: "headers" leaves payloads unread, "digest" gives their length and SHA-1, "payload" their bytes too."""
    file = Inflater(source, size)
    while file.start():
        raw = b""
        while b"\r\n\r\n" not in raw:
            part = file.more(4096)
            if not part:
                break
            raw += part
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        if not wanted(headers):
            file.skip()
            continue
        kind, length = headers.get("warc-type"), int(headers.get("content-length", 0))
        digest = headers.get("warc-payload-digest", "")
        digest = digest.partition(":")[2] or digest
        if len(digest) == 32:
            digest = base64.b32decode(digest).hex()
        out = {
            "record_id": headers.get("warc-record-id"), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "warc_date": headers.get("warc-date"),
            "refers_to": headers.get("warc-refers-to"), "headers": list(headers.items()), "payload_bytes": None, "payload_digest": digest.lower() or None, "payload": None,
        }
        http = "application/http" in headers.get("content-type", "")
        if content != "headers" or kind == "revisit":
            while http and b"\r\n\r\n" not in rest and len(rest) < length:
                rest += file.more()
            inner, _, body = rest.partition(b"\r\n\r\n") if http else (b"", b"", rest)
            stated = parse_headers(inner).get("content-length", "") if http else ""
            if kind == "revisit":
                out["payload_bytes"] = int(stated) if stated.isdigit() else None
            else:
                left = length - (len(inner) + 4 if http else 0)
                sha, parts, n = hashlib.sha1(), [], 0
                while True:
                    body = body[: left - n]
                    sha.update(body)
                    n += len(body)
                    if content == "payload":
                        parts.append(body)
                    if n >= left or not (body := file.more()):
                        break
                if n < left:
                    raise EOFError("a record is shorter than its Content-Length")
                out |= {"payload_bytes": n, "payload_digest": sha.hexdigest(), "payload": b"".join(parts) if content == "payload" else None}
        yield out
        file.skip()


@dataclass
class FilesPartition(InputPartition):
    """Files, with their sizes, that one task reads."""

    files: list[tuple[str, int]]


#: What a pushed predicate asks of a header, which is None where the record lacks it.
_ASKS: dict[type, Callable[[str, object], bool]] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def asked(f: Filter) -> tuple[str, type, object, bool] | None:
    """The header that a predicate asks about, how, against what, and whether the answer is negated; None if headers can't tell."""
    if isinstance(f, Not):
        inner = asked(f.child)
        return None if inner is None or inner[1] is IsNull else (*inner[:3], not inner[3])
    name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
    if name not in PUSHED:
        return None
    if isinstance(f, (IsNull, IsNotNull)):
        return PUSHED[name], IsNull, None, isinstance(f, IsNotNull)
    value = getattr(f, "value", None)
    values = value if isinstance(f, In) else (value,)
    return (PUSHED[name], type(f), value, False) if type(f) in _ASKS and all(isinstance(v, str) for v in values) else None


class WarcReader(DataSourceReader):
    """tests: what record headers must meet, of predicates on the columns PUSHED and of options header.<name>."""

    def __init__(self, path: str, content: str, headers: dict[str, str] | None = None):
        self.path, self.content = path, content
        self.tests: list[tuple[str, type, object, bool]] = [(name, EqualTo, value, False) for name, value in (headers or {}).items()]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take on comparisons of the columns PUSHED with constants, and tests for null, which headers alone decide."""
        for f in filters:
            test = asked(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def wanted(self, headers: dict[str, str]) -> bool:
        """As in SQL, no comparison holds of a header that the record lacks, negated or not."""
        for name, how, value, negated in self.tests:
            x = headers.get(name)
            if how is IsNull:
                if (x is None) == negated:
                    return False
            elif x is None or _ASKS[how](x, value) == negated:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        """Files in order of size, put together up to TASK_BYTES a task; of written archives, those that the manifests name."""
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            found = [(root, store.get_file_info(root).size)]
        else:
            named = manifests(store, root)
            found = [(f"{root}/{name}", size) for m in named for name, size in manifest_files(store, m)]
            if not named:
                found = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".warc.gz")]
        tasks: list[FilesPartition] = []
        room = 0
        for path, size in sorted(found, key=lambda x: (-x[1], x[0])):
            if not tasks or size > room:
                tasks.append(FilesPartition([]))
                room = TASK_BYTES
            tasks[-1].files.append((path, size))
            room -= size
        return tasks or [FilesPartition([])]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema()
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            with store.open_input_file(path) as f:
                for r in read_records(f, size, self.wanted, self.content):
                    rows.append(r)
                    held += len(r["payload"] or b"") + 500
                    if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def manifests(store: fs.FileSystem, root: str) -> list[str]:
    """Paths of the manifests under a folder, one for each write that was committed."""
    return [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(MANIFEST[0]) and i.base_name.endswith(MANIFEST[1])]


def manifest_files(store: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files that a manifest counts."""
    with store.open_input_stream(path) as f:
        return [(name, size) for name, size in json.loads(f.read())]


def arrow_schema() -> pa.Schema:
    text = pa.string()
    return pa.schema([("record_id", text), ("record_type", text), ("target_uri", text), ("warc_date", text), ("refers_to", text), ("headers", pa.map_(text, text)), ("payload_bytes", pa.int64()), ("payload_digest", text), ("payload", pa.binary())])


@dataclass
class Written(WriterCommitMessage):
    """Names and sizes of the files of a task."""

    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; a manifest of this write, written last, names those of the tasks that counted.

    An appended write adds its manifest to those that are there. One that overwrites takes the others' place, then removes their files.
    """

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name = None, ""
        for batch in iterator:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            names = batch.schema.names
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")))
                out.write(member(encoded({n: c[i].as_py() for n, c in zip(names, columns, strict=True)})))
                if out.tell() >= FILE_BYTES:
                    files.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            files.append((name, out.tell()))
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        old = manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST[0]}{uuid.uuid4().hex}{MANIFEST[1]}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        names = [f"{root}/{name}" for m in old for name, _ in manifest_files(store, m)]
        for path in old + names:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """format("warc"). Paths: what pyarrow.fs opens.

    Options: content is payload (default), digest or headers, see read_records; header.<name> takes only records whose header of
    that name has that value, for headers that have no column of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        own = {k.lower().removeprefix("header."): v for k, v in self.options.items() if k.lower().startswith("header.")}
        return WarcReader(self.options["path"], self.options.get("content", "payload"), own)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows of WRITTEN for pages: of those with equal payloads of REVISIT_BYTES or more, the largest id responds and others revisit it.

    A null page is an empty payload. Rows that repeat the largest id with the same payload are all responses. A row without
    id revisits a row with one, and responds where there is none; its record id is drawn from its payload and url.

    Payloads are digested first, and only digests, sizes and ids are grouped. What revisits refer to then comes back to the pages
    by id and digest, so neither a payload nor the many copies of one meet in a task.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # rows without id are told apart by their urls, so that they spread too
    spread = F.coalesce(F.col("id"), F.xxhash64("target_uri"))
    large = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).select("id", spread.alias("at"), F.unhex("payload_digest").alias("of"))
    large = Settled(large, "warc-digests").df
    tops = large.groupBy("of").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null").select("of", "top")
    marks = Settled(large.join(tops, "of").filter("id is null or id < top").select("at", F.col("id").isNull().alias("nameless"), "of", "top").distinct(), "warc-revisits").df
    if marks.count() <= BROADCAST_REVISITS:
        marks = F.broadcast(marks)
    rows = rows.join(marks, (spread == F.col("at")) & (F.col("id").isNull() == F.col("nameless")) & (F.unhex("payload_digest") == F.col("of")), "left")
    again = F.col("top").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    nameless = F.concat(F.lit("<urn:page:unnamed:"), F.col("payload_digest"), F.lit(":"), F.sha1(F.coalesce("target_uri", F.lit("")).cast("binary")), F.lit(">"))
    return rows.select(
        F.coalesce(urn(F.col("id")), nameless).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"), F.when(again, urn(F.col("top"))).alias("refers_to"), "payload_bytes", "payload_digest",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows of WRITTEN as archives under `path`, beside those that are there or (mode overwrite) in their place."""
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, content: str = "payload") -> DataFrame:
    """The records under `path`."""
    register(spark)
    return spark.read.format("warc").option("content", content).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read back what their records say of them.

    A row for each page: page_id, payload_bytes and payload_digest (of the full payload), record_type and refers_to. A null page
    counts as empty, a null id stays null, repeated rows come as often as they are there, ties are as in `records`. Other columns
    aren't read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    # the archive is what the result reads: it goes with the caller's scratch, or when the caller drops it
    with scratch() as kept:
        archive = Folder(spark, "archive")
        kept.append(archive)
        write(records(pages), archive.path)
    path = archive.path
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    got = read(spark, path, "digest").filter(F.col("record_type").isin("response", "revisit"))
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= {REVISIT_BYTES}
"""
