"""WARC archives: a Python data source that reads them, and a writer for page tables.

Reading. ``spark.read.format("quillon_warc")`` plans one partition for a run of files of about ``partition_bytes``. Every record's
headers are parsed first; the record-type and header predicates that Spark pushes down (or the options ``types`` and ``headers``) are decided on
the headers, and the payload of a record that fails them, or of any record if ``payload`` is false, is never decoded: in a compressed
archive the member is skipped by the length that our writer leaves in the gzip extra field ``sl``; members without it
are inflated to find their end, without being kept; plain archives are read past.

Writing. ``write_pages`` puts one record for each row into per-record gzip members, one archive for each task. Payloads of at least
``min_bytes`` bytes that a smaller id already has become revisit records, which name the first record and keep no payload.

Files are opened by URI through Arrow's file systems, so executors need no local copy. A damaged record ends its file with
ValueError, or silently with the option ``damaged = skip``.

Defined results: null html is an empty payload; rows with a null id come last among equal payloads; repeated rows of the smallest id are
responses each; an empty table writes no archive and reads back as no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from quillon.llm import words as W
from quillon.llm.store import new_path

NAME = "quillon_warc"
SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, page_id bigint, payload_bytes bigint, headers map<string,string>, content binary, file string, offset bigint"
DATE = "2024-01-01T00:00:00Z"
LIST = "_archives"  # names the archives of the attempts that counted; a reader of the folder reads those alone
PREFIX = "urn:quillon:page:"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records


def record(headers: list[tuple[str, str]], content: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(content)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + content + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own compressed and plain lengths."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line goes on with the one before
            out[last] += " " + line.strip()
        elif ":" in line:
            k, v = line.split(":", 1)
            last = k.strip().lower()
            out[last] = v.strip()
    return out


_END = b"\r\n\r\n"


class _Inflated:
    """Plain bytes of one gzip member, inflated only as far as they are asked for."""

    STEP = 4096

    def __init__(self, stream, head: bytes):
        self.stream, self.z, self.kept, self.tail = stream, zlib.decompressobj(31), b"", b""
        self._feed(head)

    def _feed(self, data: bytes) -> None:
        self.kept += self.z.decompress(data)
        self.tail = self.z.unused_data

    def more(self) -> bool:
        if self.z.eof:
            return False
        data = self.stream.read(self.STEP)
        if not data:
            raise ValueError("a compressed record ends early")
        self._feed(data)
        return True

    def until(self, n: int) -> None:
        while len(self.kept) < n and self.more():
            pass

    def skip(self) -> bytes:
        """To the member's end, keeping nothing; what was read past it."""
        while not self.z.eof:
            self.kept = b""
            self.more()
        return self.tail


def records(stream, wanted=lambda headers: True, payload: bool = True) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, headers, content or None) of the records whose headers are wanted; others are passed without decoding."""
    at, ahead = 0, b""
    while True:
        head = ahead + stream.read(24 - len(ahead)) if len(ahead) < 24 else ahead
        ahead = b""
        while head[:1] in (b"\r", b"\n"):
            head, at = head[1:], at + 1
            head += stream.read(1)
        if not head:
            return
        if head[:2] == b"\x1f\x8b":
            length = struct.unpack_from("<I", head, 16)[0] if len(head) >= 24 and head[3] & 4 and head[12:16] == b"sl\x08\x00" else 0
            part = _Inflated(stream, head)
            while _END not in part.kept:
                if not part.more():
                    raise ValueError("a record has no end of headers")
            cut = part.kept.index(_END) + 4
            headers = parse_headers(part.kept[: cut - 4])
            size = int(headers.get("content-length", "0"))
            take = wanted(headers)
            content = None
            if take and payload:
                part.until(cut + size)
                content = part.kept[cut : cut + size]
                if len(content) < size:
                    raise ValueError("a record's content ends early")
            if length and not part.z.eof:
                stream.seek(at + length)
            else:
                ahead = part.skip()
                length = length or stream.tell() - at - len(ahead)
            if take:
                yield at, headers, content
            at += length
        else:
            block = head
            while _END not in block:
                data = stream.read(1024)
                if not data:
                    raise ValueError("a record has no end of headers")
                block += data
            cut = block.index(_END) + 4
            headers = parse_headers(block[: cut - 4])
            size = int(headers.get("content-length", "0"))
            take = wanted(headers)
            if take and payload:
                stream.seek(at + cut)
                content = stream.read(size)
                if len(content) < size:
                    raise ValueError("a record's content ends early")
            else:
                content = None
            if take:
                yield at, headers, content
            at += cut + size + 4
            stream.seek(at)


# --- reading with Spark


@dataclass
class Files(InputPartition):
    paths: list[str]


FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true" and "content" in self.names
        self.skip = options.get("damaged", "fail") == "skip"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.needed: list[tuple[str, frozenset[str]]] = []
        if options.get("types"):
            self.needed.append(("warc-type", frozenset(options["types"].split(","))))
        for rule in filter(None, options.get("headers", "").split(";")):
            k, v = rule.split("=", 1)
            self.needed.append((k.strip().lower(), frozenset(v.split(","))))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = FIELDS.get(f.attribute[0]) if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.needed.append((name, frozenset([f.value])))
            elif name and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.needed.append((name, frozenset(f.value)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in values for k, values in self.needed)

    def partitions(self) -> list[Files]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            return [Files([])]  # Spark reads a source without partitions as one that has no partitioning
        found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        listed = f"{root}/{LIST}"
        if not info.is_file and fs.get_file_info(listed).is_file:
            with fs.open_input_file(listed) as f:
                names = {*f.read().decode().split("\n")}
            found = [x for x in found if x.base_name in names]
        out: list[Files] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if not out or room < x.size:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].paths.append(x.path)
            room -= x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                try:
                    for at, h, content in records(stream, self.wanted, self.payload):
                        told = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        if content is not None and h.get("warc-type") == "response" and "x-payload-length" in h and told and digest(content) != told:
                            raise ValueError(f"the record at {at} has another digest than its header tells")
                        page = h.get("x-page-id", "")
                        row = {name: h.get(key) for name, key in FIELDS.items()}
                        row |= {"page_id": int(page) if page.lstrip("-").isdigit() else None, "payload_bytes": int(h.get("x-payload-length", h.get("content-length", 0))), "headers": list(h.items()), "content": content, "file": path, "offset": at}
                        rows.append(row)
                        held += len(content or b"") + 500
                        if held > 8 << 20:
                            yield self._batch(rows)
                            rows, held = [], 0
                except (ValueError, zlib.error) as e:
                    if not self.skip:
                        raise ValueError(f"{path}: {e}") from e
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "offset": pa.int64(), "content": pa.binary(), "headers": pa.map_(pa.string(), pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names], names=self.names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records under a URI; filters on record_type and other header columns are pushed down where the session allows it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it Spark refuses sources that take filters
    return spark.read.format(NAME).options(**options).load(path)


# --- writing


def _write(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(path)
    task = TaskContext.get()
    # one name for a task's attempts is not enough: two may run at once; only the attempt whose row is kept is read
    name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    stream, count = None, 0
    try:
        for part in W.slices(batches, "html"):
            for page, html, url, first, sha in zip(*(part.column(n).to_pylist() for n in ("page_id", "html", "url", "first", "sha1")), strict=True):
                payload = (html or "").encode()
                label = "null" if page is None else str(page)
                headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<{PREFIX}{label}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", base64.b32encode(bytes.fromhex(sha)).decode()), ("X-Page-Id", label), ("X-Payload-Length", str(len(payload)))]
                if first is not None:
                    headers += [("WARC-Refers-To", f"<{PREFIX}{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(name, compression=None)
                stream.write(member(record(headers, payload if first is None else b"")))
                count += 1
    finally:
        if stream is not None:
            stream.close()
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> list[str]:
    """Writes the pages (page_id, url, html) under the URI; the archives written, one for each task that had rows."""
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    some = light.where(F.octet_length("html") >= min_bytes)
    # one row for each payload that occurs again; the rest of the work is one join on its digest
    again = some.groupBy("sha1").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").drop("n")
    first = F.when(F.col("least").isNotNull() & (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    rows = light.join(again, "sha1", "left").select("page_id", "url", "html", "sha1", first.alias("first"))
    written = sorted(r["file"] for r in rows.mapInArrow(partial(_write, path=path), "file string, records bigint").collect())
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{LIST}", compression=None) as out:
        out.write("".join(f"{x.rsplit('/', 1)[1]}\n" for x in written).encode())
    return written


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the pages and gives the records as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_pages(pages, path, min_bytes)
    return read_warc(spark, path)
