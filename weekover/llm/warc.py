"""WARC archives as a data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes archives of its own name, one gzip member per record, whose
header tells the member's length. The driver lists the files of successful tasks in a
manifest when the job commits, so files of lost or repeated attempts are never read.

Reading: files are split into byte ranges, and a record belongs to the range it starts in.
Headers are parsed first; conditions on columns that come from headers are pushed down and
judged there. The rest of a record that is not wanted is skipped by its length without
being decoded, and so is every payload if the ``payload`` column is not asked for. Archives
by other writers, compressed or not, can be read as well: without a stored length a member
is inflated to find its end.

``archive`` and ``restored`` write and read pages, storing each payload once.

NULL ids become the id ``null``, NULL texts empty payloads, and NULL urls no header.
Control characters in header values are percent-encoded. Payloads of any length are stored
whole. Repeated pages are records each; of equal payloads the one with the largest id is
stored, the first of them if ids repeat. An empty table gives an archive without records.
Only id, url and text are archived; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weekover.llm.common import lookup, reach_workers
from weekover.session import shared_folder

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
# Payloads from this size on are stored once.
LEAST_REVISITED = 1000

SPLIT_BYTES, FILE_BYTES = 64 << 20, 256 << 20
BATCH_BYTES = 8 << 20
# Inflated at first: the record's headers, and as a rule those of HTTP.
HEAD_BYTES = 4096
GZIP = b"\x1f\x8b\x08"
HTTP = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A record without a date of its own carries this one, so that reruns give equal archives.
NO_DATE = "1970-01-01T00:00:00Z"

HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a plain path or a URI."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def _value(text: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(text))


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of the data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(data) & 0xFFFFFFFF)
    head = GZIP + b"\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_value(v)}" for k, v in headers.items() if v is not None)]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(row: dict) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    payload = row["payload"] or b""
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": row["date"] or NO_DATE,
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": row["payload_digest"],
        "WARC-Refers-To": row["refers_to"],
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": HTTP,
    }
    return record(headers, http if revisit else http + payload)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, file_bytes: int):
        self.path, self.overwrite, self.file_bytes = path.rstrip("/"), overwrite, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        attempt, files, out = uuid.uuid4().hex, [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append(f"part-{attempt}-{len(files):05d}.warc.gz")
                        out = fs.open_output_stream(f"{root}/{files[-1]}", compression=None)
                        out.write(member(self._about(files[-1])))
                    out.write(member(page_record(row)))
                    if out.tell() >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    @staticmethod
    def _about(name: str) -> bytes:
        own = uuid.uuid5(uuid.NAMESPACE_URL, name)
        headers = {
            "WARC-Type": "warcinfo",
            "WARC-Record-ID": f"<urn:uuid:{own}>",
            "WARC-Date": NO_DATE,
            "WARC-Filename": name,
            "Content-Type": "application/warc-fields",
        }
        return record(headers, b"format: WARC File Format 1.1\r\n")

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        former = _manifests(fs, root) if self.overwrite else []
        files = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        for path in former:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                fs.delete_file(f"{root}/{name}")


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return [i.path for i in found if i.base_name.startswith("_manifest-")]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


class _Members:
    """Records of a file from a byte range on, headers first."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.raw = io.BufferedReader(file, 1 << 20)
        self.size = size

    def _read(self, at: int, size: int) -> bytes:
        self.raw.seek(at)
        return self.raw.read(size)

    def begin(self, start: int) -> int:
        """Where the first member at or after ``start`` begins."""
        at, tail = start, b""
        while start and at < self.size:
            data = tail + self._read(at, 1 << 16)
            base = at - len(tail)
            k = data.find(GZIP)
            while k >= 0:
                try:
                    if zlib.decompressobj(31).decompress(self._read(base + k, 1024), 8).startswith(b"WARC/"):
                        return base + k
                except zlib.error:
                    pass
                k = data.find(GZIP, k + 1)
            at, tail = base + len(data), data[-2:]
        return min(at, self.size)

    def head(self, at: int) -> tuple[bytes, zlib._Decompress | None, int | None]:
        """First inflated bytes of the member, the inflater, and the member's length if stored."""
        data = self._read(at, HEAD_BYTES)
        length = None
        if data[:3] == GZIP and data[3] & 4:
            extra = data[12 : 12 + struct.unpack_from("<H", data, 10)[0]]
            if extra[:2] == b"sl" and len(extra) >= 12:
                length = struct.unpack_from("<I", extra, 4)[0]
        unpacker = zlib.decompressobj(31)
        return unpacker.decompress(data, HEAD_BYTES), unpacker, length

    def rest(self, at: int, unpacker, length: int | None, wanted: bool) -> tuple[list[bytes], int]:
        """The other inflated bytes if wanted, and where the next member begins."""
        if length is not None and not wanted:
            return [], at + length
        parts, read = [], at + min(HEAD_BYTES, self.size - at)
        data = unpacker.unconsumed_tail
        while not unpacker.eof:
            part = unpacker.decompress(data, 1 << 20)
            if wanted and part:
                parts.append(part)
            data = unpacker.unconsumed_tail
            if not data and not unpacker.eof:
                data = self._read(read, 1 << 16)
                read += len(data)
                if not data:
                    raise ValueError("a record is cut off")
        return parts, read - len(unpacker.unused_data)


def _parse(head: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields in lower case and where they end; None if they are not complete."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes = path.rstrip("/"), schema, split_bytes
        self.conditions: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (
                isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith))
                and len(f.attribute) == 1
                and f.attribute[0] in HEADERS
            ):
                self.conditions.append(f)
            else:
                yield f

    def _fits(self, headers: dict[str, str]) -> bool:
        for f in self.conditions:
            value = headers.get(HEADERS[f.attribute[0]])
            match f:
                case EqualTo() | EqualNullSafe():
                    fits = value == f.value and (value is not None or isinstance(f, EqualNullSafe))
                case In():
                    fits = value is not None and value in f.value
                case IsNull():
                    fits = value is None
                case IsNotNull():
                    fits = value is not None
                case _:
                    fits = value is not None and value.startswith(f.value)
            if not fits:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            manifests = _manifests(fs, root)
            if manifests:
                names = []
                for path in manifests:
                    with fs.open_input_stream(path) as f:
                        names += json.loads(f.read())
                files = fs.get_file_info([f"{root}/{n}" for n in sorted(names)]) if names else []
            else:
                found = fs.get_file_info(pafs.FileSelector(root))
                files = [i for i in found if re.search(r"\.warc(\.gz)?$", i.base_name)]
        ranges: list[InputPartition] = []
        for i in files:
            # Only gzip members can be told apart in the middle of a file.
            step = self.split_bytes if i.base_name.endswith(".gz") else max(1, i.size)
            ranges += [Range(i.path, at, min(i.size, at + step)) for at in range(0, i.size, step)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        arrow = to_arrow_schema(self.schema)
        names = self.schema.names
        rows, held = [], 0
        for row in self._records(partition, "payload" in names, "payload_bytes" in names):
            rows.append(row)
            held += 500 + len(row["payload"] or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

    def _records(self, part: Range, payloads: bool, sizes: bool) -> Iterator[dict]:
        fs, _ = opened(self.path)
        with fs.open_input_file(part.file) as file:
            members = _Members(file, file.size())
            if not part.file.endswith(".gz"):
                yield from self._plain(members, payloads)
                return
            at = members.begin(part.start)
            while at < part.stop:
                head, unpacker, length = members.head(at)
                parsed, whole = _parse(head), False
                if parsed is None:
                    parts, after = members.rest(at, unpacker, length, True)
                    head, whole = head + b"".join(parts), True
                    parsed = _parse(head)
                    if parsed is None:
                        raise ValueError(f"no WARC headers at {at} of {part.file}")
                headers, end = parsed
                fits = self._fits(headers)
                http = headers.get("content-type", "").startswith("application/http")
                need = fits and (payloads or sizes and http and b"\r\n\r\n" not in head[end:])
                if not whole:
                    parts, after = members.rest(at, unpacker, length, need)
                    head += b"".join(parts)
                if fits:
                    yield self._row(headers, head[end : end + int(headers["content-length"])], http, payloads)
                at = after

    def _plain(self, members: _Members, payloads: bool) -> Iterator[dict]:
        raw, at = members.raw, 0
        while at < members.size:
            raw.seek(at)
            head = b""
            while (line := raw.readline()) not in (b"\r\n", b""):
                head += line
            parsed = _parse(head + b"\r\n")
            if parsed is None:
                raise ValueError(f"no WARC headers at {at}")
            headers, body, size = parsed[0], raw.tell(), int(parsed[0]["content-length"])
            if self._fits(headers):
                http = headers.get("content-type", "").startswith("application/http")
                block = raw.read(size if payloads else min(size, HEAD_BYTES))
                yield self._row(headers, block, http, payloads)
            at = body + size + 4

    @staticmethod
    def _row(headers: dict[str, str], block: bytes, http: bool, payloads: bool) -> dict:
        row: dict = {name: headers.get(key) for name, key in HEADERS.items()}
        size = int(headers["content-length"])
        if http:
            end = block.find(b"\r\n\r\n") + 4
            if end < 4:
                end = len(block)
            stated = re.search(rb"(?im)^content-length: *(\d+)", block[:end])
            size, block = int(stated[1]) if stated else size - end, block[end:]
        row["payload_bytes"] = size
        row["payload"] = block if payloads and row["record_type"] != "revisit" else None
        return row


class WarcDataSource(DataSource):
    """Options: ``path``, ``splitBytes`` for reading, ``fileBytes`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("fileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reach_workers(spark)
    spark.dataSource.register(WarcDataSource)


def sha1(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def archive(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST_REVISITED,
) -> None:
    """Write a record per page, with equal payloads of at least ``least`` bytes stored once.

    Of these the page with the largest id is the response and the others revisit it; rows
    that share the largest id are all responses, and so are all if no id is known.
    """
    register(pages.sparkSession)
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("target_uri"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    )
    size = F.octet_length("payload").cast("bigint").alias("payload_bytes")
    sized = rows.select("*", size, F.sha1("payload").alias("digest"))
    large = sized.where(F.col("payload_bytes") >= least)
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    placed = lookup(sized, holders.where("n > 1").select("digest", "holder"), ["digest"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    records = placed.select(
        name("page_id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        F.when(revisit, name("holder")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def restored(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every archived page.

    Revisits are read by their headers alone; sizes and digests of responses are taken from
    their payloads as read.
    """
    register(spark)
    number = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("bigint")
    headers = SCHEMA.removesuffix(", payload binary")
    revisits = spark.read.format("warc").schema(headers).load(path).where("record_type = 'revisit'")
    responses = spark.read.format("warc").load(path).where("record_type = 'response'")
    return (
        responses.select(
            number("record_id").alias("page_id"),
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest"),
            "record_type",
            F.lit(None).cast("bigint").alias("refers_to"),
        )
    ).union(
        revisits.select(
            number("record_id"),
            "payload_bytes",
            F.regexp_replace("payload_digest", "^sha1:", ""),
            "record_type",
            number("refers_to"),
        )
    )


def new_archive(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")
