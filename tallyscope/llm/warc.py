"""WARC archives as a Python data source with planned splits and predicates on headers.

Each record is its own gzip member, whose extra field ``SL`` holds the member's length. A reader
inflates a member only until the header block ends, tests the pushed predicates and, if the record
isn't wanted, goes on at the next member without inflating the rest. Members without the field are
inflated through, whatever the number of records in one. Writers rotate files and note an offset about
every ``SPLIT`` bytes; the driver joins these notes into a manifest when the job commits. A partition is
one split of one file. Folders are read with the folders in them. Beside a manifest, files named ``part-*``
that it doesn't list are those of failed or repeated attempts and never read; any other ``.warc.gz`` or
``.warc`` file comes from another writer and is one partition.

Responses carry an HTTP block; a revisit keeps the HTTP header alone, so the payload's length and
digest are known for both. Files are opened through ``pyarrow.fs``, by the URI of the folder.

Defined cases: a null payload is empty; null identifiers are absent headers and come back null; equal
identifiers are written as often as they come; line ends in header values become spaces; an empty table
gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .registry import query, table
from .shared import shared_folder

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, payload_bytes long, payload binary"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
FILE_BYTES = 256_000_000
SPLIT = 32_000_000
BATCH_BYTES = 4_000_000
LEAST_REVISIT = 100
DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _clean(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def member(data: bytes, level: int = 3) -> bytes:
    """One gzip member that knows its own length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 10 + 2 + 4 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<HQ", 8, total)
    return head + body + tail


def record(row: dict) -> bytes:
    payload = row["payload"] or b""
    kind = row["record_type"] or "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    lines = [f"WARC-Type: {_clean(kind)}"]
    for name, header in (
        ("record_id", "WARC-Record-ID"),
        ("target_uri", "WARC-Target-URI"),
        ("warc_date", "WARC-Date"),
        ("payload_digest", "WARC-Payload-Digest"),
        ("refers_to", "WARC-Refers-To"),
    ):
        if row.get(name) is not None:
            lines.append(f"{header}: {_clean(row[name])}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT}")
    lines += ["Content-Type: application/http;msgtype=response", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        fs, root = _place(self.folder)
        fs.create_dir(root, recursive=True)
        files, out, entry = [], None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or entry["size"] >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    entry = {"name": f"part-{uuid.uuid4().hex}.warc.gz", "size": 0, "splits": [0]}
                    files.append(entry)
                    out = fs.open_output_stream(f"{root}/{entry['name']}", compression=None)
                data = member(record(row))
                if entry["size"] - entry["splits"][-1] >= SPLIT:
                    entry["splits"].append(entry["size"])
                out.write(data)
                entry["size"] += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = _place(self.folder)
        fs.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = _place(self.folder)
        for m in messages:
            for f in m.files if m is not None else []:
                fs.delete_file(f"{root}/{f['name']}")


@dataclass
class Split(InputPartition):
    name: str
    start: int
    end: int


_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


def wanted(row: dict, tests: list) -> bool:
    return all(row[name] is not None and _TESTS[kind](row[name], value) for kind, name, value in tests)


class Reader(DataSourceReader):
    def __init__(self, folder: str, with_payload: bool):
        self.folder, self.with_payload, self.tests = folder, with_payload, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in {*HEADERS, "payload_bytes"}:
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = _place(self.folder)
        files = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file]
        splits, listed, ours = [], set(), set()
        for info in files:
            if info.base_name.startswith("manifest-"):
                home = info.path[: -len(info.base_name)]
                ours.add(home)
                with fs.open_input_stream(info.path) as f:
                    for entry in json.loads(f.read()):
                        listed.add(home + entry["name"])
                        splits += [Split(home + entry["name"], a, b) for a, b in zip(entry["splits"], [*entry["splits"][1:], entry["size"]], strict=True)]
        for info in files:
            # Member starts of other files aren't known, so a file is one split.
            left = info.path[: -len(info.base_name)] in ours and info.base_name.startswith("part-")
            if info.base_name.endswith((".warc.gz", ".warc")) and info.path not in listed and not left:
                splits.append(Split(info.path, 0, info.size))
        return splits or [Split("", 0, 0)]

    def read(self, split):
        if not split.name:
            return
        fs, _ = _place(self.folder)
        rows, size = [], 0
        with fs.open_input_file(split.name) as f:
            for row in self._plain(lambda: f.read(65536)) if split.name.endswith(".warc") else self._members(f, split):
                rows.append(row)
                size += 300 + len(row["payload"] or b"")
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, f, split):
        at = split.start
        while at < split.end:
            length, place = _measured(f, at)
            if length is not None:
                row = self._record(f, at, place, length)
                if row is not None:
                    yield row
                at += length
                continue
            f.seek(at + place)
            inflate = zlib.decompressobj(-15)

            def more(inflate=inflate, at=at):
                while not inflate.eof:
                    feed = f.read(65536)
                    if not feed:
                        raise OSError(f"the archive ends inside the member at byte {at}")
                    if text := inflate.decompress(feed):
                        return text
                return b""

            yield from self._plain(more)
            at = f.tell() - len(inflate.unused_data) + 8

    def _plain(self, more):
        """The wanted records of a text that ``more`` gives piece by piece, and b"" at its end."""
        held, ended = bytearray(), False
        while True:
            while not ended and (not held.strip(b"\r\n") or b"\r\n\r\n" not in held.lstrip(b"\r\n")):
                text = more()
                ended = not text
                held += text
            held = held.lstrip(b"\r\n")
            if not held:
                return
            head, end, held = held.partition(b"\r\n\r\n")
            if not end or not head.startswith(b"WARC/"):
                raise OSError("a record has no header block")
            fields, row = _header(bytes(head))
            late = [t for t in self.tests if t[1] == "payload_bytes" and row["payload_bytes"] is None]
            keep = wanted(row, [t for t in self.tests if t not in late])
            left, parts = int(fields.get("content-length", 0)), []
            while left:
                if not held:
                    held += more()
                    if not held:
                        raise OSError("the archive ends inside a record")
                if keep:
                    parts.append(bytes(held[:left]))
                taken = min(left, len(held))
                left -= taken
                del held[:taken]
            if keep:
                self._fill(row, fields, b"".join(parts))
                if wanted(row, late):
                    yield row

    def _fill(self, row: dict, fields: dict, block: bytes) -> None:
        if fields.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        if row["record_type"] != "revisit":
            if self.with_payload:
                row["payload"] = block
            if row["payload_bytes"] is None:
                row["payload_bytes"] = len(block)

    def _record(self, f, at: int, place: int, length: int):
        """The record of a member of known length, None if a predicate rejects it."""
        f.seek(at + place)
        inflate = zlib.decompressobj(-15)
        left = length - place
        text = b""
        while b"\r\n\r\n" not in text and left:
            feed = f.read(min(4096, left))
            if not feed:
                raise OSError(f"the archive ends inside a record at byte {at}")
            left -= len(feed)
            text += inflate.decompress(feed)
        head, _, body = text.partition(b"\r\n\r\n")
        fields, row = _header(head)
        # A length without a header is known only after the block was read.
        late = [t for t in self.tests if t[1] == "payload_bytes" and row["payload_bytes"] is None]
        if not wanted(row, [t for t in self.tests if t not in late]):
            return None
        if not self.with_payload and not late:
            return row
        parts = [body]
        while not inflate.eof:
            feed = f.read(max(1, min(1 << 20, left)))
            if not feed:
                raise OSError(f"the archive ends inside a record at byte {at}")
            left -= len(feed)
            parts.append(inflate.decompress(feed))
        self._fill(row, fields, b"".join(parts)[: int(fields.get("content-length", 0))])
        return row if wanted(row, late) else None


def _measured(f, at: int):
    """A gzip member's length, if its extra field tells it, and the size of its gzip header."""
    f.seek(at)
    raw = f.read(1024)
    if raw[:3] != b"\x1f\x8b\x08":
        raise OSError(f"no gzip member starts at byte {at}")
    flags, place, length = raw[3], 10, None
    if flags & 4:
        size = struct.unpack_from("<H", raw, 10)[0]
        extra = raw[12 : 12 + size]
        place += 2 + size
        while len(extra) >= 4:
            width = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"SL":
                length = struct.unpack_from("<Q", extra, 4)[0]
            extra = extra[4 + width :]
    for bit in (8, 16):
        if flags & bit:
            place = raw.index(b"\0", place) + 1
    return length, place + (2 if flags & 2 else 0)


def _header(head: bytes):
    """All header fields of a record, and the row as far as they tell it."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    row = {name: fields.get(header) for name, header in HEADERS.items()}
    row["payload_bytes"] = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
    row["payload"] = None
    return fields, row


_ARROW = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in NAMES])


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """Options: path (a folder) and payload (false leaves payloads undecoded)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(records: DataFrame, folder: str) -> None:
    register(records.sparkSession)
    columns = [F.col(n) if n in records.columns else F.lit(None).cast("string").alias(n) for n in NAMES if n != "payload_bytes"]
    records.select(*columns).write.format("warc").option("path", folder).mode("append").save()


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records of pages (page_id, url, html): equal payloads of at least ``least`` bytes are stored once."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    keyed = pages.filter(F.length("payload") >= least).select("page_id", "digest")
    firsts = (
        keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first <> last")
    )
    again = keyed.join(firsts, "digest").filter("page_id <> first").select("page_id", "digest", "first").distinct()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return pages.join(again, ["page_id", "digest"], "left").select(
        urn("page_id").alias("record_id"),
        F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        urn("first").alias("refers_to"),
        "payload",
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT sha256(h) AS d, min(page_id) AS first FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY 1)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = sha256(h) AND octet_length(encode(h)) >= 100
"""


@query("op6_warc_archive", SQL)
def op6(spark, folder):
    place = shared_folder(spark, "warc")
    write_warc(with_revisits(table(spark, folder, "pages")), place)
    back = read_warc(spark, place)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    stored = F.substring("payload_digest", 8, 64)
    return back.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(stored).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
