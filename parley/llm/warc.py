"""WARC archives as a PySpark Python data source, format ``warc``.

Writing: a task streams its rows into one file of gzip members, one record each, under a hidden
name; the commit gives the files of successful tasks their names, so a lost or repeated task
leaves nothing that is read. Every member carries the ``sl`` skip-length extra field.

Reading: the driver lists the files and deals them into partitions of about equal bytes.
Predicates on ``record_type``, ``page_id``, ``url`` and ``payload_digest`` are pushed down: a
record's header is inflated first, and the payload is only inflated if the record is wanted and
the schema asks for ``payload``; otherwise the reader jumps over the member by its skip length.
Paths go through pyarrow's file systems, so any store that these can open will do.

Defined cases: a null html is an empty payload, a null url has no target header and reads as
null. Null page_ids stay null. An empty table gives an empty archive, which reads as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from parley.llm.common import shared_path, staged

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_url string, payload binary"
SMALLEST_REVISIT = 100
#: More first copies than this are joined by a shuffle; so many take about 20 MB as a broadcast.
BROADCAST_ROWS = 200_000
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
MEMBER = len(HEAD) + 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    sizes = struct.pack("<II", MEMBER + len(body) + 8, len(raw))
    return b"".join((HEAD, sizes, body, struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)))


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A WARC/1.1 record of one row of RECORD."""
    revisit, payload, size = row["record_type"] == "revisit", row["payload"] or b"", row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{ID}{'' if row['page_id'] is None else row['page_id']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['url'])}")
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{row['refers_to']}>"]
        if row["refers_to_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(row['refers_to_url'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


@dataclass
class WroteFile(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WroteFile:
        fs, top = opened(self.path)
        fs.create_dir(top, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    out = out or fs.open_output_stream(f"{top}/.{name}", compression=None)
                    out.write(record(row))
        if out is None:
            return WroteFile(None)
        out.close()
        return WroteFile(name)

    def commit(self, messages: list[WroteFile | None]) -> None:
        fs, top = opened(self.path)
        fs.create_dir(top, recursive=True)
        for m in messages:
            if m and m.name:
                fs.move(f"{top}/.{m.name}", f"{top}/{m.name}")

    def abort(self, messages: list[WroteFile | None]) -> None:
        fs, top = opened(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{top}/.{m.name}")


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.wanted = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons with constants on header columns; the others stay with Spark."""
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull)) and f.attribute in (("page_id",), ("url",), ("record_type",), ("payload_digest",))
            if not known:
                yield f
            elif not isinstance(f, IsNotNull):
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                self.wanted.append((f.attribute[0], None))

    def partitions(self) -> list[Files]:
        fs, top = opened(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(top)) if x.base_name.endswith(".warc.gz") and not x.base_name.startswith(".")]
        parts, total = [[]], 0
        for x in sorted(found, key=lambda x: x.base_name):
            if total and total + x.size > PARTITION_BYTES:
                parts.append([])
                total = 0
            parts[-1].append(x.path)
            total += x.size
        return [Files(p) for p in parts]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        names = self.schema.names
        schema = pa.schema([(n, {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(n, pa.string())) for n in names])
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as source:
                for row in records(source, "payload" in names, self.wanted):
                    rows.append({n: row[n] for n in names})
                    held += 200 + len(row["payload"] or b"")
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Buffered:
    """Forward reads with a look-ahead, and jumps that pass over bytes without reading them."""

    def __init__(self, source, ahead: int = 1 << 18):
        self.source, self.ahead, self.buffer, self.start = source, ahead, b"", 0

    def at(self, place: int, n: int) -> bytes:
        if not (self.start <= place and place + n <= self.start + len(self.buffer)):
            self.source.seek(place)
            self.buffer, self.start = self.source.read(max(n, self.ahead)), place
        return self.buffer[place - self.start : place - self.start + n]


def records(source, with_payload: bool, wanted: list[tuple[str, set | None]]) -> Iterator[dict]:
    """Rows of one archive file. Headers first; payloads only of wanted records."""
    size, place, window = source.size(), 0, Buffered(source)
    while place < size:
        head = window.at(place, MEMBER)
        inflate, fed = zlib.decompressobj(-15 if head[: len(HEAD)] == HEAD else 31), place
        length = struct.unpack_from("<I", head, len(HEAD))[0] if head[: len(HEAD)] == HEAD else None
        fed += MEMBER if length else 0
        text = b""
        while b"\r\n\r\n" not in text and not inflate.eof:
            piece = inflate.unconsumed_tail or window.at(fed, 4096)
            if not piece:
                raise ValueError("a record ends in its header")
            fed += 0 if inflate.unconsumed_tail else len(piece)
            text += inflate.decompress(piece, 4096)
        cut = text.index(b"\r\n\r\n")
        row, block = parsed(text[:cut].decode()), text[cut + 4 :]
        keep = all(row[c] is not None if values is None else row[c] in values for c, values in wanted)
        whole = keep and with_payload and row["record_type"] == "response" or length is None or keep and row["payload_bytes"] is None and b"\r\n\r\n" not in block
        if whole:
            pieces = [block]
            end = place + length if length else None
            while not inflate.eof:
                piece = inflate.unconsumed_tail or window.at(fed, min(1 << 18, end - fed) if end else 1 << 16)
                if not piece:
                    raise ValueError("a record ends in its block")
                fed += 0 if inflate.unconsumed_tail else len(piece)
                pieces.append(inflate.decompress(piece))
            block = b"".join(pieces)
        if keep:
            http, _, body = block[: row.pop("block_bytes")].partition(b"\r\n\r\n")
            for line in http.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.lower() == b"content-length":
                    row["payload_bytes"] = int(value)
            row["payload"] = body if with_payload and row["record_type"] == "response" else None
            yield row
        place = place + length if length else fed - len(inflate.unused_data)


def parsed(head: str) -> dict:
    fields = {}
    for line in head.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    number = lambda v: int(v[len(ID) + 1 : -1]) if v and v.startswith(f"<{ID}") and v[len(ID) + 1 : -1] else None
    return {
        "page_id": number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "payload_bytes": None,
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, "refers_to": number(fields.get("warc-refers-to")), "block_bytes": int(fields["content-length"]),
    }


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are not overwritten; write to a new folder")
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archive(pages: DataFrame, path: str) -> None:
    """One record a page. Of equal payloads of SMALLEST_REVISIT bytes or more, the one with the
    smallest page_id is a response and the others revisit it."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("payload_bytes") >= SMALLEST_REVISIT).groupBy("payload_digest").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("first"), F.count("*").alias("copies"))
    first = staged(first.where("copies > 1 AND first.page_id IS NOT NULL").select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "warc-first-copies")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(first, "payload_digest", "left").select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_digest", "payload_bytes",
        F.when(again, F.col("first_id")).cast("long").alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_to_url"), F.when(~again, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Rows of an archive; leave ``payload`` out of the schema and no payload is inflated."""
    register(spark)
    return spark.read.format("warc").schema(schema).option("path", path).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Contract columns, read back from archives written in the shared folder. Digest and length of
    a response are taken of the payload read, those of a revisit from its headers."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(pages, path)
    rows = read_archive(spark, path)
    own = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
