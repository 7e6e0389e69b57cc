"""JSON lines with a manifest: a sink that shows all of its files or none.

Tasks write hidden files and report name, rows, bytes and SHA-256 of each; the driver gives the files their
names and writes the manifest last, so a folder without one was never finished. A folder that has a
manifest is refused. What a failed write leaves is removed. The folder is any that driver and
executors share and pyarrow can write (file:, hdfs:, s3:).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT, MANIFEST = "manifest_jsonl", "manifest.json"
#: Bytes after which a task begins another file.
FILE_BYTES = 64 << 20


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: hidden name, rows, bytes, hash."""

    files: list[tuple[str, int, int, str]]


@dataclass
class File:
    name: str
    rows: int
    bytes: int
    sha256: str


class ManifestWriter(DataSourceWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes
        where, folder = self._open()
        if where.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} holds a finished export")
        where.create_dir(folder, recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        where, folder = self._open()
        files, out = [], None
        try:
            for row in rows:
                if out is None:
                    name, n, size, digest = f".{uuid.uuid4().hex}.jsonl", 0, 0, hashlib.sha256()
                    out = where.open_output_stream(f"{folder}/{name}")
                line = (json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode()
                out.write(line)
                digest.update(line)
                n, size = n + 1, size + len(line)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, n, size, digest.hexdigest()))
                    out = None
        finally:
            if out is not None:
                out.close()
                files.append((name, n, size, digest.hexdigest()))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = self._open()
        found = sorted(f for m in messages if m for f in m.files)
        manifest = []
        for i, (hidden, rows, size, digest) in enumerate(found):
            name = f"part-{i:05d}.jsonl"
            where.move(f"{folder}/{hidden}", f"{folder}/{name}")
            manifest.append(asdict(File(name, rows, size, digest)))
        with where.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"files": manifest, "rows": sum(f["rows"] for f in manifest)}, indent=1).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = self._open()
        for m in messages:
            for hidden, *_ in m.files if m else ():
                if where.get_file_info(f"{folder}/{hidden}").type != fs.FileType.NotFound:
                    where.delete_file(f"{folder}/{hidden}")


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        if overwrite:
            raise ValueError("an export is never overwritten")
        return ManifestWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def write(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    df.sparkSession.dataSource.register(ManifestSource)
    df.write.format(FORMAT).mode("append").option("file_bytes", file_bytes).save(path)


def manifest_of(path: str) -> list[File]:
    where, folder = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return [File(**x) for x in json.loads(f.read())["files"]]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an export whose files all are as its manifest says; else an error. Each file is hashed where it is
    read, and files are of bounded size."""
    known = manifest_of(path)
    if not known:
        return spark.createDataFrame([], schema)
    said = spark.createDataFrame([(f.name, f.sha256) for f in known], "name string, sha256 string")
    seen = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.jsonl").load(path)
    seen = seen.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    wrong = said.join(seen, "name", "full").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("name").limit(5).collect()
    if wrong:
        raise ValueError(f"not as the manifest says: {', '.join(r['name'] for r in wrong)}")
    return spark.read.schema(schema).json([f"{path}/{f.name}" for f in known])
