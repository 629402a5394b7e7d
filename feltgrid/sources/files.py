"""A data source that writes tables as CSV or JSON-lines files and describes them while it writes.

Each task writes one file of its own attempt and hands its path, rows, bytes and SHA-256 to the commit, which
lists the files of the attempts that count in ``manifest.jsonl`` beside them. Files are never read again to be
described, and files of lost attempts are not listed. Paths may have any scheme that Arrow's file systems know.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "feltgrid_files"
LISTED = "manifest.jsonl"
HASH_LENGTH = 12


@dataclass
class Written(WriterCommitMessage):
    """One file, or none where a task had no rows."""

    name: str | None = None
    rows: int = 0
    size: int = 0
    digest: str = ""


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class FileWriter(DataSourceArrowWriter):
    """Text cells are quoted in CSV, so that empty ones differ from nulls."""

    def __init__(self, path: str, kind: str, overwrite: bool, columns: list[str]):
        self.path, self.kind, self.overwrite, self.columns = path.rstrip("/"), kind, overwrite, columns

    def _text(self, batch: pa.RecordBatch, first: bool) -> bytes:
        if self.kind == "json":
            return "".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode()
        out = io.BytesIO()
        pacsv.write_csv(batch, out, pacsv.WriteOptions(include_header=first, quoting_style="needed"))
        return out.getvalue()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        system, folder = _file_system(self.path)
        number = task.partitionId()
        name = f"part-{number:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.{self.kind}"
        digest, rows, size, stream = hashlib.sha256(), 0, 0, None
        # The first task writes a file even if the table is empty.
        empty = [] if number else [pa.RecordBatch.from_arrays([pa.array([], pa.string())] * len(self.columns), self.columns)]
        for batch in itertools.chain((b for b in iterator if b.num_rows), empty):
            if not batch.num_rows and stream is not None:
                break
            data = self._text(batch, stream is None)
            if stream is None:
                system.create_dir(folder, recursive=True)
                stream = system.open_output_stream(f"{folder}/{name}")
            stream.write(data)
            digest.update(data)
            rows, size = rows + batch.num_rows, size + len(data)
        if stream is None:
            return Written()
        stream.close()
        return Written(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _file_system(self.path)
        system.create_dir(folder, recursive=True)
        files = [m for m in messages if isinstance(m, Written) and m.name]
        table = folder.rstrip("/").rsplit("/", 1)[-1]
        if self.overwrite:
            new = {m.name for m in files}
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.type == fs.FileType.File and old.base_name not in new:
                    system.delete_file(old.path)
        lines = [
            {"path": f"{table}/{m.name}", "source": table, "hash": m.digest[:HASH_LENGTH], "row_count": m.rows, "size_bytes": m.size}
            for m in sorted(files, key=lambda m: m.name)
        ]
        with system.open_output_stream(f"{folder}/{LISTED}") as out:
            out.write("".join(json.dumps(x) + "\n" for x in lines).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = _file_system(self.path)
        for m in messages:
            if isinstance(m, Written) and m.name:
                system.delete_file(f"{folder}/{m.name}")


class FileSource(DataSource):
    """``df.write.format("feltgrid_files").option("path", folder).option("kind", "csv" or "json")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("kind", "csv"), overwrite, schema.names)
