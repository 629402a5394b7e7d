"""CSV with line breaks inside quotes, read in byte ranges.

Spark cuts text files into ranges of whole lines, which may begin inside a quoted field. A first pass counts the
quotes of each range; their running parity tells each range whether it begins inside quotes. A second
pass joins the lines of each record within its range. A record that a cut goes through leaves a piece in each
range it touches; a third pass, over the files that have such records only, puts the pieces together.

Quotes follow RFC 4180: a field that holds a quote is quoted, and the quote doubled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE_SHIFT = 43  # of a file's number in a position; below it the range's first byte plus the line's number in it
MARK = "﻿"
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}

Ranges = dict[str, dict[int, int]]


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, path, start): every line with its range. A carriage return stays at its line's end.

    Ranges must be the same in each pass, so the number of partitions that Spark aims at, by default that of the
    cores at hand, is held for the session.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def range_parities(lines: DataFrame) -> tuple[Ranges, set[str]]:
    """Whether each range begins inside quotes, by file and first byte, and the files with a record in several ranges.

    A row per range comes to the driver, a ten-millionth of the data.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    counts = lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    ranges: Ranges = {}
    cut, inside, last = set(), 0, None
    for path, start, odd in sorted(map(tuple, counts.collect())):
        inside = inside if path == last else 0
        last = path
        if inside:
            cut.add(path)
        ranges.setdefault(path, {})[start] = inside
        inside ^= odd
    return ranges, cut


class _Range:
    """Joins the lines of one range to records."""

    def __init__(self, inside: int, place: int):
        self.inside, self.place, self.lines = inside, place, 0
        self.head = bool(inside)  # before the end of a record that began in an earlier range
        self.open: list[str] = []
        self.open_at = place

    def add(self, values: pa.Array) -> Iterator[tuple[int, int, str]]:
        """(kind, place, text) of records (0) and of the last piece of an earlier range's record (2)."""
        flips = np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)) + self.inside
        ends = np.flatnonzero(flips % 2 == 0)
        texts, at = values.to_pylist(), 0
        for end in ends.tolist():
            if not self.open:
                self.open_at = self.place + self.lines + at
            self.open += texts[at : end + 1]
            yield (2 if self.head else 0), self.open_at, "\n".join(self.open)
            self.open, self.head, at = [], False, end + 1
        if at < len(texts):
            if not self.open:
                self.open_at = self.place + self.lines + at
            self.open += texts[at:]
        self.inside, self.lines = int(flips[-1] % 2), self.lines + len(texts)

    def rest(self) -> Iterator[tuple[int, int, str]]:
        """The first piece (1) of a record that goes on, or a range (2) within one record."""
        if self.open:
            yield (2 if self.head else 1), self.open_at, "\n".join(self.open)


def _pieces(lines: DataFrame, ranges: Ranges, whole: bool) -> DataFrame:
    """(kind, place, path, text): whole records, or else the pieces of cut ones."""
    numbers = {path: i for i, path in enumerate(sorted(ranges))}
    shared = lines.sparkSession.sparkContext.broadcast((ranges, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, numbers = shared.value
        key, here, out, size = None, None, [], 0
        for batch in batches:
            values, starts = batch.column(0), batch.column(2).to_numpy()
            codes = batch.column(1).dictionary_encode()
            same = np.append(True, (starts[1:] != starts[:-1]) | (np.diff(codes.indices.to_numpy()) != 0))
            bounds = [*np.flatnonzero(same).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                path, start = batch.column(1)[a].as_py(), int(starts[a])
                found = []
                if (path, start) != key:
                    if here is not None:
                        found += [(*x, key[0]) for x in here.rest()]
                    if start not in ranges.get(path, ()):
                        raise RuntimeError(f"{path} is cut in other ranges than before: settings of file splits have changed")
                    key, here = (path, start), _Range(ranges[path][start], (numbers[path] << FILE_SHIFT) + start)
                found += [(*x, path) for x in here.add(values.slice(a, b - a))]
                out += [x for x in found if (x[0] == 0) == whole]
                size += sum(len(x[2]) for x in found)
                if size > 4 << 20:
                    yield listed(out)
                    out, size = [], 0
        if here is not None:
            out += [(*x, key[0]) for x in here.rest() if (x[0] == 0) == whole]
        if out:
            yield listed(out)

    def listed(rows: list) -> pa.RecordBatch:
        kind, place, text, path = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(place, pa.int64()), pa.array(path, pa.string()), pa.array(text, pa.string())], ["kind", "place", "path", "text"])

    return lines.mapInArrow(run, "kind int, place long, path string, text string")


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(place, path, text) of every record of every file, headers too; places rise in the order of paths and lines."""
    lines = read_lines(spark, paths)
    ranges, cut = range_parities(lines)
    records = _pieces(lines, ranges, True).select("place", "path", "text")
    if not cut:
        return records
    # A condition on the path alone would prune files, and with them change the ranges.
    of_cut = F.when(F.length("value") >= 0, F.col("path").isin(sorted(cut)))
    pieces = _pieces(lines.filter(of_cut), ranges, False)
    # A record's pieces are neighbours in its file; each has one first piece.
    number = F.sum((F.col("kind") == 1).cast("int")).over(W.partitionBy("path").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"])
    joined = pieces.withColumn("_number", number).groupBy("path", "_number").agg(F.min("place").alias("place"), F.array_join(parts, "\n").alias("text"))
    return records.unionByName(joined.select("place", "path", "text"))


def read_csv(spark: SparkSession, paths: str | Sequence[str], position: str | None = None, path: str | None = None) -> DataFrame:
    """All-text CSV scan: header, byte-order mark, doubled quotes, line breaks in quotes, files of any size in many tasks.

    ``position`` and ``path`` name columns for each row's place (rising with file name and line) and its file. The
    columns are those of the first file; every file has its own header. Empty lines are left out.
    """
    files = sorted(spark.read.text([paths] if isinstance(paths, str) else list(paths)).inputFiles())
    records = read_records(spark, files)
    first = spark.read.option("header", True).options(**OPTIONS).csv(files[0]).columns if files else []
    names = [c.lstrip(MARK).strip() for c in first]
    schema = ", ".join(f"_{i} string" for i in range(len(names))) or "_0 string"
    header = F.col("place").bitwiseAND(F.lit((1 << FILE_SHIFT) - 1)) == 0
    body = records.filter(~header & (F.trim(F.translate("text", "\r", "")) != "")).withColumn("text", F.regexp_replace("text", "\r$", ""))
    cells = body.withColumn("_cells", F.from_csv("text", F.lit(schema), {**OPTIONS, "mode": "PERMISSIVE"}))
    kept = [F.col("_cells")[f"_{i}"].alias(n) for i, n in enumerate(names)]
    return cells.select(*kept, *([F.col("place").alias(position)] if position else []), *([F.col("path").alias(path)] if path else []))
