"""Best-fit decreasing packing of whole documents into sequences of one length, over the whole corpus.

A task tokenises the documents of its file split and keeps one small row per piece; tokens never travel.
Pieces have at most ``width`` lengths, so the histogram of lengths is bounded, and best-fit decreasing over
all pieces of the corpus needs nothing else: lengths are taken in falling order, and a segment tree over
remaining capacities gives the tightest open bin in logarithmic time. The pieces of one length that meet bins of one
capacity are placed as a run, which gives the bins that placing them one by one would give; runs end with
lengths and capacities, so their number is bounded by ``width`` as well. A piece then finds its bin from its
length and its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts
from feltgrid.llm.tokens import encoder
from feltgrid.operators.stage import stage

WIDTH = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
SLICE_BYTES = 4 << 20


class Bins(NamedTuple):
    """Bins with successive numbers and one remaining capacity."""

    first: int
    count: int


class Run(NamedTuple):
    """``count`` pieces from number ``rank`` of their length on, ``each`` to a bin, behind ``offset`` ids."""

    rank: int
    count: int
    each: int
    first: int
    offset: int


class Capacities:
    """Open bins by remaining capacity, under a segment tree of the number of entries of each capacity."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[Bins]] = [[] for _ in range(width + 1)]

    def _count(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, capacity: int, bins: Bins) -> None:
        """Full bins and empty lists of bins are not kept."""
        if capacity and bins.count:
            self.bins[capacity].append(bins)
            self._count(capacity, 1)

    def take(self, capacity: int) -> Bins:
        self._count(capacity, -1)
        return self.bins[capacity].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open bin."""
        node = least + self.leaves
        if self.tree[node]:
            return least
        # Up to the first subtree on the right that is not empty, then down its left edge.
        while node > 1 and (node & 1 or not self.tree[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_decreasing(counts: dict[int, int], width: int) -> tuple[dict[int, list[Run]], int]:
    """Runs of each length, and the number of bins, for ``counts`` pieces of each length.

    A bin that took a piece and still has room for one of the same length is the tightest for it, so one bin
    takes ``capacity // length`` of them before the next bin of that capacity is touched.
    """
    open_bins, plan, used = Capacities(width), {}, 0
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank, runs = counts[length], 0, []
        while left:
            capacity = open_bins.tightest(length)
            if capacity is None:
                capacity, bins = width, Bins(used, -(-left // (width // length)))
                used += bins.count
            else:
                bins = open_bins.take(capacity)
            each = capacity // length
            full, over = min(bins.count, left // each), 0
            if full < bins.count:
                over = min(left - full * each, each)
            taken = full * each + over
            runs.append(Run(rank, taken, each, bins.first, width - capacity))
            open_bins.put(capacity - each * length, Bins(bins.first, full))
            open_bins.put(capacity, Bins(bins.first + full + bool(over), bins.count - full - bool(over)))
            if over:
                open_bins.put(capacity - over * length, Bins(bins.first + full, 1))
            left, rank = left - taken, rank + taken
        plan[length] = runs
    return plan, used


def pieces(docs: DataFrame, path: str, width: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece with its place among the pieces of its length in its task."""
    kind_name = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, met = encoder(path).ids_with_added, np.array([end_id], "<u4"), np.zeros(width + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in slices(batches, "text", SLICE_BYTES):
            kind = batch.schema.field("doc_id").type
            keys, numbers, starts, lengths, sums, blobs = [], [], [], [], [], []
            for key, t in zip(column(batch, "doc_id"), texts(batch, "text")):
                ids = np.concatenate([encode(t), end])
                cuts = [0, *range(len(ids) % width or width, len(ids) + 1, width)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    data = ids[a:b].tobytes()
                    keys.append(key)
                    numbers.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(data))
                    blobs.append(data if with_ids else None)
            sizes, order = np.array(lengths, np.int64), np.argsort(lengths, kind="stable")
            first = np.searchsorted(sizes[order], sizes[order])
            rank = np.empty(len(sizes), np.int64)
            rank[order] = np.arange(len(sizes)) - first
            rank += met[sizes]
            met += np.bincount(sizes, minlength=width + 1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, kind), "piece": pa.array(numbers, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(sizes),
                "ids_crc32": pa.array(sums, pa.int64()), "ids": pa.array(blobs, pa.binary()), "task": pa.array([task] * len(sizes), pa.int32()), "rank": pa.array(rank),
            })

    return docs.mapInArrow(run, f"doc_id {kind_name}, piece int, start long, length long, ids_crc32 long, ids binary, task int, rank long")


def place(numbered: DataFrame, plan: dict[int, list[Run]]) -> DataFrame:
    """``numbered`` pieces, by length and rank over the corpus, with sequence_id and offset."""
    names = [c for c in numbered.columns if c not in ("task", "rank")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name in names)
    flat = sorted((length, r) for length, runs in plan.items() for r in runs)
    lengths = np.array([n for n, _ in flat], np.int64)
    runs = np.array([r for _, r in flat], np.int64).reshape(-1, len(Run._fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(lengths, np.arange(int(lengths.max(initial=0)) + 2))
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(part):
                    lo, hi = begin[size[part[0]]], begin[size[part[0]] + 1]
                    row[part] = lo + np.searchsorted(runs[lo:hi, 0], rank[part], "right") - 1
            at, _, each, first, offset = runs[row].T
            inside = rank - at
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first + inside // each), pa.array(offset + inside % each * size)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_best_fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, width: int = WIDTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; ``ids`` too if asked for.

    Documents of more than ``width`` ids are cut from the end, so only their first piece may be shorter. A
    null or empty text is the end id alone; a null id is kept; repeated rows are packed each for itself;
    other columns are left out. Sequences are numbered from 0. An empty table gives no rows.
    The driver sees the histogram of lengths only, ``width`` rows at most.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    found = stage(pieces(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), path, width, end_id, with_ids))
    sizes = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    plan, _ = best_fit_decreasing({r.length: r["count"] for r in found.groupBy("length").count().collect()}, width)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = found.join(base, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return place(numbered.select(*columns, "rank"), plan)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids): the ids of each sequence as little-endian 32-bit numbers, from pieces with ids.

    A sequence has at most ``width`` ids, which bounds the group.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda out, p: F.concat(out, p))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
