"""Benchmark decontamination with a positional inverted index.

The words of the corpus that also occur in the test items are stored as an index of document shards:
for each shard one row with every term's sorted positions. A query phrase is found by intersecting
offset-adjusted position lists, the term that is rarest in the whole corpus first, so that almost
every phrase is given up after one short list. Items whose rarest terms lie close together, in any order, are found
from the same lists. Nothing but index rows is read after the index exists.

Test items are handled in blocks of bounded size, each with an index of its own terms, because a
block's vocabulary is broadcast. Any number of items gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, fresh, slices, texts
from feltgrid.operators.stage import stage

WINDOW = 10
NEAR_TERMS = 4  # rarest terms of an item that have to lie close together
SPAN = 30  # words between the rarest one and each of the others, at most
BLOCK_BYTES = 8 << 20
INDEX_SCHEMA = (
    "shard long, row_ids binary, starts binary, terms binary, counts binary, positions binary"
)

#: Bytes that are no part of a word become blanks, A-Z becomes a-z, all others stay.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; digits, Latin letters and everything beyond ASCII make words."""
    return (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split()


@dataclass
class Phrases:
    """The distinct windows of one block of items, as term numbers."""

    terms: dict[bytes, int] = field(default_factory=dict)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list] = field(default_factory=list)
    vocabularies: list[tuple[object, tuple[int, ...]]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[object, str]], size: int) -> Phrases:
        out, seen = cls(), {}
        for item, text in rows:
            ids = [out.terms.setdefault(w, len(out.terms)) for w in words(text)]
            out.vocabularies.append((item, tuple(set(ids))))
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                window = tuple(ids[i : i + size])
                if window not in seen:
                    seen[window] = len(out.windows)
                    out.windows.append(window)
                    out.items.append([])
                if item not in out.items[seen[window]]:
                    out.items[seen[window]].append(item)
        return out

    def by_rarest(self, frequencies: np.ndarray) -> dict[int, list[tuple]]:
        """Windows by their rarest term in the corpus, each with its rarest-first order and its items.

        Windows with a term that the corpus does not have are left out: nothing can match them.
        """
        out: dict[int, list[tuple]] = {}
        for window, owners in zip(self.windows, self.items):
            counts = frequencies[list(window)]
            if counts.min() > 0:
                order = np.argsort(counts, kind="stable").tolist()
                out.setdefault(window[order[0]], []).append((window, order, owners))
        return out

    def probes(self, frequencies: np.ndarray, most: int) -> dict[int, list[tuple]]:
        """(terms, item) by the rarest term: each item's ``most`` rarest terms of those the corpus has.

        Equal frequencies go by the term's bytes. Items with fewer than two such terms have no probe.
        """
        names = [None] * len(self.terms)
        for name, i in self.terms.items():
            names[i] = name
        out: dict[int, list[tuple]] = {}
        for item, ids in self.vocabularies:
            terms = sorted((i for i in ids if frequencies[i] > 0), key=lambda i: (frequencies[i], names[i]))[:most]
            if len(terms) > 1:
                out.setdefault(terms[0], []).append((tuple(terms), item))
        return out


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The test items in blocks of at most ``block_bytes`` of text (or one longer item each)."""
    block, total = [], 0
    for row in items.select(F.col(item_id), F.col(text)).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and total + n > block_bytes:
            yield block
            block, total = [], 0
        block.append((row[0], row[1] or ""))
        total += n
    yield block


def positional_index(docs: DataFrame, terms: dict[bytes, int], gap: int) -> DataFrame:
    """Shards of the positional index: one row for each slice of documents a task reads.

    ``row_ids`` has the keys of the rows of ``docs`` (``_row``), ``starts`` is the shard position of each row's
    first word, with one more entry for the end; between rows lie ``gap`` unused positions, so that no
    phrase spans two rows. ``terms`` and ``counts`` list the indexed terms, ``positions`` their lists.
    """
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in slices(batches, "text"):
            starts, parts, base = [], [], 0
            for t in texts(batch, "text"):
                ids = np.array([get(w, -1) for w in words(t)], np.int32)
                starts.append(base)
                parts.append(ids)
                parts.append(np.full(gap, -1, np.int32))
                base += len(ids) + gap
            every = np.concatenate(parts) if parts else np.empty(0, np.int32)
            at = np.flatnonzero(every >= 0)
            at = at[np.argsort(every[at], kind="stable")]
            found, counts = np.unique(every[at], return_counts=True)
            rows = np.array(column(batch, "_row"), np.int64)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([int(rows[0])], pa.int64()),
                "row_ids": [rows.tobytes()],
                "starts": [np.array([*starts, base], np.int64).tobytes()],
                "terms": [found.astype(np.int32).tobytes()],
                "counts": [counts.astype(np.int32).tobytes()],
                "positions": [at.astype(np.int32).tobytes()],
            })

    return docs.select("_row", "text").mapInArrow(build, INDEX_SCHEMA)


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term in the whole corpus; the block bounds the number of terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, counts in zip(column(batch, "terms"), column(batch, "counts")):
                total[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    rows = index.select("terms", "counts").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n_terms, np.int64)
    for term, n in rows.collect():
        out[term] = n
    return out


class Shard:
    """One index row, ready for look-ups."""

    def __init__(self, row_ids: bytes, starts: bytes, terms: bytes, counts: bytes, positions: bytes):
        self.row_ids = np.frombuffer(row_ids, np.int64)
        self.starts = np.frombuffer(starts, np.int64)
        ends = np.cumsum(np.frombuffer(counts, np.int32))
        at = np.frombuffer(positions, np.int32)
        self.lists = dict(zip(np.frombuffer(terms, np.int32).tolist(), np.split(at, ends[:-1]))) if len(ends) else {}

    def phrase(self, window: tuple[int, ...], order: np.ndarray) -> np.ndarray:
        """Shard positions where the terms of ``window`` follow each other; ``order``: rarest first."""
        if any(t not in self.lists for t in window):
            return np.empty(0, np.int32)
        found = None
        for k in order:
            at = self.lists[window[k]] - k
            found = at if found is None else found[_among(found, at)]
            if not len(found):
                break
        return found

    def near(self, terms: tuple[int, ...], span: int) -> np.ndarray:
        """Positions of the first term that have all others at most ``span`` words away, in any order."""
        if any(t not in self.lists for t in terms):
            return np.empty(0, np.int32)
        found = self.lists[terms[0]]
        for t in terms[1:]:
            at = self.lists[t]
            found = found[np.searchsorted(at, found + span, "right") > np.searchsorted(at, found - span)]
        return found


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    i = np.searchsorted(sorted_values, values)
    i[i == len(sorted_values)] = 0
    return sorted_values[i] == values


def search(index: DataFrame, phrases: Phrases, frequencies: np.ndarray, near_terms: int = NEAR_TERMS, span: int = SPAN) -> DataFrame:
    """Rows (_row, hits, items, near) for rows with a window or an item near; hits are (first, last) word pairs.

    Windows and probes are filed under their rarest term, so a shard looks only at those whose rarest term it has.
    """
    shared = index.sparkSession.sparkContext.broadcast((phrases.by_rarest(frequencies), phrases.probes(frequencies, near_terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, probes = shared.value
        for batch in batches:
            for cells in zip(*(column(batch, c) for c in ("row_ids", "starts", "terms", "counts", "positions"))):
                shard = Shard(*cells)
                row_at, first, last, item_of, near_of = [], [], [], {}, {}
                for terms, item in (p for t in shard.lists if t in probes for p in probes[t]):
                    for r in np.unique(np.searchsorted(shard.starts, shard.near(terms, span), "right") - 1).tolist():
                        near_of.setdefault(r, set()).add(item)
                for window, order, owners in (w for t in shard.lists if t in windows for w in windows[t]):
                    found = shard.phrase(window, order)
                    if not len(found):
                        continue
                    rows = np.searchsorted(shard.starts, found, "right") - 1
                    row_at.append(rows)
                    first.append(found - shard.starts[rows])
                    last.append(first[-1] + len(window) - 1)
                    for r in np.unique(rows).tolist():
                        item_of.setdefault(r, set()).update(owners)
                hits: dict[int, list] = {r: [] for r in near_of}
                if row_at:
                    row_at, first, last = map(np.concatenate, (row_at, first, last))
                    by_row = np.lexsort((first, row_at))
                    row_at, first, last = (x[by_row].tolist() for x in (row_at, first, last))
                for r, a, b in zip(row_at, first, last):
                    spans = hits.setdefault(r, [])
                    if spans and a <= spans[-1]["last"] + 1:
                        spans[-1]["last"] = max(spans[-1]["last"], b)
                    else:
                        spans.append({"first": a, "last": b})
                yield pa.RecordBatch.from_pydict({
                    "_row": pa.array([int(shard.row_ids[r]) for r in hits], pa.int64()),
                    "hits": pa.array(list(hits.values()), HITS),
                    "items": pa.array([sorted(str(i) for i in item_of.get(r, ())) for r in hits], pa.list_(pa.string())),
                    "near": pa.array([sorted(str(i) for i in near_of.get(r, ())) for r in hits], pa.list_(pa.string())),
                })

    return index.mapInArrow(run, f"_row long, {FOUND}")


FOUND = "hits array<struct<first:long,last:long>>, items array<string>, near array<string>"
HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def word_counts(index: DataFrame, gap: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, starts in zip(column(batch, "row_ids"), column(batch, "starts")):
                n = np.diff(np.frombuffer(starts, np.int64)) - gap
                yield pa.RecordBatch.from_pydict({"_row": pa.array(np.frombuffer(rows, np.int64)), "n_words": pa.array(n, pa.int64())})

    return index.select("row_ids", "starts").mapInArrow(count, "_row long, n_words long")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    near_terms: int = NEAR_TERMS,
    span: int = SPAN,
) -> DataFrame:
    """``docs`` with n_words, hits, n_hit, n_items, items, near_items and contaminated for each row.

    A window is ``window`` successive words of an item, or the whole of a shorter item that has words.
    ``hits`` lists the merged (first, last) word spans that lie in windows. ``near_items`` are the items whose
    ``near_terms`` rarest terms (of those that occur in the documents, at least two) lie within ``span`` words of the
    rarest one, in any order: reworded copies, for a closer look; they do not make a row contaminated. A null text or a text
    without words has no words and no hits; items without words, or null, match nothing. Repeated rows
    are searched each for itself, and rows with a null id are kept. Columns of ``docs`` with one of
    the result's names are replaced.
    """
    results = ["n_words", "hits", "n_hit", "n_items", "items", "near_items", "contaminated"]
    docs = docs.drop(*results)
    row = fresh(docs, "_row")
    # The key of a row is its content: equal rows have equal results, and a task that runs again gives the same key.
    keyed = docs.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text)))
    indexed = keyed.select(F.col(row).alias("_row"), F.col(text).alias("text"))
    found, lengths, gap = None, None, max(window, span)
    for block in item_blocks(items, item_id, item_text, block_bytes):
        phrases = Phrases.of(block, window)
        index = stage(positional_index(indexed, phrases.terms, gap))
        lengths = word_counts(index, gap) if lengths is None else lengths
        if phrases.windows:
            part = search(index, phrases, term_frequencies(index, len(phrases.terms)), near_terms, span)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"_row long, {FOUND}")
    # Copies of a row have the same spans, and each block adds one list, no longer than the row's text.
    found = found.distinct().groupBy("_row").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), h["last"] - F.greatest(h["first"] - 1, acc["end"]))).alias("n"),
            F.greatest(acc["end"], h["last"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    lengths = lengths.groupBy("_row").agg(F.max("n_words").alias("n_words"))
    result = lengths.join(found, "_row", "left").select(
        "_row",
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<first:long,last:long>>")).alias("hits"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("near", F.array().cast("array<string>")).alias("near_items"),
    )
    result = result.withColumn("contaminated", F.col("n_hit") > 0)
    return keyed.join(result.withColumnRenamed("_row", row), row).drop(row)
