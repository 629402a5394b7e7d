"""Improbable-feature digests of texts.

A feature is a window of bytes. Each window's entropy is one of 1001 levels; how often each level occurs
in the whole corpus is counted first, and rare levels rank first. In every run of successive windows
the best-ranked one is noted, and windows noted often enough are the text's improbable features. They go
into a chain of small Bloom filters, and two digests are compared by how many bits their filters share
beyond what chance gives.

For each document the operator also digests an edited text, whose last quarter is replaced by the start
of the next document. Documents are dealt to tasks by ranges of their id, each range with a copy of the
document that follows it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts

WINDOW = 32  # bytes of a feature, and windows of a run
POPULAR = 8  # runs in which a feature must rank first
LEVELS = 1000
LOWEST_LEVEL = 180  # windows of less entropy carry no information
FILTER_BYTES = 256
FILTER_FEATURES = 160
HASHES = 5
CUTOFF = 0.3
CHUNK_BYTES = 1 << 20  # of texts held at once
RANGE_BYTES = 8 << 20  # of stored table, a few times that of text
MOST_RANGES = 10_000
JOINED_BYTES = 1 << 18
PIECE_BYTES = 32 << 10
UNIT = 1 << 24  # of sums of c log c
BASE = 0x9E3779B97F4A7C15


# --- Entropy --------------------------------------------------------------------------------


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level 0 to 1000 of the Shannon entropy of every window of ``data`` (uint8), by its start."""
    n = len(data) - WINDOW + 1
    pieces = [_levels(data[i : i + PIECE_BYTES + WINDOW - 1]) for i in range(0, n, PIECE_BYTES)]
    return np.concatenate(pieces) if pieces else np.empty(0, np.int64)


def _levels(data: np.ndarray) -> np.ndarray:
    """The levels of one piece that the processor's cache holds.

    With c(b) occurrences of byte b in a window, the entropy needs the sum of c log c. The r-th
    occurrence of a byte adds r log r - (r-1) log (r-1) in exactly those windows that start after the
    r-th last occurrence and reach the byte, which is one interval of starts: so a few difference
    arrays, one for each r, give the sums of all windows at once. Whole numbers make them exact, so the
    level of a window doesn't depend on what stands around it.
    """
    n, w = len(data), WINDOW
    order = np.argsort(data, kind="stable").astype(np.int32)
    # Equal bytes stand less than n apart, different ones at least 2 w.
    offset = data[order].astype(np.int32) * np.int32(n + 2 * w)
    at = order + offset
    total = np.zeros(n + 1, np.int64)
    which, r = np.flatnonzero(at[1:] - at[:-1] < w) + 1, 2
    while len(which):
        start_of_window = at[which] - w
        before = at[which - r]
        before[which < r] = -(1 << 30)
        first = np.maximum(np.maximum(before, start_of_window) - offset[which] + 1, 0)
        last = at[which - r + 1] - offset[which] + 1
        gain = round((r * np.log2(r) - (r - 1) * np.log2(r - 1)) * UNIT)
        total += gain * (np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last, minlength=n + 1)[: n + 1])
        which, r = which[before > start_of_window], r + 1
    sums = np.cumsum(total)[: n - w + 1]
    level = LEVELS * (1 - sums / (UNIT * w * np.log2(w)))
    return np.clip(np.rint(level), 0, LEVELS).astype(np.int64)


def level_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many windows of the whole corpus have each level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in slices(batches, text, CHUNK_BYTES):
            for t in joined([x.encode() for x in texts(batch, text)]):
                data, ends = t
                levels = entropy_levels(data)
                total += np.bincount(levels[inside(len(levels), ends)], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_pydict({"level": pa.array(range(LEVELS + 1), pa.int32()), "n": pa.array(total, pa.int64())})

    rows = docs.select(text).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS + 1, np.int64)
    for level, n in rows:
        out[level] = n
    return out


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; levels too low to say anything get no rank (-1)."""
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    ranks[:LOWEST_LEVEL] = -1
    return ranks


def joined(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts joined into arrays of bounded size, with the end of each text."""
    start = size = 0
    for i, p in enumerate([*parts, b""]):
        if i == len(parts) or (size and size + len(p) > JOINED_BYTES):
            if i > start:
                yield np.frombuffer(b"".join(parts[start:i]), np.uint8), np.cumsum([len(x) for x in parts[start:i]])
            start, size = i, 0
        size += len(p)


def inside(n_windows: int, ends: np.ndarray) -> np.ndarray:
    """Which windows of joined texts lie within one text."""
    ok = np.ones(n_windows, bool)
    for k in range(1, WINDOW):
        at = ends[:-1] - k
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


# --- Digests --------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of ``data`` that start at ``at``."""
    size = 1 << max(16, (len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return _mix((sums[at + WINDOW] - sums[at]) * down[at])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times_first(levels: np.ndarray, ok: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many runs of ``WINDOW`` successive windows each window ranks first in."""
    never = np.int64(1) << 62
    key = np.where(ok & (ranks[levels] >= 0), ranks[levels], 1 << 20) << 32
    key += np.arange(len(key))
    # Windows behind the last one of a text are never chosen, so no run reaches into the next text.
    key[~ok] = never
    best = np.concatenate([key, np.full(WINDOW - 1, never)])
    step = 1
    while step < WINDOW:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    best = best[: len(key)][ok]
    best = best[best < (np.int64(1) << 52)]
    return np.bincount(best & 0xFFFFFFFF, minlength=len(key))


class Digest:
    """Chained Bloom filters of one text: packed bits, and how many features the last one holds."""

    def __init__(self, bits: np.ndarray, features: int):
        self.bits, self.features = bits, features
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)

    def counts(self) -> np.ndarray:
        out = np.full(len(self.bits), FILTER_FEATURES)
        out[-1] = self.features - FILTER_FEATURES * (len(self.bits) - 1)
        return out

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.bits.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        features, _, bits = text.partition(":")
        return cls(np.frombuffer(base64.b64decode(bits), np.uint8).reshape(-1, FILTER_BYTES), int(features))


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best normalised overlap; 1 if equal."""
    if a.features == b.features and np.array_equal(a.bits, b.bits):
        return 1.0
    if len(a.bits) > len(b.bits):
        a, b = b, a
    m, keep = FILTER_BYTES * 8, 1 - 1 / (FILTER_BYTES * 8)
    na, nb = a.counts()[:, None] * HASHES, b.counts()[None, :] * HASHES
    chance = m * (1 - keep**na - keep**nb + keep ** (na + nb))
    most = np.minimum(a.ones[:, None], b.ones[None, :])
    common = np.empty(most.shape, np.int64)
    for i, row in enumerate(a.bits):
        common[i] = np.bitwise_count(row & b.bits).sum(axis=1, dtype=np.int64)
    cut = chance + CUTOFF * (most - chance)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((common > cut) & (most > cut), (common - cut) / (most - cut), 0.0)
    return float(min(1.0, score.max(axis=1).mean()))


def digests(parts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """The digest of each text.

    Where no window ranks first often enough, as in texts that repeat a few words, all windows that ever
    rank first are features; a text shorter than a window is its one feature as a whole.
    """
    out: list[Digest] = []
    for data, ends in joined(parts):
        levels = entropy_levels(data)
        times = times_first(levels, inside(len(levels), ends), ranks) if len(levels) else np.empty(0, np.int64)
        popular = np.flatnonzero(times >= POPULAR)
        hashes, starts = window_hashes(data, popular), ends - np.diff(ends, prepend=0)
        cuts = np.searchsorted(popular, [*starts, len(data)])
        chains = []
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            own = hashes[lo:hi]
            if not len(own):
                some = starts[i] + np.flatnonzero(times[starts[i] : ends[i]])
                own = np.unique(window_hashes(data, some))
            if not len(own):
                whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
                own = np.frombuffer(whole, np.uint64)
            chains.append(own)
        sizes = np.array([len(c) for c in chains])
        filters = -(-sizes // FILTER_FEATURES)
        first = np.cumsum(filters) - filters
        every = np.concatenate(chains)
        within = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(first, sizes) + within // FILTER_FEATURES
        table = np.zeros((int(filters.sum()), FILTER_BYTES * 8), bool)
        for k in range(HASHES):
            table[row, (every >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BYTES * 8 - 1)] = True
        packed = np.packbits(table, axis=1)
        out += [Digest(packed[f : f + n], int(s)) for f, n, s in zip(first, filters, sizes)]
    return out


# --- The operator ---------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many characters from the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges_of(docs: DataFrame) -> int:
    """A range for every ``RANGE_BYTES`` that Spark knows the table to have, ``MOST_RANGES`` at most; rows stream through a range's task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_RANGES, -(-size // RANGE_BYTES))


def _range_bounds(docs: DataFrame, parts: int) -> list:
    """Up to ``parts`` - 1 increasing ids that cut the table into ranges of similar size."""
    found = docs.select(F.expr(f"approx_percentile(doc_id, {[i / parts for i in range(1, parts)]!r}, {max(10_000, 20 * parts)})".replace("[", "array(").replace("]", ")"))).first()[0]
    return sorted(set(found or []))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Digests of each text and of its edited text, and how like the digest is to both neighbours'.

    Ids are whole numbers. The next document is the one with the next higher id, after the last the
    first. A null text is empty; rows that share an id follow each other in the order of their texts, and
    a null id comes before all others. Texts without features, and empty ones, are one feature as a
    whole. A single row is its own next document; an empty table gives no rows. ``parts`` ranges of ids (by
    default as many as the table has ``RANGE_BYTES``) bound what the driver holds: one id each.
    """
    parts = max(2, parts or _ranges_of(docs))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranks = rarity_ranks(level_counts(docs, "text"))
    bounds = np.array(_range_bounds(docs.select("doc_id"), parts), np.int64)
    least = -(1 << 63)

    def range_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, ids, "right")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            ids = np.array([least if i is None else i for i in column(batch, "doc_id")], np.int64)
            for part, i in zip(range_of(ids).tolist(), ids.tolist()):
                if i < found.get(part, 1 << 63):
                    found[part] = i
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(found), pa.int32()), "first": pa.array(list(found.values()), pa.int64())})

    rows = docs.select("doc_id").mapInArrow(firsts, "part int, first long").groupBy("part").agg(F.min("first").alias("first")).collect()
    order = sorted((part, first) for part, first in rows)
    #: The first id of a range goes also to the range before it, which has none of its successor's rows.
    before = {first: order[i - 1][0] for i, (_, first) in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * CHUNK_BYTES):
            ids = column(batch, "doc_id")
            keys = [least if i is None else i for i in ids]
            where = range_of(np.array(keys, np.int64)).tolist()
            cells = {"part": [], "extra": [], "order": [], "doc_id": [], "data": []}
            for part, key, i, t in zip(where, keys, ids, texts(batch, "text")):
                data = zlib.compress(t.encode(), 1)
                for p, extra in [(part, False)] + ([(before[key], True)] if key in before else []):
                    for k, v in zip(cells, (p, extra, key, i, data)):
                        cells[k].append(v)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(cells["part"], pa.int32()), "extra": pa.array(cells["extra"], pa.bool_()),
                "key": pa.array(cells["order"], pa.int64()), "doc_id": pa.array(cells["doc_id"], pa.int64()),
                "data": pa.array(cells["data"], pa.binary()),
            })

    dealt = (
        docs.mapInArrow(deal, "part int, extra boolean, key long, doc_id long, data binary")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "extra", "key", "data")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, part, complete = 0, None, False
        for batch in batches:
            for p, extra, i, data in zip(*(column(batch, c) for c in ("part", "extra", "doc_id", "data"))):
                if p != part:
                    held, size, part, complete = [], 0, p, False
                if complete:  # of an extra id that several rows share only the first counts
                    continue
                held.append((i, zlib.decompress(data).decode()))
                size += len(data)
                complete = extra
                if complete or size >= CHUNK_BYTES // 4:
                    if len(held) > 1:
                        yield compare(held)
                    held, size = held[-1:], 0

    def compare(held: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Rows for all held documents but the last, which is the successor of the one before."""
        changed = [edited(a[1], b[1]) for a, b in zip(held, held[1:])]
        found = digests([t.encode() for _, t in held] + [t.encode() for t in changed], ranks)
        own, other = found[: len(held)], found[len(held) :]
        n = len(changed)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([i for i, _ in held[:n]], pa.int64()),
            "n_chars": pa.array([len(t) for _, t in held[:n]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [str(d) for d in own[:n]],
            "edited_fingerprint": [str(d) for d in other],
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        })

    return dealt.mapInArrow(
        digest,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
