"""Exact Jaccard join of documents by word shingles, as a join in a metric space.

Jaccard distance is a metric, so two linked documents (distance at most ``eps``) have distances to any
pivot that differ by at most ``eps``. A region of documents is cut at pivots: each document belongs to the
cell of its nearest pivot, and is copied to every cell whose pivot is at most ``2 eps`` farther away. Two
linked documents then meet in both their home cells, and the cells are joined recursively.

Pivots alone cannot cut a corpus: unrelated texts all have distance 1 from each other and from any pivot.
The first regions therefore come from set partitioning, which is exact too. Shingles are dealt to m parts
by hash, and two linked sets differ in at most k shingles, so they agree on at least m - k whole parts. Sets
with an equal part form a region; an upper bound of their similarity from bucket counts drops most chance
meetings; what remains connected is one region of the metric join.

Equal sets are one representative from the start. Within a region links are returned as a spanning forest
with the number of links of each document, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feltgrid.llm.frames import column, fresh, slices, texts
from feltgrid.llm.graph import connected_components
from feltgrid.operators.stage import stage

PIVOTS = 16
REGION_BYTES = 16 << 20  # of shingles that one task joins at once
REGION_SETS = 2_048
LEAF = 96  # sets that are compared without further pivots
FOREST_SETS = 4_096  # sets of a chance region that one task compares by their counts
FOREST_BYTES = 16 << 20  # of their counts
SPREAD = 4  # tasks that measure a region at its pivots, for each region that would fit into one
CHUNK_SIGNATURES = 1_500_000
BUCKETS_PER_PARTITION = 4
COLUMNS = 4_096
CACHE_WORDS = 400_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass(frozen=True)
class Link:
    """Documents link when ``whole * intersection >= part * union`` over shingles of ``words`` words."""

    words: int
    part: int
    whole: int

    @property
    def eps(self) -> float:
        return 1 - self.part / self.whole

    def links(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = np.asarray(common, np.int64)
        return (self.whole * common >= self.part * (np.asarray(a) + np.asarray(b) - common)) & (common > 0)

    def most_different(self, size: int) -> int:
        """Largest symmetric difference of two linked sets of at most ``size`` shingles."""
        return 2 * size * (self.whole - self.part) // (self.whole + self.part)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII white space cuts, A-Z is lower-cased."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, _U)
    w = np.array([hashes[t] for t in tokens], _U)
    n = min(words, len(w))
    out = np.full(len(w) - n + 1, n, _U)
    for k in range(n):
        out = mix(out * _U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(out)


# --- Set partitioning -----------------------------------------------------------------------


@lru_cache(maxsize=8)
def class_bounds(part: int, whole: int) -> np.ndarray:
    """Lower bounds of size classes: linked sets are in the same class or in neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * whole // part + 1)
    return np.array(bounds)


@lru_cache(maxsize=4096)
def parts_of(link: Link, size_class: int) -> tuple[int, int]:
    """Number of parts for pairs whose larger set is in a class, and parts that may agree by being empty.

    A tenth more parts than needed means that linked sets agree on more than one; so a set with few empty
    parts need not list them, as one of the others agrees too.
    """
    largest = int(class_bounds(link.part, link.whole)[size_class + 1]) - 1
    most = link.most_different(largest)
    spare = -(-most // 10)
    return most + 1 + spare, spare


def signatures(sets: list[np.ndarray], link: Link) -> tuple[np.ndarray, np.ndarray]:
    """(signature, position in ``sets``) of all parts of all sets, for their own class and the next one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    classes = np.searchsorted(class_bounds(link.part, link.whole), sizes, "right") - 1
    every = np.concatenate(sets) if sets else np.empty(0, _U)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out, of = [], []
    for step in (0, 1):
        shape = [parts_of(link, int(c) + step) if n else (0, 0) for c, n in zip(classes, sizes)]
        m = np.array([x for x, _ in shape], np.int64)
        spare = np.array([x for _, x in shape], np.int64)
        first = np.cumsum(m) - m
        slot = first[owner] + (mix(every + _U(77)) % m[owner].astype(_U)).astype(np.int64)
        filled = np.bincount(slot, minlength=int(m.sum())) > 0
        sums = np.zeros(int(m.sum()), _U)
        np.add.at(sums, slot, mix(every))
        who = np.repeat(np.arange(len(sets)), m)
        place = (np.arange(len(who)) - first[who]).astype(_U)
        kind = mix((classes[who] + step).astype(_U) * _U(0x9E3779B97F4A7C15) + place)
        empty = np.bincount(who[~filled], minlength=len(sets))
        use = filled | (empty > spare)[who]
        out.append(mix(sums ^ kind)[use])
        of.append(who[use])
    return np.concatenate(out), np.concatenate(of)


def bucket_counts(shingle_set: np.ndarray) -> np.ndarray:
    """Shingles in each of a power-of-two number of hash buckets, about four in a bucket."""
    bits = max(4, (len(shingle_set) // 4).bit_length())
    return np.bincount((mix(shingle_set + _U(5)) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits).clip(max=65535).astype(np.uint16)


def may_link_forest(counts: list[np.ndarray], sizes: np.ndarray, link: Link) -> list[tuple[int, int]]:
    """A spanning forest over all pairs of sets that may link, by their bucket counts.

    No more shingles can be common than the smaller count of each bucket, so a pair is left out only if it
    cannot link. Each set is compared with all before it at once.
    """
    buckets = min(map(len, counts))
    table = np.stack([c.reshape(buckets, -1).sum(axis=1, dtype=np.int32) for c in counts])
    full = np.array([c.max() == 65535 for c in counts])
    group = np.arange(len(counts))
    edges = []
    for j in range(1, len(counts)):
        bound = np.minimum(table[:j], table[j]).sum(axis=1)
        bound = np.where(full[:j] | full[j], np.minimum(sizes[:j], sizes[j]), bound)
        for g in np.unique(group[:j][link.links(bound, sizes[:j], sizes[j])]).tolist():
            if g != group[j]:
                edges.append((j, g))
                low, high = sorted((g, int(group[j])))
                group[group == high] = low
    return edges


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


# --- The metric join within a region --------------------------------------------------------


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices a few columns at a time."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[token] > 1
    token, owner = token[shared], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = np.unique(token[order], return_inverse=True)[1], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    n = int(token[-1]) + 1 if len(token) else 0
    for lo in range(0, n, COLUMNS):
        a, b = np.searchsorted(token, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, n - lo)), np.float32)
        m[owner[a:b], token[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def join_region(sets: list[np.ndarray], home: np.ndarray, weight: np.ndarray, side: np.ndarray, link: Link, forest: Forest | None = None,
                at: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of a region as a spanning forest, and for each home set the weight of the sets it links to.

    ``side`` is 0 for an ordinary region; where it is 1 or 2, only sets of different sides are counted.
    Larger regions are cut at pivots as long as the cells get smaller.
    """
    at = np.arange(len(sets)) if at is None else at
    forest = forest or Forest(len(sets))
    sizes = np.array([len(sets[i]) for i in at])
    counted = np.zeros(len(sets))
    edges: list[tuple[int, int]] = []
    if len(at) > LEAF:
        pivots = at[:: max(1, len(at) // PIVOTS)][:PIVOTS]
        far = np.stack([distances(sets[p], [sets[i] for i in at]) for p in pivots], axis=1)
        near = far.argmin(1)
        reach = far <= far.min(1)[:, None] + 2 * link.eps + 1e-9
        if reach.sum(0).max() < 0.8 * len(at):
            for c in range(len(pivots)):
                inside = np.flatnonzero(reach[:, c])
                if len(inside) > 1:
                    cell_home = np.zeros(len(sets), bool)
                    cell_home[at[near == c]] = home[at[near == c]]
                    more, counts = join_region(sets, cell_home, weight, side, link, forest, at[inside])
                    edges += more
                    counted += counts
            return edges, counted
    common = intersections([sets[i] for i in at])
    hit = link.links(common, sizes[:, None], sizes[None, :])
    np.fill_diagonal(hit, False)
    for i, j in zip(*np.nonzero(np.triu(hit))):
        if forest.join(int(at[i]), int(at[j])):
            edges.append((int(at[i]), int(at[j])))
    own_side = side[at]
    hit &= (own_side[:, None] != own_side[None, :]) | (own_side == 0)[:, None]
    counted[at] += np.where(home[at], hit @ weight[at], 0)
    return edges, counted


def overlaps(pivot: np.ndarray, every: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shingles that sets have in common with a pivot; ``every`` is the sets one after the other."""
    k = np.searchsorted(pivot, every)
    k[k == len(pivot)] = 0
    return np.add.reduceat((pivot[k] == every).astype(np.int64), np.cumsum(sizes) - sizes)


def distances(pivot: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard distances of sets to a pivot."""
    sizes = np.array([len(s) for s in sets])
    common = overlaps(pivot, np.concatenate(sets), sizes)
    return 1 - common / (sizes + len(pivot) - common)


def pivot_stars(ids: list[int], pivots: list[np.ndarray], link: Link) -> np.ndarray:
    """For each pivot the smallest id of the pivots that links among pivots reach from it."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sizes = np.array([len(pivots[i]) for i in order])
    every, forest = np.concatenate([pivots[i] for i in order]), Forest(len(order))
    for k, i in enumerate(order):
        for j in np.flatnonzero(link.links(overlaps(pivots[i], every, sizes), len(pivots[i]), sizes)).tolist():
            forest.join(k, j)
    out = np.empty(len(ids), np.int64)
    out[order] = [ids[order[forest.root(k)]] for k in range(len(order))]
    return out


# --- The distributed join -------------------------------------------------------------------


def _frame(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def describe(docs: DataFrame, link: Link) -> DataFrame:
    """(_row, n, digest, counts) of every row: size, a 128-bit digest of the set, and bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sets = [shingles(t, link.words, hashes) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("_row")), batch.column(batch.schema.get_field_index("doc_id")),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]),
                pa.array([bucket_counts(s).tobytes() for s in sets], pa.binary()),
            ], ["_row", "doc_id", "n", "digest", "counts"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_row long, doc_id {key}, n long, digest string, counts binary")


def region_members(docs: DataFrame, link: Link, partitions: int) -> DataFrame:
    """Distinct (region, _row): rows whose sets agree on a whole part, several regions for a row.

    Signatures travel packed, a few thousand in a row for each bucket of their upper bits; a set that a
    task meets again is not listed twice, so copies add at most one entry for each task.
    """
    buckets = 1 << max(4, (partitions * BUCKETS_PER_PARTITION - 1).bit_length())
    shift = _U(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, rows, seen, size = WordHashes(), [], [], set(), 0
        for batch in slices(batches, "text", 2 << 20):
            for row, t in zip(column(batch, "_row"), texts(batch, "text")):
                s = shingles(t, link.words, hashes)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or digest in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(digest)
                held.append(s)
                rows.append(row)
                size += len(s)
            if size >= CHUNK_SIGNATURES:
                yield packed(held, rows)
                held, rows, size = [], [], 0
        if held:
            yield packed(held, rows)

    def packed(sets: list[np.ndarray], rows: list[int]) -> pa.RecordBatch:
        sig, of = signatures(sets, link)
        order = np.argsort(sig >> shift, kind="stable")
        sig, of = sig[order], of[order]
        cut = np.searchsorted(sig >> shift, np.arange(buckets + 1, dtype=_U))
        some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        rows = np.array(rows, np.int64)
        return _frame({
            "bucket": (some, pa.int32()),
            "signatures": ([sig[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
            # Positions grow within a bucket, so their differences are small numbers that compress well.
            "steps": ([np.diff(of[cut[b] : cut[b + 1]], prepend=0).astype(np.int32).tobytes() for b in some], pa.binary()),
            "rows": ([rows[np.unique(of[cut[b] : cut[b + 1]])].tobytes() for b in some], pa.binary()),
        })

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sigs, owners = None, [], []
        for batch in batches:
            for b, s, d, r in zip(*(column(batch, c) for c in ("bucket", "signatures", "steps", "rows"))):
                if b != bucket and sigs:
                    yield from members(np.concatenate(sigs), np.concatenate(owners))
                    sigs, owners = [], []
                bucket = b
                of = np.cumsum(np.frombuffer(d, np.int32))
                sigs.append(np.frombuffer(s, _U))
                owners.append(np.frombuffer(r, np.int64)[np.unique(of, return_inverse=True)[1]])
        if sigs:
            yield from members(np.concatenate(sigs), np.concatenate(owners))

    def members(sig: np.ndarray, owner: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((owner, sig))
        sig, owner = sig[order], owner[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
        sig, owner = sig[fresh], owner[fresh]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        length = np.diff(np.append(start, len(sig)))
        several = np.repeat(length > 1, length)
        if several.any():
            # A region is named by its members: copies that agree on many parts meet once.
            name = np.add.reduceat(mix(owner.astype(_U)), start)
            region = np.repeat(mix(name), length)[several].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"region": pa.array(region), "_row": pa.array(owner[several])})

    found = docs.select("_row", "text").mapInArrow(run, "bucket int, signatures binary, steps binary, rows binary")
    dealt = found.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "region long, _row long").distinct()


def in_groups(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of successive equal keys; the input is sorted by ``key``."""
    current, rows = None, []
    for batch in batches:
        for k, *row in zip(*(column(batch, c) for c in [key, *names])):
            if k != current and rows:
                yield current, rows
                rows = []
            current = k
            rows.append(tuple(row))
    if rows:
        yield current, rows


def split_regions(members: DataFrame, most: int = FOREST_SETS, most_bytes: int = FOREST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Star edges (a, b) of the regions of more than ``most`` sets, and the members of all others.

    Where ``members`` have sizes ``n``, regions whose counts may take more than ``most_bytes`` are large too; the
    counts of a set take about ``n`` bytes at most. Sizes are combined before the shuffle. At most one member row in ``most`` is a row of the large regions'
    table, which is staged, so Spark broadcasts it and no large region meets in one task.
    """
    members = stage(members)
    held = F.sum(F.col("n") + 32) if "n" in members.columns else F.lit(0)
    sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.min("_row").alias("b"), held.alias("bytes"))
    # A region of two sets is always compared.
    large = stage(sizes.filter((F.col("sets") > most) | (F.col("bytes") > most_bytes) & (F.col("sets") > 2)).select("region", "b"))
    stars = members.join(large, "region").filter(F.col("_row") != F.col("b")).select(F.col("_row").alias("a"), "b")
    return stars, members.join(large.select("region"), "region", "left_anti")


def candidate_edges(members: DataFrame, described: DataFrame, link: Link) -> DataFrame:
    """Edges that connect all sets of a region that may link; a spanning forest for each region.

    Regions of more than ``FOREST_SETS`` sets or ``FOREST_BYTES`` of counts are connected without a look at their counts: the metric join
    cuts them at pivots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in in_groups(batches, "region", ["_row", "n", "counts"]):
            ids = [r[0] for r in rows]
            counts = [np.frombuffer(r[2], np.uint16) for r in rows]
            for j, i in may_link_forest(counts, np.array([r[1] for r in rows]), link):
                a.append(ids[j])
                b.append(ids[i])
            if len(a) >= 50_000:
                yield _frame({"a": (a, pa.int64()), "b": (b, pa.int64())})
                a, b = [], []
        yield _frame({"a": (a, pa.int64()), "b": (b, pa.int64())})

    stars, small = split_regions(members)
    rows = small.select("region", "_row").join(described.select("_row", "n", "counts"), "_row")
    forests = rows.repartition("region").sortWithinPartitions("region", "_row").mapInArrow(run, "a long, b long")
    return forests.unionByName(stars).distinct()


REGIONS = "region long, _row long, weight long, home boolean, side int, tokens binary"
MEASURED = REGIONS + ", pivot array<long>, pivot_star array<long>, far array<double>, star long, bytes long"


def join_small(regions: DataFrame, link: Link) -> DataFrame:
    """Links and link counts of regions that each fit into a task: rows (a, b, n), b null for a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in in_groups(batches, "region", ["_row", "weight", "home", "side", "tokens"]):
            ids = [r[0] for r in rows]
            sets = [np.frombuffer(r[4], _U) for r in rows]
            edges, counts = join_region(sets, np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[3] for r in rows]), link)
            some = np.flatnonzero(counts)
            yield _frame({
                "a": ([ids[i] for i, _ in edges] + [ids[i] for i in some], pa.int64()),
                "b": ([ids[j] for _, j in edges] + [None] * len(some), pa.int64()),
                "n": ([None] * len(edges) + counts[some].astype(np.int64).tolist(), pa.int64()),
            })

    sets = regions.select(*(n.split()[0] for n in REGIONS.split(", ")))
    return sets.repartition("region").sortWithinPartitions("region", "_row").mapInArrow(run, "a long, b long, n long")


def measure(regions: DataFrame, link: Link) -> DataFrame:
    """The sets of each region with their distances ``far`` to all pivots of the region.

    A region's sets are spread over ``salts`` tasks, a column of ``regions``, and its pivots are copied to each.
    ``star`` names the sets that are known to be connected through links to pivots and among them: the nearest
    pivot's ``pivot_star`` if the set links to it, else the set itself.
    """
    order = W.partitionBy("region").orderBy(F.xxhash64("_row", "region"), "_row")
    ranked = regions.filter(F.col("home")).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= PIVOTS)
    pivots = ranked.withColumn("_salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))))
    spread = regions.withColumns({"_rank": F.lit(0), "_salt": F.pmod(F.xxhash64("_row"), F.col("salts")).cast("int")})
    both = pivots.unionByName(spread).repartition("region", "_salt").sortWithinPartitions("region", "_salt", F.desc("_rank"), "_row")
    names = [n.split()[0] for n in REGIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, pivots = None, [], []
        for batch in slices(batches, "tokens"):
            rows, sets = column(batch, "_row"), [np.frombuffer(t, _U) for t in column(batch, "tokens")]
            keys = list(zip(column(batch, "region"), column(batch, "_salt"), (r > 0 for r in column(batch, "_rank"))))
            taken, found = [], []
            for (region, salt, is_pivot), at in groupby(range(len(keys)), keys.__getitem__):
                at = list(at)
                if (region, salt) != here:
                    here, ids, pivots = (region, salt), [], []
                if is_pivot:
                    ids += [rows[i] for i in at]
                    pivots += [sets[i] for i in at]
                    continue
                sizes, every = np.array([len(sets[i]) for i in at]), np.concatenate([sets[i] for i in at])
                common = np.stack([overlaps(p, every, sizes) for p in pivots], axis=1)
                lengths = np.array([len(p) for p in pivots])
                far = 1 - common / (sizes[:, None] + lengths - common)
                nearest, stars = far.argmin(1), pivot_stars(ids, pivots, link)
                linked = link.links(common[np.arange(len(at)), nearest], sizes, lengths[nearest])
                taken += at
                found.append((np.tile(ids, len(at)), np.tile(stars, len(at)), far.ravel(), np.where(linked, stars[nearest], [rows[i] for i in at]),
                              np.full(len(at), len(ids))))
            if not taken:
                continue
            ids_of, stars_of, far_of, star, times = map(np.concatenate, zip(*found))
            offsets = pa.array(np.append(0, np.cumsum(times)), pa.int32())
            kept = batch.select(names).take(pa.array(taken))
            yield pa.RecordBatch.from_arrays([
                *kept.columns, *(pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((ids_of, pa.int64()), (stars_of, pa.int64()), (far_of, pa.float64()))),
                pa.array(star, pa.int64()), pa.array([8 * len(sets[i]) for i in taken], pa.int64()),
            ], [n.split()[0] for n in MEASURED.split(", ")])

    return both.mapInArrow(run, MEASURED)


def star_edges(measured: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that links connect: from each set to the stars of the pivots it links to.

    The nearest pivot is linked if any is; links to others than its star are found among the cells.
    """
    return measured.filter(F.col("star") != F.col("_row")).select(F.col("_row").alias("a"), F.col("star").alias("b"))


def open_sets(measured: DataFrame, link: Link) -> DataFrame:
    """``measured`` without sets that cannot link to a set outside their own star.

    A set at distance r from its pivot links to nothing that is farther than r + eps from that pivot; no set
    outside the star is nearer to one of its pivots than the smallest such distance, taken for each star.
    """
    pivots = F.explode(F.arrays_zip("pivot_star", "far"))
    outside = measured.select("region", "star", pivots.alias("p")).filter(F.col("p.pivot_star") != F.col("star"))
    nearest = stage(outside.groupBy("region", F.col("p.pivot_star").alias("star")).agg(F.min("p.far").alias("_outside")))
    stars = measured.join(nearest, ["region", "star"], "left")
    alone = (F.col("star") == F.col("_row")) & ~F.array_contains("pivot_star", F.col("_row"))
    # A set that links to no pivot stays; a star without any set outside it is the whole region.
    stays = alone | (F.array_min("far") + link.eps + 1e-9 >= F.col("_outside"))
    return stars.filter(F.coalesce(stays, F.lit(False))).drop("_outside")


def cells_of(measured: DataFrame, link: Link) -> DataFrame:
    """The cells of each region, their ``parent``: a set's home is its nearest pivot, and it is copied to those within twice eps more."""
    pivots = F.arrays_zip("far", "pivot")
    reach = F.filter(pivots, lambda p: p["far"] <= F.array_min("far") + 2 * link.eps + 1e-9)
    cells = measured.withColumns({"parent": F.col("region"), "_nearest": F.array_min(pivots)["pivot"], "_cell": F.explode(reach)})
    return cells.select(
        "parent", F.xxhash64("region", "_cell.pivot").alias("region"), "_row", "weight",
        (F.col("home") & (F.col("_cell.pivot") == F.col("_nearest"))).alias("home"), "side", "tokens", "star", "bytes",
    )


def in_block_pairs(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regions that pivots do not cut, as pairs of blocks: every two sets meet in exactly one task."""
    rows = regions.join(blocks, "region").withColumn("_own", F.pmod(F.xxhash64("_row"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, F.lit(0)).when(F.col("_own") == low, F.lit(1)).otherwise(F.lit(2))
    return rows.select(F.xxhash64("region", low, high, F.lit("pair")).alias("region"), "_row", "weight", "home", side.cast("int").alias("side"), "tokens")


def beside_largest_star(measured: DataFrame, stuck: DataFrame, region_bytes: int, region_sets: int) -> DataFrame:
    """Regions that pivots do not cut, without the pairs within their largest star, which are connected already.

    The other sets meet each other in pairs of blocks, and each of their blocks meets every block of the star.
    """
    rows = measured.join(stuck.select("region"), "region")
    stars = rows.groupBy("region", "star").agg(F.count(F.lit(1)).alias("sets"), F.sum("bytes").alias("bytes"))
    totals = stars.groupBy("region").agg(
        F.max(F.struct("sets", "star", "bytes")).alias("top"), F.sum("sets").alias("sets"), F.sum("bytes").alias("bytes")
    )

    def blocks(sets: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(2 * sets / region_sets), F.ceil(2 * size / region_bytes)).cast("int")

    plan = stage(totals.select(
        "region", F.col("top.star").alias("_star"), blocks(F.col("top.sets"), F.col("top.bytes")).alias("inner"),
        blocks(F.col("sets") - F.col("top.sets"), F.col("bytes") - F.col("top.bytes")).alias("blocks"),
    ))
    rows = rows.join(plan, "region")
    others = rows.filter(F.col("star") != F.col("_star"))
    own = F.pmod(F.xxhash64("_row"), F.when(F.col("star") == F.col("_star"), F.col("inner")).otherwise(F.col("blocks"))).cast("int")
    width = F.when(F.col("star") == F.col("_star"), F.col("blocks")).otherwise(F.col("inner"))
    met = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), width - 1)))
    inner, outer = F.when(F.col("star") == F.col("_star"), F.col("_own")).otherwise(F.col("_other")), F.when(
        F.col("star") == F.col("_star"), F.col("_other")).otherwise(F.col("_own"))
    across = met.select(F.xxhash64("region", inner, outer, F.lit("star")).alias("region"), "_row", "weight", "home", F.lit(0).alias("side"), "tokens")
    return across.unionByName(in_block_pairs(others.drop("_star", "inner", "blocks"), plan.select("region", "blocks")))


def metric_join(
    regions: DataFrame, link: Link, region_bytes: int = REGION_BYTES, region_sets: int = REGION_SETS, count_links: bool = True
) -> list[DataFrame]:
    """Links of all regions, cut at pivots until each fits into a task.

    A region is done when it has at most ``region_sets`` sets and ``region_bytes`` of shingles. One whose
    largest cell keeps nine tenths of its sets is compared in pairs of blocks instead, which is exact too.
    Without ``count_links`` only what connects sets is looked for: sets that link to one pivot are not
    compared with each other, and leave when nothing outside their star is near enough to link.
    """
    results = []
    sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.octet_length("tokens")).alias("bytes"))
    while True:
        large = (F.col("sets") > region_sets) | (F.col("bytes") > region_bytes)
        salts = F.ceil(SPREAD * F.greatest(F.col("sets") / region_sets, F.col("bytes") / region_bytes))
        marked = stage(sizes.select("region", "sets", "bytes", large.alias("large"), salts.alias("salts")))
        small = regions.join(marked.filter(~F.col("large")).select("region"), "region", "left_semi")
        results.append(join_small(small, link))
        if marked.filter("large").isEmpty():
            return results
        parents = regions.join(marked.filter("large").select("region", "salts"), "region")
        measured = stage(measure(parents.select(*(n.split()[0] for n in REGIONS.split(", ")), "salts"), link))
        if not count_links:
            edges = star_edges(measured)
            results.append(edges.withColumn("n", F.lit(None).cast("long")))
            measured = open_sets(measured, link)
        cells = cells_of(measured, link)
        stats = stage(cells.groupBy("parent", "region").agg(
            F.count(F.lit(1)).alias("sets"), F.sum("bytes").alias("bytes"), F.max("home").alias("_home"), (F.min("star") == F.max("star")).alias("_one_star")
        ))
        if not count_links:
            stats = stats.filter(F.col("_home") & ~F.col("_one_star"))
        stuck = _stuck(stats, marked)
        if count_links:
            blocks = stuck.select("region", F.greatest(F.lit(2), F.ceil(2 * F.col("sets") / region_sets), F.ceil(2 * F.col("bytes") / region_bytes)).alias("blocks"))
            results.append(join_small(in_block_pairs(measured, blocks), link))
        else:
            results.append(join_small(beside_largest_star(measured, stuck, region_bytes, region_sets), link))
        # A row is in several regions after the first cut, so cells go by their parent, not by their rows.
        sizes = stats.join(stuck.select(F.col("region").alias("parent")), "parent", "left_anti").select("region", "sets", "bytes")
        regions = cells.join(sizes.select("region"), "region", "left_semi")


def _stuck(cells: DataFrame, marked: DataFrame) -> DataFrame:
    """Large regions with a cell of nine tenths of their sets."""
    most = cells.groupBy(F.col("parent").alias("region")).agg(F.max("sets").alias("_most"))
    return stage(marked.filter("large").join(most, "region").filter(F.col("_most") >= 0.9 * F.col("sets")))


def similar_documents(
    docs: DataFrame, link: Link, doc_id: str = "doc_id", text: str = "text", region_bytes: int = REGION_BYTES, region_sets: int = REGION_SETS,
    count_links: bool = True,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, first) for every row of ``docs``.

    ``component_id`` is the smallest id that links reach from a row, itself included; ``n_links`` the
    number of other rows it links to; ``first`` marks one node of each component, of the smallest id. Null and empty texts have no shingles, no links and themselves as
    component. Rows equal in id and text are one node with one result each; rows of one id and different
    texts are nodes of their own. A null id never becomes a component unless all of its ids are null.
    Without ``count_links`` there is no ``n_links``, and sets known to be connected are not compared.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    partitions = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    described = stage(describe(docs, link))
    nodes = described.filter(F.col("n") > 0).dropDuplicates(["_row"])
    # Staged, so that the join below is a plain one, whose hot keys Spark can split.
    first = stage(nodes.groupBy("digest").agg(F.min("_row").alias("rep"), F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1))
    keyed = described.filter(F.col("n") > 0).select("_row", "digest", "n").join(first, "digest", "left")
    keyed = stage(keyed.select("_row", F.coalesce("rep", "_row").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), "n"))
    reps = keyed.filter(F.col("copies") > 1).drop("n").dropDuplicates(["_row"])

    members = region_members(docs, link, partitions)
    sized = keyed.select("_row", "rep", "n").dropDuplicates(["_row"])
    members = members.join(sized, "_row").select("region", F.col("rep").alias("_row"), "n").distinct()
    clusters = stage(connected_components(stage(candidate_edges(members, nodes, link))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 4 << 20):
            tokens = [shingles(t, link.words, hashes).tobytes() for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.binary())], ["region", "_row", "tokens"])

    chosen = docs.select("_row", "text").join(clusters.withColumnsRenamed({"node": "_row", "root": "region"}), "_row")
    regions = chosen.select("region", "_row", "text").mapInArrow(sets, "region long, _row long, tokens binary").dropDuplicates(["_row"])
    weights = reps.filter(F.col("_row") == F.col("rep")).select("_row", "copies")
    regions = stage(regions.join(weights, "_row", "left").select(
        "region", "_row", F.coalesce("copies", F.lit(1)).cast("long").alias("weight"), F.lit(True).alias("home"), F.lit(0).alias("side"), "tokens"
    ))
    parts = metric_join(regions, link, region_bytes, region_sets, count_links)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = stage(found)

    links = found.filter(F.col("b").isNotNull()).select("a", "b").unionByName(
        reps.filter(F.col("_row") != F.col("rep")).select(F.col("_row").alias("a"), F.col("rep").alias("b"))
    )
    components = stage(connected_components(links).withColumnRenamed("node", "_row"))
    named = stage(described.select("_row", "doc_id").join(components, "_row").groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).getField("_row").alias("_first")
    ))
    # Only linked rows are joined by root, so unlinked ones do not meet under a null key.
    labelled = stage(components.join(named, "root").select("_row", "component_id", "_first"))
    own = described.select("_row", "doc_id", "n").join(labelled, "_row", "left")
    n_links = []
    if count_links:
        counts = stage(found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others")))
        own = own.join(reps, "_row", "left").withColumn("rep", F.coalesce("rep", "_row")).join(counts, "rep", "left")
        n_links = [(F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links")]
    return own.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *n_links,
        F.coalesce(F.col("_first") == F.col("_row"), F.lit(True)).alias("first"), "_row",
    )


def first_of_each_group(docs: DataFrame, link: Link, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but the first document of each component, and without repeated rows.

    The first one has the smallest id, a null id being the largest; a tie goes by content.
    """
    row, copy = fresh(docs, "_row"), fresh(docs, "_copy")
    kept = similar_documents(docs, link, doc_id, text, count_links=False).filter("first").select(F.col("_row").alias(row)).distinct()
    rows = docs.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text))).join(kept, row, "left_semi")
    # The join has sorted the rows by key already.
    once = rows.withColumn(copy, F.row_number().over(W.partitionBy(row).orderBy(row)))
    return once.filter(F.col(copy) == 1).select(docs.columns)
