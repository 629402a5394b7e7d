"""Clustering of province vectors: Ward trees, silhouettes, monthly evolution, PCA and KMeans.

Ward trees are built in rounds over a table of clusters that keep their nearest neighbours, for all groups
at once and for any number of rows.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import metrics
from feltgrid.operators.rows import beside
from feltgrid.operators.stage import stage

BLOCK_ROWS = 2048
WARD_ROWS = 1 << 16  # of a block of clusters, which one task holds
STRIP_ROWS = 1 << 16  # of the clusters that a task compares with as many others
SEED = 42


def eligible(df: DataFrame, posts: str, min_posts: int, features: Sequence[str]) -> DataFrame:
    """Rows with enough posts, missing features read as 0."""
    return df.filter(F.col(posts) >= min_posts).na.fill(0.0, list(features))


def _scale(mean: Column, variance: Column, n: Column) -> Column:
    """Population deviation; 1 for a column that is constant up to rounding error."""
    eps = float(np.finfo(np.float64).eps)
    constant = variance <= n * eps * variance + F.pow(n * mean * eps, F.lit(2.0))
    return F.when(constant, 1.0).otherwise(F.sqrt(variance))


def standardise(df: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """Features centred and scaled by their population deviation, overall or per group."""
    stats = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        stats += [F.avg(f).alias(f"_{f}_mean"), F.var_pop(f).alias(f"_{f}_var")]
    if group is None:
        wide = beside(df, df.agg(*stats))
    else:
        wide = df.join(df.groupBy(group).agg(*stats), group)
    scaled = {
        f: (F.col(f) - F.col(f"_{f}_mean")) / _scale(F.col(f"_{f}_mean"), F.col(f"_{f}_var"), F.col("_n"))
        for f in features
    }
    return wide.withColumns(scaled).select(*df.columns)


# --- Ward ------------------------------------------------------------------------------------
#
# A cluster is named by its smallest key. Ward's cost is reducible: joining two clusters brings neither
# closer to a third one than the nearer of them was. So all pairs of mutually nearest clusters can be joined
# at once, sorting all joins by their height gives the tree that joining one pair at a time gives, and a
# cluster keeps its nearest neighbour until that neighbour is joined to another.
#
# Rows of a group lie in blocks of near rows. A block's task knows its own clusters and the boxes that
# hold those of the other blocks; a nearest neighbour within the block that is nearer than any box is
# nearest of all, and the task joins such pairs until none is left. Only what remains looks into other
# blocks, and only into those whose box is not farther than the nearest cluster known.

KNOWN, OPEN, WAITING = range(3)  # of a cluster's neighbour: nearest of all, nearest of its block, to be looked for
GONE = -1
JOIN, CLUSTER, BOX, WORK, UPDATE, MADE = range(6)  # kinds of rows
COLUMNS = "_kind int, _group string, _block bigint, _key string, _n double, _state int, cost double, lo string, hi string, round bigint, x binary"
ROUND_SHIFT = 32
CHUNK_CELLS = 1 << 21
TILE = 512, 1024  # pairs of one product, which a core's cache holds
SAFE = 1 - 1e-12  # bounds are rounded apart from costs
TIE = 1 + 1e-9  # pairs that cost so little more are looked at too


def _costs(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Ward's cost of some pairs, from their differences: a pair has the same cost wherever it is looked at."""
    out, few = np.empty(len(rows)), max(1, CHUNK_CELLS // max(1, x.shape[1]))
    for k in range(0, len(rows), few):
        i, j = rows[k:k + few], columns[k:k + few]
        out[k:k + few] = ((x[i] - y[j]) ** 2).sum(axis=1) * (2 * n[i] * m[j] / (n[i] + m[j]))
    return out


def _first_limit(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, own: np.ndarray | None, columns: int = 256) -> np.ndarray:
    """A cost that the nearest of ``y`` does not exceed, by the first columns."""
    y, m, limit = y[:columns], m[:columns], np.full(len(x), np.inf)
    square = (y * y).sum(axis=1)
    for at in range(0, len(x), 4096):
        part = slice(at, at + 4096)
        reach = (x[part] ** 2).sum(axis=1)[:, None] + square[None, :]
        high = (reach * (1 + (8 * x.shape[1] + 16) * np.finfo(np.float64).eps) - 2 * (x[part] @ y.T)) * (2 * n[part, None] * m / (n[part, None] + m))
        if own is not None:
            inside = np.flatnonzero((own[part] >= 0) & (own[part] < len(y)))
            high[inside, own[part][inside]] = np.inf
        limit[part] = np.fmin.reduce(high, axis=1, initial=np.inf)
    return limit


def _pairs(x: np.ndarray, n: np.ndarray, limit: np.ndarray, y: np.ndarray, m: np.ndarray, own: np.ndarray | None):
    """Arrays (row, column, cost) of the pairs that cost no more than the row's limit, which falls to the least cost found.

    A product in single precision, with limits and sizes as further features, tells which pairs could count: a pair costs
    no more than t if its squared gap is at most t / 2 * (1 / n + 1 / m). Its rounding errors are added to the limit.
    """
    if not len(x) or not len(y):
        return
    centre = y.mean(axis=0)
    scale = max(np.abs(x - centre).max(), np.abs(y - centre).max()) or 1.0
    points, others = (x - centre) / scale, (y - centre) / scale
    square_x, square_y = (points * points).sum(axis=1), (others * others).sum(axis=1)
    rounding = 2 * (x.shape[1] + 20) * float(np.finfo(np.float32).eps)
    reach = (np.sqrt(square_x) + np.sqrt(square_y.max())) ** 2
    all_pass = 3 * reach / (1 / n + 1 / m.max()) + 1e-30
    limit = limit * TIE

    def limits(rows: slice | np.ndarray) -> np.ndarray:
        t = np.fmin(limit[rows] / scale / scale, all_pass[rows])
        slack = rounding * (reach[rows] + t * (1 / n[rows] + 1 / m.min()))
        return np.stack([-t / 2, square_x[rows] - t / (2 * n[rows]) - slack], axis=1)

    right = np.concatenate([others, square_y[:, None], 1 / m[:, None], np.ones((len(y), 1))], axis=1).astype(np.float32)
    space = np.empty(TILE[0] * TILE[1], np.float32)
    for at in range(0, len(x), TILE[0]):
        rows = np.arange(at, min(at + TILE[0], len(x)))
        left = np.concatenate([-2 * points[rows], np.ones((len(rows), 1)), limits(rows)], axis=1).astype(np.float32)
        for to in range(0, len(y), TILE[1]):
            some = right[to:to + TILE[1]]
            tile = space[:len(rows) * len(some)].reshape(len(rows), len(some))
            np.matmul(left, some.T, out=tile)
            i, j = np.divmod(np.flatnonzero(tile <= 0), len(some))
            i, j = i + at, j + to
            if own is not None:
                i, j = (k[own[i] != j] for k in (i, j))
            if not len(i):
                continue
            costs = _costs(x, n, y, m, i, j)
            near = costs <= limit[i]
            i, j, costs = i[near], j[near], costs[near]
            if len(i):
                np.minimum.at(limit, i, costs * TIE)
                left[:, -2:] = limits(rows)
                yield i, j, costs


def _nearest(
    x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, kept: np.ndarray, own: np.ndarray | None = None,
    limit: np.ndarray | None = None, both: bool = True,
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ward's nearest of the clusters ``y`` (sizes ``m``) for each of ``x`` (sizes ``n``): place, cost, and what is not above ``kept``.

    The last are (row, column, cost) of pairs that cost no more than the column's ``kept``, with all of the column's least
    cost; unless ``both``, only those among them that are as near to the row as its nearest. Equal costs go to the first
    column. ``own`` is each row's own column, which is left out. Where ``limit`` is finite, only what costs no more is found.
    """
    best, least, found = np.full(len(x), -1), np.full(len(x), np.inf), []
    limit = np.full(len(x), np.inf) if limit is None else limit.copy()
    wide = np.flatnonzero(~np.isfinite(limit))
    limit[wide] = _first_limit(x[wide], n[wide], y, m, None if own is None else own[wide])
    for i, j, costs in _pairs(x, n, limit, y, m, own):
        order = np.lexsort((j, costs, i))
        firsts = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        firsts = firsts[costs[firsts] < least[i[firsts]]]
        best[i[firsts]], least[i[firsts]] = j[firsts], costs[firsts]
        near = costs <= kept[j]
        found.append((i[near], j[near], costs[near]))
    if both and np.any(kept >= 0):
        some, whose = np.flatnonzero(kept >= 0), None
        if own is not None:
            whose = np.full(len(y), -1)
            whose[own] = np.arange(len(x))
            whose = whose[some]
        for j, i, _ in _pairs(y[some], m[some], kept[some], x, n, whose):
            j, costs = some[j], _costs(x, n, y, m, i, some[j])
            near = costs <= kept[j]
            found.append((i[near], j[near], costs[near]))
    return best, least, tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _fences(x: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Least cost that any cluster in one of the boxes could have."""
    out = np.full(len(x), np.inf)
    for lo, hi, m in zip(low, high, least):
        gaps = (np.maximum(0, np.maximum(lo - x, x - hi)) ** 2).sum(axis=1)
        out = np.minimum(out, gaps * (2 * n * m / (n + m)))
    return out


class _Block:
    """Clusters of one block in the order of their names, and the joins that are certain."""

    def __init__(self, rows: pd.DataFrame, boxes: pd.DataFrame):
        rows = rows.sort_values("_key", ignore_index=True)
        self.keys, self.x, self.n = rows["_key"].to_numpy(object), _matrix(rows), rows["_n"].to_numpy("float64").copy()
        self.cost, self.lo, self.hi = (rows[c].to_numpy(kind).copy() for c, kind in (("cost", "float64"), ("lo", object), ("hi", object)))
        self.state = rows["_state"].to_numpy("int64").copy()
        sides = np.split(_matrix(boxes), 2, axis=1) if len(boxes) else 2 * [self.x[:0]]
        self.boxes = *sides, boxes["_n"].to_numpy("float64")
        self.place = {k: i for i, k in enumerate(self.keys)}
        partner = [None if s == WAITING else h if k == l else l for k, l, h, s in zip(self.keys, self.lo, self.hi, self.state)]
        self.near = np.array([self.place.get(p, -1) for p in partner], np.int64)
        self.alive, self.compared, self.joins = np.ones(len(rows), bool), 0, []

    def look(self, some: np.ndarray) -> None:
        """The nearest cluster of the block for each of ``some``; equal costs go by the smaller names."""
        others = np.flatnonzero(self.alive)
        if not len(some):
            return
        fresh = np.isin(others, some, invert=True) & (self.near[others] >= 0)
        kept = np.where(fresh, self.cost[others], -np.inf)
        # No join brings two clusters nearer than the nearer of their parts was, so what comes as near as a kept neighbour is nearest itself.
        best, costs, (row, column, as_near) = _nearest(
            self.x[some], self.n[some], self.x[others], self.n[others], kept, np.searchsorted(others, some), both=False
        )
        # A pair that both of its ends look at is one pair.
        self.compared += len(some) * (len(others) - 1) - len(some) * (len(some) - 1) // 2
        fence = _fences(self.x[some], self.n[some], *self.boxes)
        self._set(some, np.where(np.isfinite(costs), others[best], -1), costs, np.where(costs < fence * SAFE, KNOWN, OPEN))
        # A cluster that is as near as a kept neighbour takes its place if its name is smaller.
        row, column = some[row], others[column]
        order = np.lexsort((row, as_near, column))
        order = order[np.flatnonzero(np.diff(column[order], prepend=-1))]
        i, j, c = row[order], column[order], as_near[order]
        # With one end the same, the pair of the smaller other end has the smaller names.
        nearer = (c < self.cost[j]) | (i < self.near[j])
        self._set(j[nearer], i[nearer], c[nearer], self.state[j[nearer]])

    def _set(self, i: np.ndarray, near: np.ndarray, cost: np.ndarray, state: np.ndarray) -> None:
        self.near[i], self.cost[i], self.state[i] = near, cost, state
        self.lo[i] = np.where(near < 0, None, self.keys[np.minimum(i, near)])
        self.hi[i] = np.where(near < 0, None, self.keys[np.maximum(i, near)])

    def join_all(self, first: int) -> None:
        """Joins all that is certain. A cluster that lost its neighbour looks again once a pair or all pairs depend on it."""
        waiting = self.state == WAITING
        self.near[waiting] = -1
        self.look(np.flatnonzero(waiting))
        waiting[:] = False
        while True:
            i = np.flatnonzero(self.alive & ~waiting & (self.near >= 0) & (self.state == KNOWN))
            near = self.near[i]
            i = i[(self.near[near] == i) & (self.state[near] == KNOWN) & ~waiting[near] & (i < near)]
            if len(i):
                j = self.near[i]
                total = self.n[i] + self.n[j]
                self.x[i] = (self.x[i] * self.n[i][:, None] + self.x[j] * self.n[j][:, None]) / total[:, None]
                self.n[i], self.alive[j] = total, False
                order = first + len(self.joins) + np.arange(len(i))
                self.joins += zip(self.keys[i], self.keys[j], self.cost[i], total, order)
                gone = np.concatenate([i, j])
                waiting[np.isin(self.near, gone)] = waiting[i] = True
                waiting &= self.alive
                self.near[waiting] = -1
                # What is joined at the cost of a kept neighbour can be as near as that: the names decide.
                kept = np.sort(self.cost[self.alive & (self.near >= 0)])
                tied = i[np.searchsorted(kept, self.cost[i] / TIE) < np.searchsorted(kept, self.cost[i] * TIE, "right")]
            elif not waiting.any():
                return
            asked = np.zeros(len(waiting), bool)
            if len(i):
                asked[self.near[self.alive & (self.near >= 0)]] = asked[tied] = True
            some = np.flatnonzero(waiting & asked)
            some = some if len(some) else np.flatnonzero(waiting)
            self.look(some)
            waiting[some] = False


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    """The features of ``rows``, which are packed in ``x``."""
    return np.frombuffer(b"".join(rows["x"]), np.float64).reshape(len(rows), -1).copy()


def _packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x, np.float64)]


def _box(x: np.ndarray, n: np.ndarray) -> dict:
    return {"_kind": BOX, "_n": n.min(), "x": np.concatenate([x.min(axis=0), x.max(axis=0)]).tobytes()}


def _rows(parts: list[dict], group: str, block: int) -> pd.DataFrame:
    """Rows of ``COLUMNS`` from dicts of columns."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = pd.concat([pd.DataFrame({c: p.get(c) for c in names} | {"_group": group, "_block": block}, index=range(np.size(p["_n"]))).astype(object) for p in parts])
    return out.astype({"_n": "float64", "cost": "float64", "_state": "Int32", "round": "Int64"})


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """The clusters that pairs of rows with the same ``_to`` make."""
    parts = parts.sort_values(["_to", "_key"], ignore_index=True)
    x, n = _matrix(parts), parts["_n"].to_numpy("float64")
    i, j = slice(0, None, 2), slice(1, None, 2)
    total = n[i] + n[j]
    x = (x[i] * n[i][:, None] + x[j] * n[j][:, None]) / total[:, None]
    made = {"_kind": MADE, "_key": parts["_to"].to_numpy(object)[i], "_n": total, "_state": WAITING, "x": _packed(x)}
    return _rows([made], parts["_group"].iat[0], parts["_to_block"].iat[0])


def _present(block: pd.DataFrame) -> pd.DataFrame:
    """The clusters of a block after its updates."""
    kinds, state = block["_kind"], ["_state", "cost", "lo", "hi"]
    own, updates = block[kinds == CLUSTER], block[kinds == UPDATE]
    if len(updates):
        own = own.drop(columns=state).merge(updates[["_key", *state]], on="_key")
    return pd.concat([own[own["_state"] != GONE], block[kinds == MADE]])


def _boxed(block: pd.DataFrame) -> pd.DataFrame:
    """The box of a block's clusters."""
    rows = _present(block)
    box = _box(_matrix(rows), rows["_n"].to_numpy("float64")) if len(rows) else {"_kind": WORK, "_n": 0.0}
    return _rows([box], block["_group"].iat[0], block["_block"].iat[0])


def _local_joins(number: int):
    """Rows of the joins a block can make for sure, of the clusters left, and of the comparisons made."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        own = _present(block)
        if not len(own):
            return _rows([{"_kind": WORK, "_n": 0.0, "cost": 0.0}], block["_group"].iat[0], block["_block"].iat[0])
        b = _Block(own, block[block["_kind"] == BOX])
        b.join_all(number << ROUND_SHIFT)
        left = np.flatnonzero(b.alive)
        out = [
            {"_kind": CLUSTER, "_key": b.keys[left], "_n": b.n[left], "_state": b.state[left], "lo": b.lo[left], "hi": b.hi[left],
             "cost": np.where(np.isfinite(b.cost[left]), b.cost[left], np.nan), "x": _packed(b.x[left])},
            {"_kind": WORK, "_n": 0.0, "cost": float(b.compared)},
        ]
        if b.joins:
            out.append({"_kind": JOIN, **dict(zip(("lo", "hi", "cost", "_n", "round"), map(np.array, zip(*b.joins))))})
        return _rows(out, own["_group"].iat[0], own["_block"].iat[0])

    return run


def _visits(pair: pd.DataFrame) -> pd.DataFrame:
    """Nearest cluster of another block for each visitor, and what comes as near to a member as its neighbour."""
    one, members = (pair[pair["_side"] == side].sort_values("_key", ignore_index=True) for side in (0, 1))
    if not len(one) or not len(members):
        return pd.DataFrame({"_kind": WORK, "_group": pair["_group"].iloc[:1], "_key": None, "cost": 0.0, "lo": None, "hi": None})
    x, n, mine, home = _matrix(one), one["_n"].to_numpy("float64"), one["_key"].to_numpy(object), one["_block"].to_numpy()
    least, partner, found, compared = one["cost"].fillna(np.inf).to_numpy("float64").copy(), np.full(len(one), None, object), [], 0
    for name, other in members.groupby("_block"):
        y, m, theirs = _matrix(other), other["_n"].to_numpy("float64"), other["_key"].to_numpy(object)
        fence = _fences(x, n, y.min(axis=0)[None], y.max(axis=0)[None], m.min()[None])
        some = np.flatnonzero((home != name) & (fence * SAFE <= least))
        if not len(some):
            continue
        compared += len(some) * len(y)
        best, costs, (row, column, as_near) = _nearest(x[some], n[some], y, m, other["cost"].to_numpy("float64"), limit=least[some], both=False)
        hit = np.flatnonzero(best >= 0)
        hit = hit[[c < least[i] or partner[i] is None or t < partner[i] for i, c, t in zip(some[hit], costs[hit], theirs[best[hit]])]]
        least[some[hit]], partner[some[hit]] = costs[hit], theirs[best[hit]]
        # Names are in order, so the first of equally near ones makes the pair of the smallest names.
        order = np.lexsort((row, as_near, column))
        firsts = order[np.flatnonzero(np.diff(column[order], prepend=-1))]
        found.append((theirs[column[firsts]], mine[some[row[firsts]]], as_near[firsts]))
    met = np.flatnonzero([p is not None for p in partner])
    found.append((mine[met], partner[met], least[met]))
    found.append((np.array([None]), np.array([None]), np.array([float(compared)])))
    key, to, cost = (np.concatenate(f) for f in zip(*found))
    first = np.array([k is not None and k < t for k, t in zip(key, to)])
    out = {"_kind": np.where(np.arange(len(key)) < len(key) - 1, CLUSTER, WORK), "_group": pair["_group"].iat[0], "_key": key, "cost": cost}
    return pd.DataFrame(out | {"lo": np.where(first, key, to), "hi": np.where(first, to, key)})


def _strips(blocks: list) -> list[tuple]:
    """``(_group, _block, _a, _b, _as, _bs)``: blocks dealt to strips of rows that look and of all rows, and how many strips there are.

    A strip has ``STRIP_ROWS`` rows or a fourth of the group's, if that is less.
    """
    out = []
    for group, rows in itertools.groupby(sorted(blocks, key=lambda r: (r._group, r._block)), key=lambda r: r._group):
        rows, places = list(rows), []
        for counts in ([r.open for r in rows], [r.left for r in rows]):
            size, before = max(1, min(STRIP_ROWS, -(-sum(counts) // 4))), np.cumsum([0, *counts[:-1]])
            strips = np.unique(before // size, return_inverse=True)[1]
            places.append((strips, int(strips.max()) + 1 if sum(counts) else 0))
        out += [(group, r._block, int(a), int(b), places[0][1], places[1][1]) for r, a, b in zip(rows, places[0][0], places[1][0])]
    return out


def _in_blocks(rows: DataFrame, features: list[str], block_rows: int) -> DataFrame | None:
    """The ``_block`` of each ``_group`` and ``_key``: groups over ``block_rows`` rows are halved at medians, one feature after the other.

    Blocks that equal values keep large are cut by hash. None if each group fits into one block.
    """
    counts = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    largest = counts.agg(F.max("_rows")).first()[0] or 0
    if largest <= block_rows:
        return None
    spread = rows.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    widest = sorted(features, key=lambda f: -(spread[f] or 0))[:8]
    placed = stage(rows.join(counts, "_group").select("_group", "_key", F.lit(0).cast("bigint").alias("_block"), "_rows", *widest))
    level = 0
    while largest > block_rows << level:
        feature = widest[level % len(widest)]
        middle = placed.groupBy("_group", "_block").agg(F.percentile_approx(feature, 0.5).alias("_middle"))
        upper = (F.col(feature) > F.col("_middle")) & (F.col("_rows") > F.lit(block_rows << level))
        placed = stage(placed.join(middle, ["_group", "_block"]).withColumn("_block", F.col("_block") * 2 + upper.cast("bigint")).drop("_middle"))
        level += 1
    held = placed.groupBy("_group", "_block").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).alias("_parts"))
    part = F.pmod(F.xxhash64("_key"), F.col("_parts"))
    return placed.join(held, ["_group", "_block"]).select("_group", "_key", (F.shiftleft("_block", 24) + part).alias("_block"))


def _named(points: DataFrame, key: str, group: str | None, features: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``_group`` and ``_key``, a text that no other row of the group has: keys that come again are numbered by their features."""
    rows = points.withColumns({
        "_group": F.lit("") if group is None else F.col(group).cast("string"), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))
    })
    if rows.groupBy("_group", "_key").count().filter("count > 1").isEmpty():
        return rows
    again = F.row_number().over(W.partitionBy("_group", "_key").orderBy(*features or [F.lit(0)]))
    return rows.withColumn("_again", again).withColumn(
        "_key", F.when(F.col("_again") == 1, F.col("_key")).otherwise(F.concat("_key", F.lit("\0"), F.lpad(F.col("_again").cast("string"), 10, "0")))
    ).drop("_again")


def _copies_joined(rows: DataFrame, features: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Joins of equal rows to the smallest name among them, at no distance, and one cluster for each."""
    like = rows.select("_group", "_key", F.xxhash64(*features).alias("_like"))
    often = like.groupBy("_group", "_like").count().filter("count > 1").select("_group", "_like")
    if often.isEmpty():
        return None, rows
    rows = rows.withColumn("_like", F.xxhash64(*features))
    equal = W.partitionBy("_group", "_like", *features)
    copies = stage(rows.join(often, ["_group", "_like"], "left_semi").withColumns({
        "lo": F.min("_key").over(equal), "_place": F.row_number().over(equal.orderBy("_key")), "_n": F.count(F.lit(1)).over(equal).cast("double")
    }))
    joins = copies.filter("_place > 1").select(
        "_group", "lo", F.col("_key").alias("hi"), F.lit(0.0).alias("distance"), F.col("_place").cast("bigint").alias("sample_count"),
        F.col("_place").cast("bigint").alias("round"),
    )
    firsts = copies.filter("_place = 1").withColumn("lo", F.lit(None).cast("string")).drop("_place")
    return joins, stage(rows.join(often, ["_group", "_like"], "left_anti").unionByName(firsts).drop("_like"))


def ward_merges(
    points: DataFrame, key: str, features: Sequence[str], group: str | None = None, block_rows: int = WARD_ROWS, work: list[int] | None = None
) -> DataFrame:
    """All joins of one Ward tree per ``group``: rows ``(group, lo, hi, distance, sample_count, round)``.

    ``hi`` is joined to ``lo``, the smaller name; ``round`` rises along each branch. Keys that come again within a group
    are numbered (see ``_named``), equal rows are joined first. Rows without a finite number for each feature have no
    distance and are not joined. Groups that fit into a block are done in the first round, all of them in parallel. ``work``
    takes the number of pairs compared in each round.
    """
    features = list(features)
    start = stage(_named(points, key, group, features).select(
        "_group", "_key", F.lit(1.0).alias("_n"),
        F.lit(WAITING).alias("_state"), F.lit(None).cast("double").alias("cost"), *[F.lit(None).cast("string").alias(c) for c in ("lo", "hi")],
        *[F.col(f).cast("double").alias(f) for f in features],
    ).filter(functools.reduce(operator.and_, (F.abs(f) < float("inf") for f in features))))
    placed = _in_blocks(start, features, block_rows)
    copies, start = _copies_joined(start, features)

    def pack(batches):
        for rows in batches:
            yield rows.drop(columns=features).assign(_kind=CLUSTER, x=_packed(rows[features].to_numpy("float64")))

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    packed = start.withColumns({"_block": F.lit(0).cast("bigint"), "round": F.lit(None).cast("bigint")}).mapInPandas(pack, COLUMNS).select(*names)
    if placed is not None:
        packed = stage(packed.drop("_block").join(placed, ["_group", "_key"]).select(*names))
    seen = packed if placed is None else packed.unionByName(_boxes(packed))
    found, number = [] if copies is None else [copies], 1
    while True:
        local = stage(seen.groupBy("_group", "_block").applyInPandas(_local_joins(number), COLUMNS))
        kind = F.col("_kind")
        joined = local.filter(kind == JOIN)
        found.append(joined.select("_group", "lo", "hi", F.sqrt("cost").alias("distance"), F.col("_n").cast("bigint").alias("sample_count"), "round"))
        if work is not None:
            work.append(int(local.filter(kind == WORK).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]))
        blocks = local.groupBy("_group", "_block").agg(
            F.count_if(kind == CLUSTER).alias("left"), F.count_if((kind == CLUSTER) & (F.col("_state") == OPEN)).alias("open"), F.count_if(kind == JOIN).alias("joined")
        )
        # Some for each group that does not fit into a block.
        blocks = blocks.withColumn("_all", F.sum("left").over(W.partitionBy("_group"))).filter("_all > 1 and left > 0").collect()
        if not blocks:
            break
        changed = any(r.joined for r in blocks)
        joins, parts = _joins_across(local, blocks, changed, number, work)
        made = {r._group: r["count"] for r in joins.groupBy("_group").count().collect()}
        # What is left has no finite cost.
        if not made and not changed:
            break
        found.append(joins.drop("_to_block"))
        number += 1
        # Once the clusters of every group fit into a block, its task needs no more rounds.
        if max(r._all - made.get(r._group, 0) for r in blocks) <= block_rows:
            seen = parts.withColumn("_block", F.lit(0).cast("bigint"))
        else:
            seen = parts.unionByName(_boxes(parts))
    merges = found[0]
    for more in found[1:]:
        merges = merges.unionByName(more)
    return merges


def _boxes(rows: DataFrame) -> DataFrame:
    """The boxes of a group's blocks, for each of its other blocks."""
    boxes = stage(rows.groupBy("_group", "_block").applyInPandas(_boxed, COLUMNS).filter(F.col("_kind") == BOX))
    blocks = boxes.select("_group", F.col("_block").alias("_for"))
    return boxes.join(blocks, "_group").filter("_for <> _block").withColumn("_block", F.col("_for")).drop("_for")


def _joins_across(local: DataFrame, blocks: list, changed: bool, number: int, work: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """Joins of mutually nearest clusters of any blocks, and the rows that the blocks' next tasks read."""
    name = ["_group", "_name"]
    partner = F.when(F.col("lo") == F.col("_key"), F.col("hi")).otherwise(F.col("lo"))

    def ends(joins: DataFrame, *more: str) -> DataFrame:
        return joins.select("_group", F.explode(F.array("lo", "hi")).alias("_name"), F.col("lo").alias("_to"), *more)

    # One row for each block.
    strips = F.broadcast(local.sparkSession.createDataFrame(_strips(blocks), "_group string, _block bigint, _a int, _b int, _as int, _bs int"))
    kind = F.col("_kind")
    left = local.filter(kind == CLUSTER).join(strips, ["_group", "_block"])
    state = ["_group", "_block", "_key", "_n", "_state", "cost", "lo", "hi"]
    every = {c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for c, n in (("_a", "_as"), ("_b", "_bs"))}
    sides = ["_group", "_a", "_b", "_block", "_key", "_n", "cost", "x", "_side"]
    calls = left.filter(F.col("_state") == OPEN).withColumns({"_b": every["_b"], "_side": F.lit(0)}).select(*sides)
    kept = F.when(F.col("_state") == KNOWN, F.col("cost"))
    called = left.filter("_as > 0").withColumns({"cost": kept, "_a": every["_a"], "_side": F.lit(1)}).select(*sides)
    compared = stage(calls.unionByName(called).groupBy("_group", "_a", "_b").applyInPandas(
        _visits, "_kind int, _group string, _key string, cost double, lo string, hi string"
    ))
    if work is not None:
        work[-1] += int(compared.filter(kind == WORK).agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0])
    found = left.select(*state)
    if changed:
        # A neighbour in another block that was joined there: such clusters look again within their block first.
        lost = ends(local.filter(kind == JOIN)).select(*name, F.lit(True).alias("_lost")).distinct()
        gone = (F.col("_state") == KNOWN) & F.col("_lost").isNotNull()
        found = found.withColumn("_name", partner).join(lost, name, "left").withColumn("_state", F.when(gone, WAITING).otherwise(F.col("_state"))).select(*state)
    nearer = compared.filter(kind == CLUSTER).groupBy("_group", "_key").agg(F.min(F.struct("cost", "lo", "hi")).alias("_new"))
    own = F.when(F.col("cost").isNotNull(), F.struct("cost", "lo", "hi"))
    best = found.join(nearer, ["_group", "_key"], "left").withColumn("_best", F.array_min(F.array_compact(F.array(own, "_new"))))
    best = stage(best.select(*state[:5], *[F.col("_best")[c].alias(c) for c in ("cost", "lo", "hi")]))
    votes = best.filter(F.col("_state") != WAITING).groupBy("_group", "lo", "hi").agg(
        F.count(F.lit(1)).alias("_votes"), F.min("cost").alias("cost"), F.sum("_n").cast("bigint").alias("sample_count"), F.min_by("_block", "_key").alias("_to_block")
    )
    order = F.lit((number + 1 << ROUND_SHIFT) - 1)
    joins = stage(votes.filter("_votes = 2").select("_group", "lo", "hi", F.sqrt("cost").alias("distance"), "sample_count", order.alias("round"), "_to_block"))
    halves = left.withColumn("_name", F.col("_key")).join(ends(joins, "_to_block"), name).select("_group", "_key", "_n", "x", "_to", "_to_block")
    made = stage(halves.groupBy("_group", "_to_block").applyInPandas(_joined, COLUMNS))
    moved = best.withColumn("_name", F.col("_key")).join(ends(joins), name, "left").withColumn("_name", partner)
    moved = moved.join(ends(joins).select(*name, F.lit(True).alias("_lost")), name, "left")
    now = F.when(F.col("_to").isNotNull(), GONE).when(F.col("_lost").isNotNull() | (F.col("_state") == WAITING), WAITING).otherwise(KNOWN)
    updates = moved.select("_group", "_block", "_key", now.alias("_state"), *[F.when(now == KNOWN, F.col(c)).alias(c) for c in ("cost", "lo", "hi")])
    updates = updates.withColumn("_kind", F.lit(UPDATE))
    return joins, left.select(*local.columns).unionByName(made).unionByName(updates, allowMissingColumns=True)


def _numbered(merges: DataFrame) -> DataFrame:
    """Joins with their ``step`` in order of height; a join comes after those it rests on."""
    order = W.partitionBy("_group").orderBy(F.round("distance", 10), "round", "lo", "hi")
    return merges.withColumn("step", F.row_number().over(order) - 1)


def cut_labels(merges: DataFrame, points: DataFrame, key: str, ks: Sequence[int], group: str | None = None) -> DataFrame:
    """Labels ``(_group, k, key, label)`` of every cut, numbered by the clusters' smallest keys.

    A cut into k clusters takes the first n - k joins. Each key looks up what its cluster was joined to,
    twice as far in each pass.
    """
    keys = _named(points.select(*{key, group} - {None}), key, group).select("_group", F.col(key).alias(key), "_key")
    counts = keys.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    sized = keys.join(counts, "_group").withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.col("k") <= F.col("_rows"))
    joined = _numbered(merges).select("_group", F.col("hi").alias("_key"), "lo", "step")
    start = sized.join(joined, ["_group", "_key"], "left")
    taken = F.col("step") < F.col("_rows") - F.col("k")
    state = stage(start.select("_group", "k", key, "_key", F.when(taken, F.col("lo")).otherwise(F.col("_key")).alias("root"), F.lit(True).alias("_moved")))
    while True:
        up = state.select("_group", "k", F.col("_key").alias("root"), F.col("root").alias("_up"))
        moved = state.join(up, ["_group", "k", "root"])
        state = stage(moved.select("_group", "k", key, "_key", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
        if state.filter("_moved").isEmpty():
            break
    number = F.row_number().over(W.partitionBy("_group", "k").orderBy("root")) - 1
    names = state.filter(F.col("root") == F.col("_key")).select("_group", "k", "root", number.cast("int").alias("label"))
    return state.join(names, ["_group", "k", "root"]).select("_group", "k", key, "label")


def ward_labels(scaled: DataFrame, key: str, features: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Labels ``(k, key, label)`` of every cut of one Ward tree over standardised rows.

    ``ks`` beyond the number of rows are left out. Labels are numbered by the smallest key.
    """
    return cut_labels(ward_merges(scaled, key, features), scaled, key, ks).select("k", key, "label")


def ward_linkage(scaled: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Merge table ``(step, left, right, distance, sample_count)``; rows are numbered in key order.

    A cluster that step s makes has the number n + s.
    """
    merges = stage(_numbered(ward_merges(scaled, key, features)))
    rows = scaled.select(F.col(key).cast("string").alias("_key"))
    numbers = rows.withColumn("_number", F.row_number().over(W.orderBy("_key")) - 1)
    n = rows.count()
    made = F.lag("step").over(W.partitionBy("lo").orderBy("step"))
    last = merges.groupBy(F.col("lo").alias("hi")).agg(F.max("step").alias("_right_step"))
    sides = merges.withColumn("_left_step", made).join(last, "hi", "left")
    sides = sides.join(numbers.select(F.col("_key").alias("lo"), F.col("_number").alias("_lo")), "lo").join(
        numbers.select(F.col("_key").alias("hi"), F.col("_number").alias("_hi")), "hi")
    one = F.coalesce(F.col("_left_step") + n, F.col("_lo"))
    two = F.coalesce(F.col("_right_step") + n, F.col("_hi"))
    return sides.select(
        "step", F.least(one, two).cast("int").alias("left"), F.greatest(one, two).cast("int").alias("right"), "distance", "sample_count"
    )


def sweep_range(n_rows: int) -> range:
    """Cluster numbers worth trying for ``n_rows`` rows."""
    upper = min(7, n_rows - 1)
    return range(2, n_rows if upper < 3 else upper)


# --- Silhouette ------------------------------------------------------------------------------


def silhouette_rows(
    labelled: DataFrame, key: str, features: Sequence[str], label: str = "label", group: str = "k",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact Euclidean silhouette ``(group, key, label, silhouette)`` of each row.

    The rows of a group are hashed into blocks. A task compares one block with another and
    returns only distance sums per row and label, never single pairs. The work is quadratic in
    the rows of a group, as the measure is; see ``silhouette_squared`` for a linear one.
    """
    features = list(features)
    rows = labelled.select(
        F.col(group).alias("_group"), F.col(key).cast("string").alias("_key"),
        F.col(label).cast("int").alias("_label"), *features,
    )
    largest = rows.groupBy("_group").count().agg(F.max("count").alias("n")).first().n or 1
    blocks = -(-largest // block_rows)
    own = F.pmod(F.xxhash64("_key"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # Each row meets every block (side 0) and is met by every block (side 1).
    meets = rows.select("*", F.lit(0).alias("_side"), own.alias("_a"), every.alias("_b"))
    is_met = rows.select("*", F.lit(1).alias("_side"), own.alias("_b"), every.alias("_a"))
    placed = meets.unionByName(is_met)
    columns = ["_group", "_key", "_label", "other", "total", "members"]

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        one, other = pair[pair["_side"] == 0], pair[pair["_side"] == 1]
        x = one[features].to_numpy("float64")
        parts = [one.head(0).reindex(columns=columns)]
        for other_label, members in other.groupby("_label"):
            y = members[features].to_numpy("float64")
            total = np.zeros(len(x))
            for at in range(0, len(y), 256):
                gaps = x[:, None, :] - y[None, at:at + 256, :]
                total += np.sqrt((gaps * gaps).sum(axis=2)).sum(axis=1)
            part = one[columns[:3]].assign(other=int(other_label), total=total, members=len(y))
            parts.append(part)
        return pd.concat(parts[1:] or parts)

    group_type = labelled.schema[group].dataType.simpleString()
    sums = placed.groupBy("_group", "_a", "_b").applyInPandas(
        compare, f"_group {group_type}, _key string, _label int, other int, total double, members bigint"
    )
    per_label = sums.groupBy("_group", "_key", "_label", "other").agg(
        F.sum("total").alias("total"), F.sum("members").alias("members")
    )
    is_own = F.col("other") == F.col("_label")
    scores = per_label.groupBy("_group", "_key", "_label").agg(
        F.coalesce(F.max(F.when(is_own & (F.col("members") > 1), F.col("total") / (F.col("members") - 1))), F.lit(0.0)).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("members"))).alias("b"),
        F.sum("members").alias("n"),
    )
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return scores.select(
        F.col("_group").alias(group), F.col("_key").alias(key), F.col("_label").alias(label),
        # Fewer than three rows or a single label give 0.
        F.when((F.col("n") < 3) | F.col("b").isNull(), 0.0).otherwise(score).alias("silhouette"),
    )


def silhouette(labelled: DataFrame, key: str, features: Sequence[str], label: str = "label", group: str = "k",
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean silhouette of each group."""
    rows = silhouette_rows(labelled, key, features, label, group, block_rows)
    return rows.groupBy(group).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Silhouette over squared distances of an array column: linear work, for any number of rows."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
                     F.col(label).cast("double").alias("prediction"))
    score = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)
    return df.sparkSession.createDataFrame([(float(score),)], "silhouette double")


def best_k(scores: DataFrame) -> DataFrame:
    """Row with the highest silhouette, the smaller ``k`` on ties."""
    return scores.orderBy(F.round("silhouette", 10).desc(), "k").limit(1)


def label_stability(labels: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """One row per key, one label column per ``k``."""
    wide = labels.groupBy(key).pivot("k", list(ks)).agg(F.first("label"))
    return wide.select(key, *[F.col(str(k)).alias(f"k{k}") for k in ks])


def cluster_provinces(
    vectors: DataFrame,
    features: Sequence[str] = domain.CLUSTER_FEATURES,
    min_posts: int = domain.MIN_CLUSTER_POSTS,
    key: str = "province",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(labels of every k, silhouette of every k, labels of the best k)``.

    Every step reads the vectors, scaled rows or labels again, so these are materialised.
    """
    rows = stage(eligible(vectors, "total_posts_all", min_posts, features))
    scaled = stage(standardise(rows, features).select(key, *features))
    labels = stage(ward_labels(scaled, key, features, sweep_range(rows.count())))
    scores = stage(silhouette(labels.join(scaled, key), key, features))
    # One row.
    chosen = labels.join(F.broadcast(best_k(scores).select("k")), "k", "left_semi")
    best = rows.join(chosen, key).select(key, "total_posts_all", F.col("label").alias("cluster_label"))
    return labels, scores, best


# --- Profiles --------------------------------------------------------------------------------


def cluster_profiles(labelled: DataFrame, features: Sequence[str] = domain.CLUSTER_FEATURES,
                     key: str = "province", label: str = "cluster_label") -> DataFrame:
    """Size, sorted member names and feature means of each cluster."""
    return labelled.groupBy(label).agg(
        F.count(key).alias("province_count"),
        F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("provinces"),
        *[F.avg(f).alias(f) for f in features],
    )


def cluster_summaries(vectors: DataFrame, labels: DataFrame, key: str = "province") -> DataFrame:
    """Dashboard view of the clusters; vectors without a label count as cluster 0."""
    means = [f"{e}_mean_all" for e in domain.EMOTIONS]
    joined = vectors.join(labels.select(key, "cluster_label"), key, "left").na.fill(0, ["cluster_label"])
    summary = joined.groupBy(F.col("cluster_label").alias("cluster")).agg(
        F.array_sort(F.collect_list(key)).alias("provinces"),
        F.sum("total_posts_all").alias("posts"),
        *[F.avg(m).alias(e) for e, m in zip(domain.EMOTIONS, means)],
        F.avg("emotional_intensity_mean").alias("intensity"),
    )
    return summary.withColumn("dominant", metrics.dominant(domain.EMOTIONS))


# --- Monthly evolution -----------------------------------------------------------------------


def monthly_ward(
    monthly: DataFrame,
    clusters: int = domain.MONTHLY_CLUSTERS,
    min_posts: int = domain.MIN_MONTHLY_CLUSTER_POSTS,
    features: Sequence[str] = domain.MONTHLY_FEATURES,
    key: str = "province",
    month: str = "date_month",
) -> DataFrame:
    """Independent Ward labels of every month ``(month, key, features, label)``.

    Months with fewer than three rows per cluster get label 0. The trees of all months grow together.
    """
    features = list(features)
    rows = stage(eligible(monthly, "total_posts", min_posts, features).select(month, key, *features))
    counts = rows.groupBy(month).agg(F.count(F.lit(1)).alias("_rows"))
    enough = counts.filter(F.col("_rows") >= 3 * clusters).select(month)
    scaled = stage(standardise(rows, features, month).join(enough, month, "left_semi"))
    labels = cut_labels(ward_merges(scaled, key, features, month), scaled, key, [clusters], month)
    labels = labels.select(F.col("_group").alias(month), key, "label")
    return rows.join(labels, [month, key], "left").na.fill(0, ["label"])


def align_by_risk(labelled: DataFrame, month: str = "date_month", label: str = "label") -> DataFrame:
    """Labels renumbered per month from low to high risk (sadness + anger + fear - joy)."""
    risk = F.avg("sadness_mean") + F.avg("anger_mean") + F.avg("fear_mean") - F.avg("joy_mean")
    clusters = labelled.groupBy(month, label).agg(risk.alias("_risk"))
    order = W.partitionBy(month).orderBy(F.round("_risk", 12), label)
    ranks = clusters.withColumn("cluster", F.row_number().over(order) - 1).drop("_risk")
    return labelled.join(ranks, [month, label])


def evolution_matrix(labels: DataFrame, months: Sequence[str] | None = None, key: str = "province",
                     month: str = "date_month", label: str = "cluster") -> DataFrame:
    """One row per key, one column per month, -1 where the key is absent."""
    wide = labels.groupBy(key)
    wide = wide.pivot(month, list(months)) if months is not None else wide.pivot(month)
    return wide.agg(F.first(label)).na.fill(-1)


def present_filter(labels: DataFrame, min_months: int = 6, key: str = "province") -> DataFrame:
    """Labels of keys present in at least ``min_months`` months."""
    kept = labels.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_months)
    return labels.join(kept.select(key), key, "left_semi")


def matrix_to_long(matrix: DataFrame, key: str = "province") -> DataFrame:
    """Matrix cells as rows, with ``present`` false for -1."""
    months = [c for c in matrix.columns if c != key]
    long = matrix.unpivot([key], months, "date_month", "cluster")
    return long.withColumn("present", F.col("cluster") >= 0)


def cluster_shifts(labels: DataFrame, top: int | None = 10, key: str = "province",
                   month: str = "date_month", label: str = "cluster") -> DataFrame:
    """Label changes between consecutive present months of each key, most first."""
    previous = F.lag(label).over(W.partitionBy(key).orderBy(month))
    changed = F.coalesce((F.col(label) != previous).cast("bigint"), F.lit(0))
    shifts = (
        labels.withColumn("_changed", changed)
        .groupBy(key)
        .agg(F.sum("_changed").alias("n_shifts"), F.count(F.lit(1)).alias("n_months"))
        .filter((F.col("n_shifts") > 0) & (F.col("n_months") >= 2))
    )
    return shifts if top is None else shifts.orderBy(F.col("n_shifts").desc(), key).limit(top)


# --- PCA and KMeans --------------------------------------------------------------------------


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_raw").transform(
        df.na.fill(0.0, list(features))
    )


def pca_scatter(vectors: DataFrame, features: Sequence[str] = domain.CLUSTER_FEATURES) -> DataFrame:
    """Two principal components ``x, y`` of the standardised features (sample deviation).

    Each axis is turned so that its largest loading is positive, the first of equal ones.
    """
    raw = _assembled(vectors, features)
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(raw)
    scaled = scaler.transform(raw)
    loadings = PCA(k=2, inputCol="_scaled", outputCol="_pc").fit(scaled).pc.toArray()
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    axes = []
    for axis in loadings.T:
        axis = axis * np.sign(axis[np.abs(axis).round(9).argmax()])
        terms = [
            (F.col(f) - float(m)) / float(s) * float(w)
            for f, m, s, w in zip(features, mean, std, axis) if s > 0
        ]
        axes.append(sum(terms, F.lit(0.0)))
    return vectors.na.fill(0.0, list(features)).withColumns({"x": axes[0], "y": axes[1]})


def kmeans_labels(scaled: DataFrame, key: str, features: Sequence[str], k: int, seed: int = SEED) -> DataFrame:
    """KMeans labels ``(key, label)`` for comparison with the Ward labels."""
    raw = _assembled(scaled, features)
    model = KMeans(k=k, featuresCol="_raw", predictionCol="label", seed=seed).fit(raw)
    return model.transform(raw).select(key, "label")
