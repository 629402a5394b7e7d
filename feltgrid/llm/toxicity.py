"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a list of insults and what is learned: words and word beginnings that are far more frequent
in labelled toxic documents.
Features are densities of its entries, their distance to words that address the reader, and rates of
capitals, punctuation and disguised spelling. A bounded sample of labelled documents (``Limits``) is cut
into three parts by document: one for the lexicon, one for the trees, one for the calibration. Scoring
covers every document whole, inside one map over the scan.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts


@dataclass(frozen=True)
class Limits:
    """Bounds of the labelled sample and of the model."""

    toxic: int = 8_000
    clean: int = 16_000
    entries: int = 5_000
    least_documents: int = 4
    least_log_odds: float = 2.5
    trees: int = 40
    depth: int = 3
    bins: int = 32
    rate: float = 0.2


FEATURES = 11
PREFIXES = (4, 5, 6)
CACHE_ENTRIES = 300_000

#: Words that address the reader, in the four languages of the corpus.
SECOND_PERSON = """
you your yours yourself u ur du dich dir dein deine deinen ihr euch sie tu te toi ton ta tes vous votre
vos usted ustedes ti tus vosotros
""".split()

#: Common insults, known without labels.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid dumb imbecile loser losers pathetic scum worthless trash
garbage clown clowns disgusting jerk fool freak creep scumbag dumbass bastard bitch asshole shit fuck fucking
dummkopf trottel blödmann arschloch scheisse scheiße hurensohn schwachkopf
imbécile connard connasse salaud salope crétin abruti débile merde
imbécil estúpido estúpida tonto tonta pendejo cabrón gilipollas puta mierda basura
""".split()
INSULT_WEIGHT = 3.0

#: Signs that stand for letters in disguised spelling.
DISGUISES = str.maketrans("013457@$!", "oieastasi")

_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"!?.,;:'\"()-"
_SIGNS = b"%$#*&@^~=|<>{}[]\\/+_"


def entries_of(word: str) -> tuple[str, ...]:
    """The lexicon entries that a lower-cased word counts for: itself and its beginnings."""
    return (word, *(word[:n] + "-" for n in PREFIXES if len(word) > n))


def plain(word: str) -> str:
    """A word in lower case without the marks around it."""
    return word.lower().strip("!?.,;:'\"()-%$#*&@^~=|<>{}[]\\/+_")


def clear(word: str) -> str:
    """A disguised word spelled out: signs read as letters, all other signs dropped."""
    return "".join(c for c in word.lower().translate(DISGUISES) if c.isalpha())


class WordWeights(dict):
    """(weight, weight when spelled out, addresses the reader, looks disguised) of raw words, as met."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.second = lexicon, frozenset(SECOND_PERSON)

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(e, 0.0) for e in entries_of(word)), default=0.0)

    def __missing__(self, word: str) -> tuple[float, float, bool, bool]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        base = plain(word)
        odd = not base.isalpha() and any(c.isalpha() for c in base)
        found = self.weight(base)
        out = self[word] = (found, 0.0 if found or not odd else self.weight(clear(base)), base in self.second, odd)
        return out


def features(text: str, weights: WordWeights) -> list[float]:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    raw = text.encode()
    hits, best, total, hidden, odd = [], 0.0, 0.0, 0.0, 0
    seconds = []
    for i, w in enumerate(words):
        weight, spelled, second, disguised = weights[w]
        if weight or spelled:
            hits.append(i)
            best, total = max(best, weight, spelled), total + weight + spelled
            hidden += spelled > 0
        if second:
            seconds.append(i)
        odd += disguised
    near = 0.0
    if hits and seconds:
        at, to = np.array(hits), np.array(seconds)
        k = np.searchsorted(to, at)
        gap = np.minimum(np.abs(to[np.minimum(k, len(to) - 1)] - at), np.abs(to[np.maximum(k - 1, 0)] - at))
        near = 1.0 / (1.0 + float(gap.min()))
    return [
        len(hits) / n, math.log1p(len(hits)), best, total / n, near,
        (len(raw) - len(raw.translate(None, _UPPER))) / size,
        (len(raw) - len(raw.translate(None, _MARKS))) / size,
        text.count("!") / n, (odd + len(raw) - len(raw.translate(None, _SIGNS))) / size, hidden / n, math.log1p(n),
    ]


# --- Trees and calibration ------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees over binned features: node arrays of each tree, and the prior log odds."""

    edges: list[np.ndarray]
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    prior: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, limits: Limits) -> Trees:
    """Newton boosting of the logistic loss with complete trees of ``limits.depth``."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, limits.bins + 1)[1:-1])) for j in range(x.shape[1])]
    mean = float(np.clip(y.mean(), 0.01, 0.99))
    model = Trees(edges, [], math.log(mean / (1 - mean)), limits.depth)
    b = model.binned(x)
    score = np.full(len(y), model.prior)
    inner = 2**limits.depth - 1
    for _ in range(limits.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 1 << 30)
        at = np.zeros(len(y), np.int64)
        for level in range(limits.depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            for j in range(x.shape[1]):
                width = len(edges[j]) + 1
                cell = (at - first) * width + b[:, j]
                gs = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                k = gain[:, :-1].argmax(1) if width > 1 else np.zeros(count, np.int64)
                top = gain[np.arange(count), k] if width > 1 else np.zeros(count)
                better = top > best
                feature[first : first + count][better], cut[first : first + count][better] = j, k[better]
                best[better] = top[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaves = 2 ** (limits.depth + 1) - 1
        value = limits.rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        model.nodes.append((feature, cut, value))
        score += value[at]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and non-decreasing probabilities to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == s:  # tied scores are one block
            blocks[-1][0] += t
            blocks[-1][1] += 1
        else:
            blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    xs = [x for _, _, lo, hi in blocks for x in (lo, hi)]
    ps = [p for t, n, _, _ in blocks for p in [(t + 0.5 * (t > 0)) / (n + 1)] * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


# --- The operator ---------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    xs: np.ndarray
    ps: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), float(self.ps[0]))
        return np.clip(np.interp(self.trees.raw(x), self.xs, self.ps), 0.0, 1.0)


def fold(key: object, folds: int = 3) -> int:
    return zlib.crc32(str(key).encode()) % folds


def labelled_sample(labels: DataFrame, label: str, usable: Callable, limits: Limits) -> dict:
    """Label and part of a bounded number of documents, the first ones by a hash of their id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    draw = F.xxhash64("doc_id", F.lit("sample"))
    out = {}
    for y, most in ((1, limits.toxic), (0, limits.clean)):
        for row in known.filter(F.col("y") == y).orderBy(draw, "doc_id").limit(most).select("doc_id").collect():
            out[row.doc_id] = (y, zlib.crc32(b"part" + str(row.doc_id).encode()) % 10)
    return out


def learn_lexicon(docs: DataFrame, sample: dict, limits: Limits) -> dict[str, float]:
    """Log odds of the entries that mark toxic documents of the lexicon's part of the sample."""
    part = {k: y for k, (y, p) in sample.items() if p < 4}
    n_toxic = max(1, sum(part.values()))
    n_clean = max(1, len(part) - sum(part.values()))
    known = docs.sparkSession.sparkContext.broadcast(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in slices(batches, "text"):
            for key, text in zip(column(batch, "doc_id"), texts(batch, "text")):
                if key in known.value:
                    words = {plain(w) for w in text.split()}
                    seen[known.value[key]].update({e for w in words if w for e in entries_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array(names, pa.string()),
            "clean": pa.array([seen[0][e] for e in names], pa.int64()),
            "toxic": pa.array([seen[1][e] for e in names], pa.int64()),
        })

    counts = docs.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / n_clean)
    best = (
        counts.filter(F.col("toxic") >= limits.least_documents)
        .select("entry", odds.alias("odds"), "toxic")
        .filter(F.col("odds") >= limits.least_log_odds)
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "entry")
        .limit(limits.entries)
    )
    return dict.fromkeys(INSULTS, INSULT_WEIGHT) | {row.entry: float(row.odds) for row in best.collect()}


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = WordWeights(shared.value.lexicon)
        for batch in slices(batches, "text"):
            x = np.array([features(t, weights) for t in texts(batch, "text")]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(shared.value.scores(x), pa.float64())], ["doc_id", "score"]
            )

    return docs.mapInArrow(score, f"doc_id {key}, score double")


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Callable, limits: Limits) -> Model:
    """The model; without labels of both kinds in each part, the share of label 1 is every score."""
    sample = labelled_sample(labels, label, usable, limits)
    share = sum(y for y, _ in sample.values()) / len(sample) if sample else 0.0
    lexicon = learn_lexicon(docs, sample, limits) if sample else dict.fromkeys(INSULTS, INSULT_WEIGHT)
    rows = sample_features(docs, {k: v for k, v in sample.items() if v[1] >= 4}, lexicon) if sample else []
    x = np.array([r[1] for r in rows]).reshape(-1, FEATURES)
    y = np.array([sample[r[0]][0] for r in rows], float)
    tree_part = np.array([sample[r[0]][1] < 8 for r in rows], bool)
    if len(set(y[tree_part])) < 2 or len(set(y[~tree_part])) < 2:
        return Model(lexicon, None, np.zeros(1), np.array([share]))
    trees = boost(x[tree_part], y[tree_part], limits)
    xs, ps = isotonic(trees.raw(x[~tree_part]), y[~tree_part])
    return Model(lexicon, trees, xs, ps)


def sample_features(docs: DataFrame, sample: dict, lexicon: dict[str, float]) -> list:
    """(id, features) of the sampled documents, in the order of their ids and texts."""
    shared = docs.sparkSession.sparkContext.broadcast((set(sample), lexicon))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lexicon = shared.value
        weights = WordWeights(lexicon)
        for batch in slices(batches, "text"):
            found = [(k, features(t, weights)) for k, t in zip(column(batch, "doc_id"), texts(batch, "text")) if k in ids]
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], kind), pa.array([v for _, v in found], pa.list_(pa.float64()))], ["doc_id", "x"])

    return sorted((tuple(r) for r in docs.mapInArrow(run, f"doc_id {key}, x array<double>").collect()), key=lambda r: (str(r[0]), r[1]))


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    usable: Callable = lambda key: F.lit(True), limits: Limits = Limits(),
) -> DataFrame:
    """(doc_id, score) of every row; ``usable(id column)`` tells which labels may be learned from.

    Null and empty texts have features of zero and a score like any other. Null ids are scored and never
    learned from; of conflicting labels of one id the larger counts, null labels do not. Repeated rows are
    scored alike; other columns are not read. Without usable labels every score is 0.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    labels = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias(label))
    return score_documents(docs, fit(docs, labels, label, usable, limits))
