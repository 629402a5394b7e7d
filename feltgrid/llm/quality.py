"""A quality classifier without hand-made labels.

Overlapping heuristic labellers vote low, good or nothing on every document. The votes of all documents
are counted by pattern, and expectation-maximisation over the counted patterns estimates how often each
labeller casts each vote on good and on low documents. The resulting posterior of each pattern is the
training target of a hashed linear scorer, which then scores all documents whole, by itself.

The labellers see only what they were written for and answer in three grades; the scorer sees the shapes and
the endings of all words and the measures behind the votes as numbers, but no votes. So it also judges documents on which every
labeller keeps silent, and cannot repeat the labellers' rules.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts

SAMPLE = 20_000  # documents that the scorer is fitted to: a bound, not a share
DIMENSIONS = 1 << 12
EPOCHS = 12
ROUNDS = 40
PRIOR_SHARE = 0.2
PRIOR_LOW = (0.001, 0.3)  # of a low vote on a good and on a low document
KEEP = 0.5
CACHE_ENTRIES = 300_000
PIECE = 64  # characters of a word whose shape is one feature
ENDING = 3  # characters of a word that are one feature
ENDING_WEIGHT = 0.5
SILENT, LOW, GOOD = 0, 1, 2

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_SIGNS = b"%$#*&@^~=|<>{}[]\\/+_"


@dataclass
class Facts:
    """What the labellers look at."""

    words: int
    chars: int
    signs: float
    capitals: float
    shouts: float
    bare: float
    repeated: float
    runs: float
    distinct: float
    copied_lines: float
    letters: float
    tails: float


def facts(text: str, words: list[str], counts: Counter) -> Facts:
    follows = sum(map(str.__eq__, words, words[1:]))
    in_runs = sum(k for k in (len(list(g)) for _, g in groupby(words)) if k >= 4) if 20 * follows > len(words) else 0
    raw, n, size = text.encode(), max(1, sum(counts.values())), max(1, len(text))
    upper, lower = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _LOWER))
    lines = [x for x in text.split("\n") if x.strip()]
    wordlike = sum(k for w, k in counts.items() if any(map(str.isalnum, w)))
    beyond = sum(map(str.isalpha, text)) if not text.isascii() else upper + lower
    return Facts(
        words=sum(counts.values()), chars=len(text),
        signs=(len(raw) - len(raw.translate(None, _SIGNS))) / size,
        capitals=upper / max(1, upper + lower), shouts=text.count("!") / n, bare=1 - wordlike / n,
        repeated=follows / n, runs=in_runs / n, distinct=len(counts) / n, copied_lines=1 - len(set(lines)) / max(1, len(lines)),
        letters=beyond / max(1, size - text.count(" ")),
        tails=sum(k for w, k in counts.items() if not w[-1].isalnum() and not w[-2:-1].isalnum() and len(w) > 2) / n,
    )


def _between(value: float, good: float, low: float) -> int:
    """Good up to ``good``, low from ``low`` on, silent in between."""
    return GOOD if value <= good else LOW if value >= low else SILENT


LABELLERS = {
    "signs": lambda f: _between(f.signs, 0.005, 0.03),
    "capitals": lambda f: _between(f.capitals, 0.2, 0.5) if f.words >= 5 else SILENT,
    "shouts": lambda f: _between(f.shouts, 0.05, 0.3),
    "bare": lambda f: _between(f.bare, 0.05, 0.2),
    "repeated": lambda f: _between(f.repeated, 0.06, 0.3) if f.words >= 10 else SILENT,
    "runs": lambda f: _between(f.runs, 0.05, 0.3) if f.words >= 10 else SILENT,
    "distinct": lambda f: _between(1 - f.distinct, 0.6, 0.95) if f.words >= 30 else SILENT,
    "lines": lambda f: LOW if f.copied_lines > 0.6 else SILENT,
    "length": lambda f: SILENT if not f.words else GOOD if 2.5 <= f.chars / f.words <= 14 else LOW,
    "letters": lambda f: _between(1 - f.letters, 0.2, 0.3) if f.words >= 15 else SILENT,
    "tails": lambda f: _between(f.tails, 0.05, 0.2),
}


def votes(f: Facts) -> int:
    """All votes as one number in base three, the first labeller's the lowest digit."""
    return sum(label(f) * 3**k for k, label in enumerate(LABELLERS.values()))


def digits(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(len(LABELLERS))]


# --- Expectation-maximisation ---------------------------------------------------------------


@dataclass
class LabelModel:
    """Share of low documents, and P(vote | class, labeller votes): shape (labellers, 2, 3).

    A silent labeller says nothing about the class: few words silence several at once.
    """

    low: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(low) of rows of votes."""
        return 1 / (1 + np.exp(-self.log_odds(patterns)))

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.table)
        logs[:, :, SILENT] = 0.0
        k = np.arange(patterns.shape[1])
        good, low = logs[k, 0, patterns].sum(1) + np.log(1 - self.low), logs[k, 1, patterns].sum(1) + np.log(self.low)
        return np.clip(low - good, -60, 60)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Start from the documents that any labeller calls low, then alternate until ``rounds``.

    Kinds of junk hardly overlap, so votes alone do not say which of two groups is the low one. A prior
    worth a fifth of the documents does: labellers seldom call a good document low (``PRIOR_LOW``).
    """
    total = max(1.0, counts.sum())
    p = np.where((patterns == LOW).any(1), 0.9, 0.02)
    model = LabelModel(0.1, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        table = np.empty_like(model.table)
        for c, weight in enumerate((counts * (1 - p), counts * p)):
            strength = PRIOR_SHARE * (total if c == 0 else weight.sum()) + 1
            for v, prior in ((LOW, PRIOR_LOW[c]), (GOOD, 1 - PRIOR_LOW[c])):
                table[:, c, v] = (weight[:, None] * (patterns == v)).sum(0) + strength * prior
        table[:, :, SILENT] = 0.0
        table /= table.sum(2, keepdims=True)
        table[:, :, SILENT] = 1.0
        share = float((counts * p).sum() / total)
        model = LabelModel(min(0.95, max(0.001, share)), table)
        p = model.posterior(patterns)
    return model


# --- The scorer -----------------------------------------------------------------------------


class Endings(dict):
    """Hashed column of the ending of a word, as met."""

    def __missing__(self, ending: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[ending] = zlib.crc32(b"\1" + ending.encode()) % DIMENSIONS
        return out


class Shapes(dict):
    """Hashed column of the shape of a word or of a piece of one, as met: letters as A or a, digits as 0, runs as one sign."""

    def __init__(self):
        super().__init__()
        self.endings = Endings()

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        signs = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        shape = "".join(c for i, c in enumerate(signs) if not i or c != signs[i - 1])
        out = self[word] = zlib.crc32(shape.encode()) % DIMENSIONS
        return out


def hashed(text: str, shapes: Shapes) -> tuple[dict[int, float], int]:
    """Sparse features and the votes: shares of word shapes and word endings, and the measures of the text.

    Shares are taken of ``n + 20`` words, so that the few words of a short text weigh little. Of a word of
    more than ``PIECE`` characters, each piece of that length counts as a word's shape.
    """
    words = text.split()
    counts = Counter(words)
    n = len(words) + 20
    pieces = Counter()
    for word, k in counts.items():
        if len(word) <= PIECE:
            pieces[word] += k
        else:
            for at in range(0, len(word), PIECE):
                pieces[word[at : at + PIECE]] += k
    shares = pieces.total() + 20
    seen = facts(text, words, counts)
    pattern = votes(seen)
    x: dict[int, float] = {}
    for piece, k in pieces.items():
        at = shapes[piece]
        x[at] = x.get(at, 0.0) + k / shares
    endings = shapes.endings
    for word, k in counts.items():
        at = endings[word[-ENDING:]]
        x[at] = x.get(at, 0.0) + ENDING_WEIGHT * k / n
    named = {"variety": (len(counts) + 20) / n, "bias": 3.0, "letters": seen.letters, "length": min(4.0, seen.chars / max(1, seen.words) / 10)}
    # Roots, so that a few in a hundred are seen.
    named |= {name: getattr(seen, name) ** 0.5 for name in ("signs", "capitals", "bare", "repeated", "runs", "copied_lines", "tails")}
    named["shouts"] = min(1.0, seen.shouts) ** 0.5
    for name, value in named.items():
        at = zlib.crc32(b"\0" + name.encode()) % DIMENSIONS
        x[at] = x.get(at, 0.0) + value
    return x, pattern


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights for P(low) by stochastic gradient steps with per-weight rates, in the order of ``rows``."""
    w, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-3)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, target = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))
            g = (p - target) * x
            seen[at] += g * g
            w[at] -= 0.5 * g / np.sqrt(seen[at])
    return w


# --- The operator ---------------------------------------------------------------------------


def vote_patterns(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns of all documents and their counts; at most 3 to the number of labellers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in texts(batch, "text"):
                words = t.split()
                seen[votes(facts(t, words, Counter(words)))] += 1
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = sorted(tuple(r) for r in docs.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n")).collect())
    return np.array([digits(p) for p, _ in rows], np.int64).reshape(-1, len(LABELLERS)), np.array([n for _, n in rows], float)


def training_rows(docs: DataFrame, model: LabelModel, sample: int) -> list:
    """Sparse features and posteriors of up to ``sample`` documents, the first by a hash of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in slices(batches, "text"):
            found = [hashed(t, shapes) for t in texts(batch, "text")]
            y = shared.value.posterior(np.array([digits(p) for _, p in found]).reshape(-1, len(LABELLERS)))
            yield pa.RecordBatch.from_pydict({
                "at": pa.array([np.fromiter(x, np.int16, len(x)).tobytes() for x, _ in found], pa.binary()),
                "x": pa.array([np.fromiter(x.values(), np.float32, len(x)).tobytes() for x, _ in found], pa.binary()),
                "y": pa.array(y, pa.float64()),
            })

    draw = F.xxhash64("doc_id", "text")
    chosen = docs.select(draw.alias("_draw")).orderBy("_draw").limit(sample).agg(F.max("_draw")).first()[0]
    if chosen is None:
        return []
    # Packed, the sample is a few dozen megabytes; sorted, so that the order of tasks does not matter.
    found = docs.filter(draw <= chosen).mapInArrow(run, "at binary, x binary, y double").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("at", "x", "y"))))
    return [(np.frombuffer(at, np.int16).astype(np.int64), np.frombuffer(x, np.float32), y) for at, x, y in rows]


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``quality`` (0 to 1, higher is better) and ``keep`` (``quality`` of 0.5 or more).

    A null or empty text has no words and is scored like any other. Ids may be null, repeated or of any
    type, and repeated rows are scored alike. Columns of ``docs`` named quality or keep are replaced. An
    empty table gives no rows.
    """
    docs = docs.drop("quality", "keep")
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    patterns, counts = vote_patterns(plain)
    model = expectation_maximisation(patterns, counts)
    weights = fit_linear(training_rows(plain, model, sample))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shapes = shared.value.tolist(), Shapes()
        for batch in slices(batches, text):
            found = [hashed(t, shapes) for t in texts(batch, text)]
            low = np.array([sum(w[k] * v for k, v in x.items()) for x, _ in found])
            out = 1 / (1 + np.exp(np.clip(low, -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.float64()), pa.array(out >= KEEP, pa.bool_())], [*batch.schema.names, "quality", "keep"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{schema}, quality double, keep boolean")
