"""Document log-likelihoods from a gated recurrent language model.

Word counts of all training documents are exact, kept as packed tables by word hash. Once they are known, texts
are turned into packed ids and staged, and the rest works on ids. The network is small
and sees the most frequent words: gated recurrent units, an output softmax factored into word classes, and
truncated backpropagation in numpy. All training documents train it, dealt to a few rounds by hash: each task
goes over its partition's documents of the round from the same weights, and the weights of all tasks are
averaged by their tokens. A document is scored whole:
its state is carried from window to window to the end. Words outside the network's vocabulary are one
class to it, and share that class's probability by their counts, so the model is a distribution over all
words with one unit of count left for unseen ones.

A broadcast table holds the counts of a bounded number of frequent words. The counts of all other words are
joined by hash in packed rows, each distinct word of a document once.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts
from feltgrid.operators.stage import stage


@dataclass(frozen=True)
class Limits:
    """Bounds of the model; all training documents are learnt from, whatever they are."""

    frequent: int = 131_072  # words whose counts are broadcast
    vocabulary: int = 1_500  # words the network tells apart, below 2^15
    units: int = 16
    window: int = 16
    streams: int = 512  # side by side in a task
    updates: int = 192  # of the weights, at least, in a task's share of a round
    rate: float = 0.03
    rounds: int = 3  # in which all training documents are learnt from, each in one of them


END = b"\n"  # no word contains white space
CACHE_WORDS = 400_000
CHUNK_TOKENS = 3_000_000
SCORED_AT_ONCE = 512  # lanes of documents
SCORED_BYTES = 8 << 20  # of ids
PIECES = 16  # in which weights are averaged
LN10 = math.log(10)


def tokens(text: str) -> list[bytes]:
    """Lower-cased words between ASCII white space, then one end."""
    out = text.encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


class Hashes(dict):
    """Signed 64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return out


# --- Counts ---------------------------------------------------------------------------------


def _buckets(spark) -> int:
    return 1 << max(3, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The upper bits of a hash."""
    return (hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - buckets.bit_length() + 1)


def _cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_bucket_of(sorted_hashes, buckets), np.arange(buckets + 1, dtype=np.uint64))


def word_counts(training: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hashes, counts): the exact count of every training word, sorted by hash in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Hashes(), [], 0
        for batch in slices(batches, "text", 4 << 20):
            for t in texts(batch, "text"):
                words = tokens(t)
                held.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                size += len(words)
            if size >= CHUNK_TOKENS:
                yield packed(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield packed(*np.unique(np.concatenate(held), return_counts=True))

    def packed(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cut = _cuts(words, buckets)
        some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(some, pa.int32()),
            "hashes": pa.array([words[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()),
            "counts": pa.array([counts[cut[b] : cut[b + 1]].astype(np.int64).tobytes() for b in some], pa.binary()),
        })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashes, counts = None, [], []
        for batch in batches:
            for b, h, c in zip(*(column(batch, n) for n in ("bucket", "hashes", "counts"))):
                if b != current and hashes:
                    yield merged(current, hashes, counts)
                    hashes, counts = [], []
                current = b
                hashes.append(np.frombuffer(h, np.int64))
                counts.append(np.frombuffer(c, np.int64))
        if hashes:
            yield merged(current, hashes, counts)

    def merged(bucket: int, hashes: list, counts: list) -> pa.RecordBatch:
        words, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([bucket], pa.int32()), "hashes": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary()),
            "distinct": pa.array([len(words)], pa.int64()), "total": pa.array([int(total.sum())], pa.int64()),
        })

    part = training.select("text").mapInArrow(count, "bucket int, hashes binary, counts binary")
    return part.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "bucket int, hashes binary, counts binary, distinct long, total long")


def frequent_words(counts: DataFrame, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of up to ``most`` frequent words, the most frequent first."""
    each = max(64, 4 * most // buckets)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(column(batch, "hashes"), column(batch, "counts")):
                h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
                k = np.lexsort((h, -c))[:each]
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[k]), "c": pa.array(c[k])})

    rows = counts.select("hashes", "counts").mapInArrow(top, "h long, c long").orderBy(F.desc("c"), "h").limit(most).toArrow()
    return rows.column("h").to_numpy(), rows.column("c").to_numpy()


def end_inside(hashes: np.ndarray, counts: np.ndarray, vocabulary: int, training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The same words, the end among the first ``vocabulary`` ones: where documents end, states begin anew."""
    end = xxhash.xxh3_64_intdigest(END) - (1 << 63)
    at = np.flatnonzero(hashes == end)
    if len(hashes) and not len(at):  # more frequent words than there are documents: one gives way
        hashes, counts, at = np.append(hashes[:-1], end), np.append(counts[:-1], training.count()), [len(hashes) - 1]
    if not len(hashes) or at[0] < vocabulary:
        return hashes, counts
    order = np.insert(np.delete(np.arange(len(hashes)), at[0]), vocabulary - 1, at[0])
    return hashes[order], counts[order]


# --- The network ----------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


SAFE_SCORE = 60.0  # of which no float32 exponential or sum of them overflows


def _largest(w: np.ndarray, b: np.ndarray) -> float:
    """No score ``h @ w + b`` exceeds this, as states lie between -1 and 1."""
    return float((np.abs(w).sum(axis=-2) + np.abs(b)).max())


def _exponentials(x: np.ndarray, safe: bool) -> np.ndarray:
    """Turns scores into exponentials, shifted by each row's largest unless they are ``safe``; returns the rows' sums."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _log_likelihoods(x: np.ndarray, target: np.ndarray, safe: bool) -> np.ndarray:
    """Logarithm of each row's softmax at its target; overwrites ``x``."""
    total = _exponentials(x, safe)
    return np.log(np.maximum(x[np.arange(len(x)), target] / total, 1e-37))


def _loss_gradient(x: np.ndarray, target: np.ndarray, scale: float, safe: bool) -> float:
    """Turns scores into ``scale`` times the gradient of their softmax loss, in place; returns the loss."""
    rows = np.arange(len(x))
    total = _exponentials(x, safe)
    x *= (scale / total)[:, None]
    loss = -float(np.log(np.maximum(x[rows, target] / scale, 1e-37)).sum())
    x[rows, target] -= scale
    return loss


class Network:
    """Gated recurrent units with a class-factored softmax; word 0 stands for all words outside.

    Words come sorted by frequency and are cut into classes of about the square root of their number;
    word 0 is a class of its own. All weights stand in one vector, ``flat``, of which ``p`` holds views.
    """

    def __init__(self, n_words: int, end: int, units: int):
        rng = np.random.default_rng(7)
        self.n, self.end, self.units = n_words, end, units
        size = max(1, math.isqrt(n_words))
        ids = np.arange(n_words)
        self.klass = np.where(ids == 0, 0, 1 + (ids - 1) // size).astype(np.int16)
        self.slot = np.where(ids == 0, 0, (ids - 1) % size).astype(np.int16)
        self.classes = int(self.klass.max()) + 1
        c = self.classes
        self.shapes = {"x": (n_words, 3 * units), "u": (units, 3 * units), "c": (units, c), "cb": (c,), "w": (c, units, size), "wb": (c, size)}
        self.use(np.zeros(sum(map(math.prod, self.shapes.values())), np.float32))
        for name in ("x", "u", "c", "w"):
            self.p[name][...] = rng.standard_normal(self.shapes[name]) * 0.1
        # Slots beyond a class's last word can never be meant.
        lengths = np.bincount(self.klass, minlength=c)
        self.p["wb"][np.arange(size)[None, :] >= lengths[:, None]] = -30

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([math.prod(x) for x in self.shapes.values()])
        return {k: part.reshape(x) for (k, x), part in zip(self.shapes.items(), np.split(flat, ends[:-1]))}

    def use(self, flat: np.ndarray) -> None:
        self.flat, self.p = flat, self.views(flat)

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple:
        x, s = self.p["x"][ids], self.units
        hu = h @ self.p["u"]
        zr = _sigmoid(x[:, : 2 * s] + hu[:, : 2 * s])
        z, r = zr[:, :s], zr[:, s:]
        n = np.tanh(x[:, 2 * s :] + r * hu[:, 2 * s :])
        return n + z * (h - n), z, r, n, hu[:, 2 * s :]

    def safe(self) -> tuple[bool, bool]:
        """Whether the scores of classes and of words are small enough to do without a shift."""
        return _largest(self.p["c"], self.p["cb"]) < SAFE_SCORE, _largest(self.p["w"], self.p["wb"]) < SAFE_SCORE

    def by_class(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of ``words`` by class, where each class begins in it, and the classes and slots in that order."""
        klass = self.klass[words]
        order = np.argsort(klass, kind="stable")
        klass = klass[order]
        return order, np.searchsorted(klass, np.arange(self.classes + 1)), klass, self.slot[words][order]

    def log_probabilities(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each word after each state."""
        order, cut, klass, slot = self.by_class(words)
        h = h[order]
        safe_class, safe_word = self.safe()
        found = _log_likelihoods(h @ self.p["c"] + self.p["cb"], klass, safe_class)
        for k in range(1, self.classes):
            a, b = cut[k], cut[k + 1]
            if a < b:
                found[a:b] += _log_likelihoods(h[a:b] @ self.p["w"][k] + self.p["wb"][k], slot[a:b], safe_word)
        out = np.empty(len(words), found.dtype)
        out[order] = found
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the mean loss over a window (steps, streams) as one vector, the last state and the loss.

        Backpropagation ends at the window's begin. A state is set to zero before the first word of a document.
        Words are sorted by class once, for both parts of the softmax.
        """
        (steps, streams), s = inputs.shape, self.units
        live = (inputs != self.end)[:, :, None]
        kept, states = [], np.empty((steps, streams, s), h.dtype)
        for t in range(steps):
            before = h * live[t]
            h, z, r, n, hn = self.step(inputs[t], before)
            kept.append((before, z, r, n, hn))
            states[t] = h
        words = targets.reshape(-1)
        m = len(words)
        flat = np.zeros_like(self.flat)
        g = self.views(flat)
        order, cut, klass, slot = self.by_class(words)
        sorted_h = states.reshape(m, s)[order]
        d = sorted_h @ self.p["c"] + self.p["cb"]
        safe_class, safe_word = self.safe()
        loss = _loss_gradient(d, klass, 1 / m, safe_class)
        g["c"][...], g["cb"][...] = sorted_h.T @ d, d.sum(0)
        back = d @ self.p["c"].T
        for k in range(1, self.classes):
            a, b = cut[k], cut[k + 1]
            if a < b:
                e = sorted_h[a:b] @ self.p["w"][k] + self.p["wb"][k]
                loss += _loss_gradient(e, slot[a:b], 1 / m, safe_word)
                g["w"][k], g["wb"][k] = sorted_h[a:b].T @ e, e.sum(0)
                back[a:b] += e @ self.p["w"][k].T
        dh_out = np.empty_like(back)
        dh_out[order] = back
        dh_out = dh_out.reshape(steps, streams, s)
        dh, rows = np.zeros((streams, s), h.dtype), np.empty((steps, streams, 3 * s), h.dtype)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, hn = kept[t]
            dh = dh + dh_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dx = rows[t]
            dx[:, :s] = dh * (before - n) * z * (1 - z)
            dx[:, s : 2 * s] = dn * hn * r * (1 - r)
            du = dx.copy()
            dx[:, 2 * s :] = dn
            du[:, 2 * s :] = dn * r
            g["u"] += before.T @ du
            dh = (dh * z + du @ self.p["u"].T) * live[t]
        met = inputs.reshape(-1)
        order = np.argsort(met, kind="stable")
        met = met[order]
        start = np.flatnonzero(np.append(True, met[1:] != met[:-1]))
        g["x"][met[start]] = np.add.reduceat(rows.reshape(m, 3 * s)[order], start)
        return flat, h, loss / m


class Adam:
    """Steps of the weights of a network."""

    def __init__(self, network: Network):
        self.network, self.turn = network, 0
        self.first, self.second = np.zeros_like(network.flat), np.zeros_like(network.flat)

    def step(self, g: np.ndarray, rate: float) -> None:
        """Moves the weights against ``g``, which is used up."""
        self.turn += 1
        np.clip(g, -1, 1, out=g)
        self.first *= 0.9
        self.first += 0.1 * g
        np.multiply(g, g, out=g)
        g -= self.second
        g *= 0.005
        self.second += g
        np.sqrt(self.second, out=g)
        g *= 1 / math.sqrt(1 - 0.995**self.turn)
        g += 1e-8
        np.divide(self.first, g, out=g)
        g *= rate / (1 - 0.9**self.turn)
        self.network.flat -= g


class Learner:
    """Truncated backpropagation over ids as they come, each of them a target once."""

    def __init__(self, network: Network, limits: Limits, rate: float):
        self.network, self.limits, self.rate, self.steps = network, limits, rate, Adam(network)
        self.held, self.size, self.last, self.tokens = [], 0, network.end, 0
        self.chunk = limits.streams * limits.window * limits.updates

    def add(self, ids: np.ndarray) -> None:
        while self.size + len(ids) >= self.chunk:
            cut = self.chunk - self.size
            self.held.append(ids[:cut])
            rest = self.learn(np.concatenate(self.held))
            ids = np.concatenate([rest, ids[cut:]])
            self.held, self.size = [], 0
        self.held.append(ids)
        self.size += len(ids)

    def finish(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.empty(0, np.int16)
        while len(rest):
            rest = self.learn(rest)
        self.held, self.size = [], 0

    def learn(self, ids: np.ndarray) -> np.ndarray:
        """One pass over ``ids`` in parallel streams; returns the few that do not fill all streams."""
        window = self.limits.window
        streams = max(1, min(self.limits.streams, len(ids) // (window * self.limits.updates)))
        length = len(ids) // streams
        n = streams * length
        inputs = np.append(self.last, ids[: n - 1]).astype(np.int16).reshape(streams, length).T
        targets = ids[:n].reshape(streams, length).T
        h = np.zeros((streams, self.network.units), np.float32)
        for at in range(0, length, window):
            g, h, _ = self.network.gradients(inputs[at : at + window], targets[at : at + window], h)
            self.steps.step(g, self.rate)
        self.last, self.tokens = ids[n - 1], self.tokens + n
        return ids[n:]


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Sequences dealt to lanes of nearly equal length, none much longer than the longest sequence."""
    if not len(lengths):
        return []
    count = int(max(1, min(most, len(lengths), lengths.sum() // lengths.max())))
    out, heap = [[] for _ in range(count)], [(0, k) for k in range(count)]
    for i in np.argsort(-lengths, kind="stable"):
        size, k = heap[0]
        out[k].append(int(i))
        heapq.heapreplace(heap, (size + int(lengths[i]), k))
    return out


def score_sequences(network: Network, sequences: list[np.ndarray], window: int) -> np.ndarray:
    """Sum of natural log probabilities of each sequence, each of which ends with an end.

    A lane goes on with the next sequence where one ends, from a state of zero, so lanes stay full; within a
    sequence the state is carried to its end.
    """
    dealt = lanes(np.array([len(x) for x in sequences], np.int64), SCORED_AT_ONCE)
    sizes = [sum(len(sequences[i]) for i in lane) for lane in dealt]
    order = sorted(range(len(dealt)), key=lambda k: -sizes[k])
    out, total = np.zeros(len(sequences)), np.array([sizes[k] for k in order], np.int64)
    longest = int(total.max(initial=0))
    words, logs = np.zeros((longest, len(order)), np.int16), np.zeros((longest, len(order)), np.float32)
    for row, k in enumerate(order):
        words[: total[row], row] = np.concatenate([sequences[i] for i in dealt[k]])
    h, last = np.zeros((len(order), network.units), np.float32), np.full(len(order), network.end, np.int16)
    for at in range(0, longest, window):
        stop, live = min(at + window, longest), int(np.searchsorted(-total, -at))  # lanes with words from ``at`` on
        h, last = h[:live], last[:live]
        states = np.empty((stop - at, live, network.units), np.float32)
        for t in range(at, stop):
            h = states[t - at] = network.step(last, h * (last != network.end)[:, None])[0]
            last = words[t, :live]
        logs[at:stop, :live] = network.log_probabilities(states.reshape(-1, network.units), words[at:stop, :live].reshape(-1)).reshape(stop - at, live)
    for row, k in enumerate(order):
        starts = np.cumsum([0, *(len(sequences[i]) for i in dealt[k][:-1])])
        out[dealt[k]] = np.add.reduceat(logs[: total[row], row].astype(np.float64), starts)
    return out


# --- The operator ---------------------------------------------------------------------------


def network_ids(found: np.ndarray, vocabulary: int) -> np.ndarray:
    """Network words of positions among the frequent words: the first ones count from 1, all others (-1 too) are 0."""
    return np.where(found < vocabulary, found + 1, 0).astype(np.int16)


class Positions(dict):
    """Position of a word among the frequent words, -1 for all others."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.known, self.hashes = {int(h): i for i, h in enumerate(hashes)}, Hashes()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.hashes.clear()
        h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        out = self[word] = self.known.get(h, -1)
        if out < 0:
            self.hashes[word] = h
        return out


def untrained(hashes: np.ndarray, limits: Limits) -> Network:
    """The network that the first round starts from."""
    vocabulary = min(limits.vocabulary, len(hashes))
    at = np.flatnonzero(hashes[:vocabulary] == xxhash.xxh3_64_intdigest(END) - (1 << 63))
    return Network(vocabulary + 1, int(at[0]) + 1 if len(at) else 0, limits.units)


def train_on_all(network: Network, training: DataFrame, limits: Limits) -> None:
    """One pass over the ids of all training documents in rounds, each from the token-weighted mean of all tasks' weights.

    Only weights travel: each task gives them in pieces, and a piece is summed as it streams in.
    """
    spark = training.sparkSession
    cuts = np.linspace(0, len(network.flat), PIECES + 1).astype(int)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, tokens_met = None, 0.0, 0
        for batch in batches:
            for piece, n, data in zip(*(column(batch, c) for c in ("piece", "tokens", "data"))):
                if piece != current and tokens_met:
                    yield averaged(current, total / tokens_met)
                    total, tokens_met = 0.0, 0
                current = piece
                total, tokens_met = total + n * np.frombuffer(data, np.float32).astype(np.float64), tokens_met + n
        if tokens_met:
            yield averaged(current, total / tokens_met)

    def averaged(piece: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "data": pa.array([values.astype(np.float32).tobytes()], pa.binary())})

    for turn in range(limits.rounds):
        shared = spark.sparkContext.broadcast(network)
        rate = limits.rate * max(0.1, 1 - turn / limits.rounds)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            own = copy.copy(shared.value)
            own.use(shared.value.flat.copy())  # a worker's other tasks start from the same weights
            learner = Learner(own, limits, rate)
            for batch in batches:
                for part in column(batch, "ids"):
                    learner.add(np.frombuffer(part, np.int16))
            learner.finish()
            if learner.tokens:
                yield pa.RecordBatch.from_pydict({
                    "piece": pa.array(range(PIECES), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * PIECES, pa.int32()),
                    "tokens": pa.array([learner.tokens] * PIECES, pa.int64()),
                    "data": pa.array([own.flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                })

        part = training.filter(F.pmod("_row", F.lit(limits.rounds)) == turn)
        weights = part.select("ids").mapInArrow(learn, "piece int, task int, tokens long, data binary")
        rows = weights.repartition(PIECES, "piece").sortWithinPartitions("piece", "task").mapInArrow(mean, "piece int, data binary").collect()
        if rows:
            network.use(np.concatenate([np.frombuffer(r.data, np.float32) for r in sorted(rows)]))


SUMS = "n_tokens long, known long, base double, outside double, n_outside long, ids binary"
PACKED = "bucket int, words binary, owners binary, times binary"


def encoded_rows(docs: DataFrame, hashes: np.ndarray, counts: np.ndarray, limits: Limits, buckets: int) -> DataFrame:
    """Staged rows of two kinds: each document's network ids and sums, and packed words that are not frequent.

    Training and scoring read these, so a text is cut into words here and for the counts only.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hashes, counts))
    vocabulary = min(limits.vocabulary, len(hashes))
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        log_count, known = np.append(np.log10(counts + 1.0), 0.0), Positions(hashes)
        for batch in slices(batches, "text", 8 << 20):
            rows = column(batch, "_row")
            sequences, sums, rare, owners, listed = [], [], [], [], set()
            for row, t in zip(rows, texts(batch, "text")):
                words = tokens(t)
                found = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                logs, ids = log_count[found], network_ids(found, vocabulary)  # 0 for words that are not frequent
                rest = np.flatnonzero(found < 0)
                sums.append((len(words), len(words) - len(rest), float(logs.sum()), float(logs[ids == 0].sum()), len(ids) - int(np.count_nonzero(ids))))
                sequences.append(ids.tobytes())
                if len(rest) and row not in listed:  # equal rows list their rare words once
                    listed.add(row)
                    rare.append(np.fromiter((known.hashes[words[i]] for i in rest.tolist()), np.int64, len(rest)))
                    owners.append(np.full(len(rest), row, np.int64))
            n = len(rows)
            doc = [batch.column(batch.schema.get_field_index(c)) for c in ("_row", "doc_id", "held_out")]
            values = [*zip(*sums)] if sums else [[]] * 5
            none = [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(3))]
            names = ["_row", "doc_id", "held_out", "n_tokens", "known", "base", "outside", "n_outside", "ids", "bucket", "words", "owners", "times"]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*doc, *(pa.array(v, t) for v, t in zip(values, types)), pa.array(sequences, pa.binary()), *none], names)
            if rare:
                yield packed(np.concatenate(rare), np.concatenate(owners), doc[1].type, names)

    def packed(words: np.ndarray, owners: np.ndarray, id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
        order = np.lexsort((owners, words))
        words, owners = words[order], owners[order]
        start = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (owners[1:] != owners[:-1])))
        times = np.diff(np.append(start, len(words))).astype(np.int32)
        words, owners = words[start], owners[start]
        cut = _cuts(words, buckets)
        some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        k = len(some)
        blobs = [pa.array([v[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()) for v in (words, owners, times)]
        empty = [pa.nulls(k, t) for t in (pa.int64(), id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*empty, pa.array(some, pa.int32()), *blobs], names)

    return stage(docs.select("_row", "doc_id", "held_out", "text").mapInArrow(run, f"_row long, doc_id {key}, held_out boolean, {SUMS}, {PACKED}"))


def network_scores(encoded: DataFrame, network: Network, limits: Limits) -> DataFrame:
    """``encoded`` documents with ``network``, the decimal logarithm of the probability of their ids, in place of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(network)
    names = [c for c in encoded.columns if c != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", SCORED_BYTES):
            found = score_sequences(shared.value, [np.frombuffer(x, np.int16) for x in column(batch, "ids")], limits.window) / LN10
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found)], [*names, "network"])

    return encoded.mapInArrow(run, f"{schema}, network double")


def rare_sums(packed: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(_row, rare, rare_known): for each document the sum of log10(count + 1) of its rare words."""
    both = counts.select("bucket", F.lit(0).alias("kind"), F.col("hashes").alias("words"), F.col("counts").alias("owners"), F.lit(None).cast("binary").alias("times"))
    both = both.unionByName(packed.select("bucket", F.lit(1).alias("kind"), "words", "owners", "times"))
    dealt = both.repartition("bucket").sortWithinPartitions("bucket", "kind")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, total, parts = None, np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            for b, kind, words, owners, times in zip(*(column(batch, c) for c in ("bucket", "kind", "words", "owners", "times"))):
                if b != current:
                    if parts:
                        yield summed(known, total, parts)
                    current, known, total, parts = b, np.empty(0, np.int64), np.empty(0, np.int64), []
                if kind == 0:
                    known, total = np.frombuffer(words, np.int64), np.frombuffer(owners, np.int64)
                else:
                    parts.append((np.frombuffer(words, np.int64), np.frombuffer(owners, np.int64), np.frombuffer(times, np.int32)))
        if parts:
            yield summed(known, total, parts)

    def summed(known: np.ndarray, total: np.ndarray, parts: list) -> pa.RecordBatch:
        words, owners, times = (np.concatenate(x) for x in zip(*parts))
        # Equal rows of the table have one key and list the same words: each counts once.
        order = np.lexsort((owners, words))
        words, owners, times = words[order], owners[order], times[order]
        fresh = np.append(True, (words[1:] != words[:-1]) | (owners[1:] != owners[:-1]))
        words, owners, times = words[fresh], owners[fresh], times[fresh]
        c = np.zeros(len(words), np.int64)
        if len(known):
            k = np.searchsorted(known, words)
            k[k == len(known)] = 0
            c = np.where(known[k] == words, total[k], 0)
        rows, where = np.unique(owners, return_inverse=True)
        sums, met = np.bincount(where, times * np.log10(c + 1.0)), np.bincount(where, times * (c > 0)).astype(np.int64)
        target = _bucket_of(rows, buckets).astype(np.int64)
        order = np.argsort(target, kind="stable")
        target, rows, sums, met = target[order], rows[order], sums[order], met[order]
        cut = np.searchsorted(target, np.arange(buckets + 1))
        some = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        blobs = {n: pa.array([v[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary()) for n, v in (("rows", rows), ("sums", sums), ("met", met.astype(np.int32)))}
        return pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), **blobs})

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for p, *cells in zip(*(column(batch, c) for c in ("part", "rows", "sums", "met"))):
                if p != current and parts:
                    yield added(parts)
                    parts = []
                current = p
                parts.append([np.frombuffer(x, t) for x, t in zip(cells, (np.int64, np.float64, np.int32))])
        if parts:
            yield added(parts)

    def added(parts: list) -> pa.RecordBatch:
        rows, sums, met = (np.concatenate(x) for x in zip(*parts))
        keys, where = np.unique(rows, return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "_row": pa.array(keys), "rare": pa.array(np.bincount(where, sums)), "rare_known": pa.array(np.bincount(where, met).astype(np.int64)),
        })

    sums = dealt.mapInArrow(look_up, "part int, rows binary, sums binary, met binary").repartition("part").sortWithinPartitions("part")
    return sums.mapInArrow(collect, "_row long, rare double, rare_known long")


def score_documents(
    docs: DataFrame, held_out: Callable[[Column], Column], doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows for which ``held_out(id column)`` is false or null train the model. A null text is empty: it has
    its end token. Repeated rows are scored alike and train each for itself; null ids are kept. With no
    training rows all counts are 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = _buckets(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"))
    docs = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    training = docs.filter(~F.col("held_out"))
    counts = stage(word_counts(training, buckets))
    distinct, total = counts.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    hashes, frequent = end_inside(*frequent_words(counts, limits.frequent, buckets), limits.vocabulary, training)
    rows = encoded_rows(docs, hashes, frequent, limits, buckets)
    encoded = rows.filter(F.col("bucket").isNull()).select("_row", "doc_id", "held_out", "n_tokens", "known", "base", "outside", "n_outside", "ids")
    network = untrained(hashes, limits)
    train_on_all(network, encoded.filter(~F.col("held_out")), limits)
    inside = frequent[: limits.vocabulary]
    rare = rare_sums(rows.filter(F.col("bucket").isNotNull()), counts, buckets)
    base = math.log10(total + distinct + 1)
    outside = math.log10(total - int(inside.sum()) + distinct - len(inside) + 1)
    joined = network_scores(encoded, network, limits).join(rare, "_row", "left")
    tail = F.coalesce("rare", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + tail - F.col("n_tokens") * base).alias("base_score"),
        (F.col("network") + F.col("outside") + tail - F.col("n_outside") * outside).alias("score"),
    )
