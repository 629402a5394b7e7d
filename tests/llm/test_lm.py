import collections
import math

import numpy as np
from helpers import ROWS, docs

from feltgrid.llm import lm

SMALL = lm.Limits(frequent=40, vocabulary=12, units=6, window=8, streams=4, updates=20)


def test_base_scores_match_brute_force(spark):
    held = lambda key: key % 3 == 0
    found = lm.score_documents(docs(spark), held, limits=SMALL).collect()
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = collections.Counter(w for r in ROWS if r[0] is None or r[0] % 3 for w in words(r[1]))
    total, distinct = sum(c.values()), len(c)

    def want(r):
        w = words(r[1])
        base = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)
        return str(r[0]), bool(r[0] is not None and r[0] % 3 == 0), len(w), sum(c[x] > 0 for x in w), total, round(base, 6)

    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == sorted(map(want, ROWS))
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    same = collections.defaultdict(set)
    for r in found:
        same[r.doc_id].add(round(r.score, 9))
    assert len(same[11]) == 1


def test_no_rows_and_no_training(spark):
    assert lm.score_documents(docs(spark, []), lambda key: key % 2 == 0, limits=SMALL).count() == 0
    rows = lm.score_documents(docs(spark, ROWS[:3]), lambda key: key > 0, limits=SMALL).collect()
    assert len(rows) == 3 and all(r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_gradients():
    net = lm.Network(11, 1, 5)
    net.use(net.flat.astype(np.float64))
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 11, (7, 3))
    h0 = rng.standard_normal((3, 5))
    grads = net.views(net.gradients(ids[:-1], ids[1:], h0)[0])
    for name, g in grads.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 12)]:
            keep = net.p[name][at]
            if keep == -30:
                continue
            net.p[name][at] = keep + 1e-5
            up = net.gradients(ids[:-1], ids[1:], h0)[2]
            net.p[name][at] = keep - 1e-5
            down = net.gradients(ids[:-1], ids[1:], h0)[2]
            net.p[name][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5, name


def test_probabilities_sum_to_one_and_training_helps():
    net = lm.Network(20, 1, 8)
    h = np.random.default_rng(1).standard_normal((1, 8)).astype(np.float32)
    total = sum(math.exp(net.log_probabilities(h, np.array([w]))[0]) for w in range(20))
    assert abs(total - 1) < 1e-4
    ids = np.tile(np.array([1, 3, 5, 7, 9, 11], np.int16), 700)
    before = lm.score_sequences(net, [ids], 8)[0]
    learner = lm.Learner(net, lm.Limits(units=8, streams=8, window=8, updates=60), 0.02)
    learner.add(ids)
    learner.finish()
    assert lm.score_sequences(net, [ids], 8)[0] > before / 2


def plain_log_probability(p, ids, end):
    """Natural logarithm of the network's probability of ``ids``, one number at a time."""
    units, classes, size = len(p["u"]), len(p["cb"]), len(p["wb"][0])
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def log_softmax(scores, k):
        top = max(scores)
        return scores[k] - top - math.log(sum(math.exp(v - top) for v in scores))

    h, last, total = [0.0] * units, end, 0.0
    for word in ids:
        x = p["x"][last]
        hu = [sum(h[i] * p["u"][i][j] for i in range(units)) for j in range(3 * units)]
        z = [sigmoid(x[j] + hu[j]) for j in range(units)]
        r = [sigmoid(x[units + j] + hu[units + j]) for j in range(units)]
        n = [math.tanh(x[2 * units + j] + r[j] * hu[2 * units + j]) for j in range(units)]
        h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(units)]
        klass, slot = (0, 0) if word == 0 else (1 + (word - 1) // size, (word - 1) % size)
        total += log_softmax([sum(h[i] * p["c"][i][j] for i in range(units)) + p["cb"][j] for j in range(classes)], klass)
        if klass:
            total += log_softmax([sum(h[i] * p["w"][klass][i][j] for i in range(units)) + p["wb"][klass][j] for j in range(size)], slot)
        last = word
    return total


def test_scores_match_plain_python(spark, monkeypatch):
    kept = {}
    inner = lm.network_scores

    def spy(encoded, network, limits):
        kept["network"] = network
        return inner(encoded, network, limits)

    monkeypatch.setattr(lm, "network_scores", spy)
    found = lm.score_documents(docs(spark).coalesce(2), lambda key: key % 3 == 0, limits=SMALL).collect()
    net = kept["network"]
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = collections.Counter(w for r in ROWS if r[0] is None or r[0] % 3 for w in words(r[1]))
    signed = lambda w: lm.xxhash.xxh3_64_intdigest(w) - (1 << 63)
    head = sorted(c, key=lambda w: (-c[w], signed(w)))[: SMALL.vocabulary]
    if b"\n" not in head:
        head[-1] = b"\n"
    ids = {w: i + 1 for i, w in enumerate(head)}
    assert ids[b"\n"] == net.end
    outside = sum(c.values()) - sum(c[w] for w in head) + len(c) - len(head) + 1

    def want(r):
        w = words(r[1])
        own = plain_log_probability(p, [ids.get(x, 0) for x in w], net.end) / math.log(10)
        return str(r[0]), len(w), own + sum(math.log10((c[x] + 1) / outside) for x in w if x not in ids)

    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in found)
    for (key, n, value), (key2, n2, expected) in zip(got, sorted(map(want, ROWS)), strict=True):
        assert (key, n) == (key2, n2) and abs(value - expected) < 1e-4 * n + 1e-5


def test_states_are_carried_across_windows_and_not_between_documents(monkeypatch):
    net = lm.Network(20, 1, 8)
    rng = np.random.default_rng(2)
    sequences = [np.append(rng.integers(2, 20, n), 1).astype(np.int16) for n in (0, 1, 5, 64, 130, 7, 30, 31, 32)]
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    for most in (512, 3, 1):
        monkeypatch.setattr(lm, "SCORED_AT_ONCE", most)
        for s, value in zip(sequences, lm.score_sequences(net, sequences, 16)):
            assert abs(plain_log_probability(p, s.tolist(), net.end) - value) < 1e-3
    assert len(lm.score_sequences(net, [], 16)) == 0


def test_lanes_stay_full():
    lengths = np.random.default_rng(4).geometric(0.002, 3_000)
    sizes = [lengths[lane].sum() for lane in lm.lanes(lengths, 512)]
    assert sum(sizes) == lengths.sum() and max(sizes) * len(sizes) < 1.3 * lengths.sum()


def test_network_learns_from_all_training_documents(spark):
    rows = [(i, " ".join("abcdefgh"[(i + k) % 8] for k in range(40)), "en", "a") for i in range(300)]
    limits = lm.Limits(frequent=40, vocabulary=12, units=8, window=8, updates=100, rate=0.03)
    found = lm.score_documents(docs(spark, rows).coalesce(2), lambda key: key % 5 == 0, limits=limits).collect()
    held = [r.score / r.n_tokens for r in found if r.held_out]
    base = [r.base_score / r.n_tokens for r in found if r.held_out]
    assert sum(held) / len(held) > sum(base) / len(base) + 0.3


def test_each_id_is_a_target_once(monkeypatch):
    net, seen = lm.Network(50, 1, 4), collections.Counter()
    monkeypatch.setattr(net, "gradients", lambda x, y, h: (seen.update(y.reshape(-1).tolist()), (np.zeros_like(net.flat), h, 0.0))[1])
    ids = np.random.default_rng(3).integers(0, 50, 9_001).astype(np.int16)
    learner = lm.Learner(net, lm.Limits(window=4, streams=8, updates=64), 0.01)
    for part in np.split(ids, [5, 700, 6_000]):
        learner.add(part)
    learner.finish()
    assert learner.tokens == len(ids) and seen == collections.Counter(ids.tolist())
