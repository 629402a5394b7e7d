import collections
import hashlib
import math

import numpy as np
from helpers import ROWS, docs

from feltgrid.llm import fingerprint


def test_entropy_levels_match_the_definition():
    rng = np.random.default_rng(3)
    for n in (0, 31, 32, 200, 40_000):
        data = rng.integers(97, 103, n).astype(np.uint8)
        data[: n // 3] = 65
        got = fingerprint.entropy_levels(data)
        assert len(got) == max(0, n - 31)
        for i in range(0, len(got), max(1, len(got) // 400)):
            c = collections.Counter(data[i : i + 32].tolist()).values()
            h = -sum(k / 32 * math.log2(k / 32) for k in c) / 5 * 1000
            assert abs(got[i] - h) <= 0.501


def test_levels_do_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 110, 90_000).astype(np.uint8)
    assert (fingerprint.entropy_levels(data)[50_000:50_100] == fingerprint.entropy_levels(data[50_000:50_131])).all()


def test_neighbours_and_edits(spark):
    rows = fingerprint.fingerprints(docs(spark), parts=3).collect()
    order = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], r[0] is not None))
    assert len(rows) == len(ROWS)
    for i in {r[0] for r in ROWS}:
        mine = [k for k, r in enumerate(order) if r[0] == i]
        if len(mine) > 1 or len([r for r in ROWS if r[0] == order[(mine[0] + 1) % len(order)][0]]) > 1:
            continue
        text, following = order[mine[0]][1] or "", order[(mine[0] + 1) % len(order)][1] or ""
        row = next(r for r in rows if r.doc_id == i)
        n = len(text) // 4
        want = text[: len(text) - n] + following[:n]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    by_text = collections.defaultdict(set)
    texts = {r[0]: r[1] or "" for r in ROWS if r[0] not in (None, 12)}
    for r in rows:
        if r.doc_id in texts:
            by_text[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert next(r for r in rows if r.doc_id == 8).near_next == 1.0


def test_every_part_count_gives_the_same_rows(spark):
    rows = [(i * 3, f"{i} " + "some text of this document " * (i % 5) + str(i * i), "en", "a") for i in range(40)]
    a, b = (sorted(map(tuple, fingerprint.fingerprints(docs(spark, rows), parts=p).collect())) for p in (2, 17))
    assert a == b and len(a) == 40
    assert fingerprint.fingerprints(docs(spark, rows[:1])).count() == 1
    assert fingerprint.fingerprints(docs(spark, [])).count() == 0


def test_likeness_orders_edits_and_parses_back():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    other = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    ranks = fingerprint.rarity_ranks(np.bincount(fingerprint.entropy_levels(np.frombuffer(text, np.uint8)), minlength=1001))
    a, b, c, d = fingerprint.digests([text, text[:15_000] + other[:5_000], other, text], ranks)
    assert fingerprint.likeness(a, d) == 1.0 and fingerprint.likeness(a, b) > 0.4 > 0.1 > fingerprint.likeness(a, c)
    again = fingerprint.Digest.parse(str(a))
    assert str(again) == str(a) and fingerprint.likeness(again, b) == fingerprint.likeness(a, b)
