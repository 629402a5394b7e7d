import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from helpers import ROWS, docs
from tokenizers import Tokenizer

from feltgrid.llm import bestfit


def one_by_one(lengths, width):
    """Best-fit decreasing, a piece at a time: the remaining room of each bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(width - n)
    return rooms


def test_runs_give_the_bins_of_packing_one_by_one():
    rng = random.Random(3)
    for width, n in ((10, 40), (64, 300), (64, 3), (100, 500), (7, 1), (50, 0)):
        for shape in (lambda: rng.randrange(1, width + 1), lambda: rng.choice([1, width // 3 + 1, width // 2, width])):
            lengths = [shape() for _ in range(n)]
            counts = defaultdict(int)
            for x in lengths:
                counts[x] += 1
            plan, used = bestfit.best_fit_decreasing(counts, width)
            bins = defaultdict(list)
            for length, runs in plan.items():
                assert sum(r.count for r in runs) == counts[length]
                for r in runs:
                    for i in range(r.count):
                        bins[r.first + i // r.each].append((r.offset + i % r.each * length, length))
            assert sorted(bins) == list(range(used))
            for pieces in bins.values():
                at = 0
                for offset, length in sorted(pieces):
                    assert offset == at
                    at += length
                assert at <= width
            assert sorted(width - sum(n for _, n in p) for p in bins.values()) == sorted(one_by_one(lengths, width))


def test_the_tree_finds_the_tightest_capacity():
    rng = random.Random(5)
    tree, open_ = bestfit.Capacities(100), []
    for _ in range(2000):
        if open_ and rng.random() < 0.5:
            capacity = open_.pop(rng.randrange(len(open_)))
            tree.take(capacity)
        else:
            capacity = rng.randrange(1, 101)
            tree.put(capacity, bestfit.Bins(0, 1))
            open_.append(capacity)
        least = rng.randrange(1, 101)
        assert tree.tightest(least) == min((c for c in open_ if c >= least), default=None)


def test_every_id_lies_in_one_piece(spark):
    t = Tokenizer.from_file(public_tokenizers.path(bestfit.TOKENIZER))
    rows = bestfit.pack_best_fit(docs(spark).repartition(3), width=64, with_ids=True)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    found = rows.collect()
    want = sorted([2] if not r[1] else t.encode(r[1], add_special_tokens=False).ids + [2] for r in ROWS)
    sequences = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length, r.ids))
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    lengths = [n % 64 or 64 for n in map(len, want)] + [64] * sum((len(w) - 1) // 64 for w in want)
    assert len(sequences) == len(one_by_one(lengths, 64))
    # Cut from the end: only a first piece may be shorter.
    assert all(r.length == 64 for r in found if r.piece) and all((r.start == 0) == (r.piece == 0) for r in found)
    assert sorted((r.length, r.ids_crc32) for r in found) == sorted(
        (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for w in want for ids in cut(w, 64)
    )
    whole = {r.sequence_id: (r.n_ids, bytes(r.ids)) for r in bestfit.sequences(rows).collect()}
    placed = defaultdict(list)
    for r in rows.collect():
        placed[r.sequence_id].append((r.offset, bytes(r.ids)))
    assert {k: b"".join(b for _, b in sorted(v)) for k, v in placed.items()} == {k: v for k, (_, v) in whole.items()}
    assert all(4 * n == len(b) for n, b in whole.values())


def cut(ids, width):
    first = len(ids) % width or width
    return [ids[:first], *(ids[i : i + width] for i in range(first, len(ids), width))]


def test_no_rows(spark):
    assert bestfit.pack_best_fit(docs(spark, [])).count() == 0


def test_no_text_is_shuffled(spark):
    plan = bestfit.pack_best_fit(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
