import os
import random

import numpy as np
import pytest
from helpers import ROWS, WORDS, docs

from feltgrid.llm import quality


def clean(i, n=40):
    """Varied words: ``sentence`` repeats one word for some numbers, which is junk indeed."""
    rng = random.Random(i)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n)).capitalize() + "."


def junk(i):
    kinds = [
        " ".join(w + "%%%" for w in clean(i).split()), clean(i).upper().replace(" ", "!! "),
        " | ".join(clean(i).split()), " ".join(w for w in clean(i).split()[:3] for _ in range(20)),
    ]
    return kinds[i % 4]


def test_junk_goes_and_clean_documents_stay(spark):
    rows = [(i, junk(i) if i % 8 == 0 or i % 8 == 3 else clean(i, 8 + i % 70), "en", "a") for i in range(400)]
    found = {r.doc_id: r.keep for r in quality.quality(docs(spark, rows)).collect()}
    bad = {i for i in found if i % 8 in (0, 3)}
    assert all(found[i] for i in found if i not in bad)
    assert np.mean([not found[i] for i in bad]) > 0.95


def test_awkward_rows(spark):
    df = docs(spark)
    found = quality.quality(df)
    rows = found.collect()
    assert found.columns == [c for c in df.columns if c not in ("quality", "keep")] + ["quality", "keep"]
    assert len(rows) == len(ROWS) and all(0 <= r.quality <= 1 and r.keep == (r.quality >= 0.5) and r._row == "own _row" for r in rows)
    assert quality.quality(docs(spark, [])).count() == 0


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(3)
    low = rng.random(20_000) < 0.2
    rates = [(0.001, 0.8), (0.003, 0.7), (0.002, 0.6), (0.001, 0.75)]
    votes = np.stack([np.where(rng.random(20_000) < np.where(low, b, g), quality.LOW, quality.GOOD) for g, b in rates], axis=1)
    votes[rng.random(votes.shape) < 0.2] = quality.SILENT
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.low - 0.2) < 0.03
    assert ((model.posterior(votes) > 0.5) == low).mean() > 0.98


def test_long_words_count_to_their_end():
    head = "ab1-" * 30
    one, two = (quality.hashed(head + rest, quality.Shapes())[0] for rest in ("字.X" * 60, "9/" * 90))
    shapes = lambda x: {k: round(v, 6) for k, v in x.items()}
    assert shapes(one) != shapes(two)
    # Words of ordinary length keep their shares.
    x, _ = quality.hashed("Word word", quality.Shapes())
    assert 1 / 22 in x.values()


GIVEN = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="driver tables not present")
def test_agreement_with_labels_that_are_never_learnt(spark):
    """The scorer alone, on labels that nothing of the classifier has seen."""
    found = quality.quality(spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text"))
    labels = spark.read.parquet(f"{GIVEN}/labels.parquet").selectExpr("doc_id", "quality AS label")
    rows = found.join(labels, "doc_id").collect()
    assert np.mean([r.keep == (r.label == 1) for r in rows]) > 0.98
    assert np.mean([r.keep for r in rows if r.label == 1]) > 0.995


def test_the_scorer_sees_no_votes():
    """Two texts with the same votes get different scores from the same weights, and no column is a vote's."""
    x, pattern = quality.hashed(clean(3), quality.Shapes())
    y, same = quality.hashed(clean(4), quality.Shapes())
    assert pattern == same and x != y
