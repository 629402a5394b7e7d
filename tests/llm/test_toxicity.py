import random

import numpy as np
from helpers import ROWS, WORDS, docs
from pyspark.sql import functions as F

from feltgrid.llm import toxicity


def labelled(n, seed):
    """Documents with an invented insult, disguised at times, in a fifth of them."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = "zorgl" + rng.choice(["en", "isch", "", "ung", "a"])
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = labelled(900, 1)
    known = spark.createDataFrame([*labels, (None, 1), (0, None)], "doc_id long, toxic int")
    usable = lambda key: F.crc32(key.cast("string").cast("binary")) % 3 != 1
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows), known, usable=usable).collect()}
    held = [(found[i], y) for i, y in labels if toxicity.fold(i) == 1]
    right = np.mean([(s >= 0.7) == bool(y) for s, y in held])
    assert len(held) > 200 and right > 0.97 and len(found) == 900


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs(spark), none).collect()
    assert len(rows) == len(ROWS) and {r.score for r in rows} == {0.0}
    some = spark.createDataFrame([(15, 1), (1, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs(spark), some).collect())
    assert toxicity.toxicity(docs(spark, []), some).count() == 0


def test_isotonic_is_monotone_and_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = toxicity.boost(x, y, toxicity.Limits())
    raw = model.raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.97
    xs, ps = toxicity.isotonic(raw, y)
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all() and ps.min() >= 0 and ps.max() <= 1


def test_features_see_disguise_and_address():
    weights = toxicity.WordWeights({"idiot": 3.0})
    plain, hidden = toxicity.features("you idiot", weights), toxicity.features("you 1d10t", weights)
    assert plain[0] == hidden[0] > 0 and plain[4] == hidden[4] == 0.5 and hidden[9] > 0 == plain[9]
    assert toxicity.features("", weights)[:5] == [0, 0, 0, 0, 0]
