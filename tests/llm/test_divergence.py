import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ROWS, docs

from feltgrid.llm import divergence


def brute(rows, least, top):
    """(lang, source, part, item, value, rank), by the definition."""
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = []
    for lang in {k[0] for k in groups}:
        kept = {t for t, n in documents[lang].items() if n >= least}
        own = {s: {t: c[t] for t in kept} for (k, s), c in groups.items() if k == lang}
        all_ = {t: sum(c[t] for c in own.values()) for t in kept}

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in own.items():
            pairs = [(sum(f(share(c, t), share(d, t)) for t in kept), o) for o, d in own.items() if o != s]
            terms = [(f(share(c, t), share(all_, t)), t) for t in kept if c[t] and share(c, t) > share(all_, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


WORDS = ["alpha", "Beta", "gamma", "délta", "ÉPSILON", "zeta", "日本", "x", "Ⅷ"]


def many(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[: 3 + i % 7], k=rng.randrange(0, 30))) or None, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None, "f"])) for i in range(n)]


@pytest.mark.parametrize("groups, cell_counts", [(64, 1 << 18), (2, 3), (1, 1), (3, 7)])
def test_every_cut_of_the_cube_gives_the_definition(spark, groups, cell_counts):
    rows = many(1, 150)
    found = divergence.source_divergence(docs(spark, rows), min_documents=4, top_terms=3, groups=groups, cell_counts=cell_counts)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, 3)


def test_awkward_rows(spark):
    found = divergence.source_divergence(docs(spark).repartition(3), min_documents=2)
    assert sorted(map(tuple, found.collect())) == brute(ROWS, 2, 10)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    # With nothing kept all groups are there and equal.
    bare = divergence.source_divergence(docs(spark), min_documents=100).collect()
    assert sorted(map(tuple, bare)) == brute(ROWS, 100, 10) and bare and all(r.value == 0 for r in bare)


def test_no_rows(spark):
    assert divergence.source_divergence(docs(spark, [])).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 7)
    text = "Alpha beta, gamma--delta épsilon " * 9
    assert [w.decode() for p in divergence.parts(text) for w in p] == re.findall(r"[a-zé]+", text.lower())


def test_shares_are_exact_for_large_counts(spark):
    n, total = np.array([0, 5, 4_000_000_000_000_000]), np.array([8_999_999_999_999_999] * 3)
    assert divergence.shares(n + 2, total).tolist() == [1 + 10**9 * (int(x) + 2) // int(total[0]) for x in n]
    df = spark.createDataFrame([(4_000_000_000_000_000, 8_999_999_999_999_989, 5)], "n long, total long, terms long")
    assert df.select(divergence.share(df.n, df.total, df.terms)).first()[0] == 1 + 10**9 * (4_000_000_000_000_002) // 8_999_999_999_999_999
