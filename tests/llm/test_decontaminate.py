import re

import pytest
from helpers import ROWS, WORDS, docs, sentence

from feltgrid.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, sentence(1, 15)), (2, "quick brown"), (3, None), (4, " .,; "), (20, sentence(13, 40)), (100, sentence(13, 40)), (5, "Ünïcödé 🎉"), (6, "zzz yyy")]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for i in range(max(1, len(b) - size + 1) if b else 0):
            window = b[i : i + size]
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hit.update(range(k, k + len(window)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_hits_match_brute_force(spark, block):
    df = docs(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(df, items, block_bytes=block).collect()
    assert len(found) == len(ROWS)
    want = sorted((str((r[0], r[1])), brute(r[1], ITEMS)) for r in ROWS)
    assert sorted((str((r.doc_id, r.text)), (r.n_words, r.n_hit, list(r["items"]))) for r in found) == want
    assert all(r.contaminated == (r.n_hit > 0) and r._row == "own _row" and r.n_items == len(r["items"]) for r in found)


def near(text, items, rows, most=4, span=30):
    """Items whose rarest terms lie within ``span`` words of the rarest one."""
    every = [w for r in rows for w in words(r[1])]
    own, found = words(text), []
    for item, body in items:
        terms = sorted({w for w in words(body) if w in every}, key=lambda w: (every.count(w), w.encode()))[:most]
        at = [[i for i, w in enumerate(own) if w == t] for t in terms]
        if len(terms) > 1 and any(all(any(abs(i - j) <= span for j in others) for others in at[1:]) for i in at[0]):
            found.append(str(item))
    return sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_items_near_match_brute_force(spark, block):
    apart = " ".join(["quick", *["filler"] * 40, "brown"])
    rows = [*ROWS, (901, "brown and quick", "en", "a", "x"), (902, apart, "en", "a", "x")]
    df = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in rows[-2:]], "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(df, items, block_bytes=block).collect()
    want = sorted((str((r[0], r[1])), near(r[1], ITEMS, rows)) for r in rows)
    assert sorted((str((r.doc_id, r.text)), list(r.near_items)) for r in found) == want
    assert "2" in dict(want)[str(rows[-2][:2])] and "2" not in dict(want)[str(rows[-1][:2])]


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs(spark), none).collect()] == [0] * len(ROWS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), items).count() == 0


def test_proximity_search(spark):
    terms = {w.encode(): i for i, w in enumerate(WORDS)}
    df = spark.createDataFrame([(1, "quick red brown fox"), (2, "quick a b c d e f g h brown")], "_row long, text string")
    row = decontaminate.positional_index(df.coalesce(1), terms, 10).first()
    shard = decontaminate.Shard(row.row_ids, row.starts, row.terms, row.counts, row.positions)
    quick, brown = terms[b"quick"], terms[b"brown"]
    assert shard.near((quick, brown), 3).tolist() == [0]
    assert shard.near((brown, quick), 3).tolist() == [2]
    assert len(shard.near((quick, brown), 9)) == 2
