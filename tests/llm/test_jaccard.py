import collections
import random
import re

import numpy as np
import pytest
from helpers import ROWS, SCHEMA, docs, sentence

from feltgrid.llm import jaccard
from feltgrid.llm.graph import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, link):
    """(id, text) -> (size, component, number of links), each distinct (id, text) a node."""
    nodes = list(dict.fromkeys((r[0], r[1]) for r in rows))
    sets = {}
    for node in nodes:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in node[1] or ""))
        sets[node] = {tuple(w[i : i + link.words]) for i in range(max(1, len(w) - link.words + 1))} if w else set()
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    links = collections.Counter()
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            common = len(sets[a] & sets[b])
            if common and link.whole * common >= link.part * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    members = collections.defaultdict(list)
    for n in nodes:
        members[root(n)].append(n[0])
    out = {}
    for n in nodes:
        ids = [i for i in members[root(n)] if i is not None]
        out[n] = (len(sets[n]), min(ids) if ids else None, links[n])
    return out


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [sentence(k, 120).split() for k in range(4)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("link", [jaccard.Link(3, 90, 100), jaccard.Link(5, 80, 100), jaccard.Link(1, 50, 100)])
def test_awkward_rows_match_brute_force(spark, link):
    found = jaccard.similar_documents(docs(spark), link).collect()
    want = brute(ROWS, link)
    key = spark.createDataFrame(list(want), "doc_id long, text string").selectExpr("xxhash64(doc_id, text) AS _row", "doc_id", "text")
    name = {r._row: (r.doc_id, r.text) for r in key.collect()}
    assert len(found) == len(ROWS)
    for r in found:
        assert (r.n_shingles, r.component_id, r.n_links) == want[name[r._row]], name[r._row]


@pytest.mark.parametrize("sets", [2048, 5])
def test_regions_cut_at_pivots_and_in_blocks_are_exact(spark, sets, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 6)
    rows = near_copies(3, 60)
    link = jaccard.Link(3, 80, 100)
    found = jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA), link, region_sets=sets).collect()
    want = brute(rows, link)
    for r in found:
        assert (r.n_shingles, r.component_id, r.n_links) == want[(r.doc_id, rows[r.doc_id][1])]


def test_region_join_counts_links_once_in_cells():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 60, 60).astype(np.uint64) for _ in range(8)]
    sets = []
    for i in range(200):
        s = base[i % 8].copy()
        s[rng.integers(0, 60, 2)] = rng.integers(0, 1 << 60, 2).astype(np.uint64)
        sets.append(np.unique(s))
    link = jaccard.Link(1, 90, 100)
    edges, counts = jaccard.join_region(sets, np.ones(200, bool), np.ones(200), np.zeros(200, int), link)
    want = np.zeros(200)
    for i in range(200):
        for j in range(200):
            common = len(np.intersect1d(sets[i], sets[j]))
            want[i] += i != j and bool(link.links(common, len(sets[i]), len(sets[j])))
    assert (counts == want).all() and len(edges) <= 199


def test_first_of_each_group_keeps_one_row_and_all_columns(spark):
    df = docs(spark)
    kept = jaccard.first_of_each_group(df, jaccard.Link(5, 80, 100))
    assert kept.columns == df.columns
    rows = kept.collect()
    assert all(r._row == "own _row" for r in rows)
    ids = collections.Counter(r.doc_id for r in rows)
    assert ids[1] == 1 and 2 not in ids and ids[11] == 1 and ids[12] == 2 and ids[8] == 1 and 9 not in ids
    assert {5, 6, 7} <= set(ids)


def test_no_rows(spark):
    assert jaccard.similar_documents(docs(spark, []), jaccard.Link(3, 90, 100)).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: root(n) for n in list(up)}


def test_no_pair_that_may_link_is_left_apart():
    rng = np.random.default_rng(4)
    link = jaccard.Link(1, 70, 100)
    base = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (30, 90, 200)]
    sets = []
    for i in range(120):
        s = base[i % 3].copy()
        s[rng.integers(0, len(s), len(s) // 12)] = rng.integers(0, 1 << 62, len(s) // 12).astype(np.uint64)
        sets.append(np.unique(s))
    sizes = np.array([len(s) for s in sets])
    edges = jaccard.may_link_forest([jaccard.bucket_counts(s) for s in sets], sizes, link)
    forest = jaccard.Forest(len(sets))
    assert all(forest.join(i, j) for i, j in edges)
    common = jaccard.intersections(sets)
    for i, j in zip(*np.nonzero(link.links(common, sizes[:, None], sizes[None, :]))):
        assert forest.root(int(i)) == forest.root(int(j))


def joined(spark, sets, link, region_sets, region_bytes=1 << 30, count_links=True):
    """Links of each position and the root of its component, from one region of ``sets``."""
    rows = [(1, i, 1, True, 0, bytearray(s.tobytes())) for i, s in enumerate(sets)]
    found = jaccard.metric_join(spark.createDataFrame(rows, jaccard.REGIONS), link, region_bytes, region_sets, count_links)
    links, forest = [0] * len(sets), jaccard.Forest(len(sets))
    for part in found:
        for r in part.collect():
            if r.b is None:
                links[r.a] += r.n
            else:
                forest.join(r.a, r.b)
    return links, [forest.root(i) for i in range(len(sets))]


def test_cells_beside_a_stuck_region_are_joined(spark):
    """A tight cluster on a chain of gradually changing sets: some cells no longer shrink, their neighbours do."""
    rng = np.random.default_rng(2)
    token = np.unique(rng.integers(0, 1 << 62, 4_000).astype(np.uint64))
    rng.shuffle(token)
    sets = [np.unique(token[2 * i : 2 * i + 100]) for i in range(150)]
    for i in range(60):
        s = token[100:200].copy()
        s[rng.integers(0, 100)] = token[3_000 + i]
        sets.append(np.unique(s))
    link = jaccard.Link(1, 90, 100)
    sizes = np.array([len(s) for s in sets])
    hit = link.links(jaccard.intersections(sets), sizes[:, None], sizes[None, :])
    np.fill_diagonal(hit, False)
    forest = jaccard.Forest(len(sets))
    for i, j in zip(*np.nonzero(hit)):
        forest.join(int(i), int(j))
    links, roots = joined(spark, sets, link, region_sets=25)
    assert links == hit.sum(1).tolist()
    assert roots == [forest.root(i) for i in range(len(sets))]
    assert joined(spark, sets, link, 25, count_links=False)[1] == roots


def test_large_regions_become_stars_and_are_not_grouped(spark):
    members = spark.createDataFrame([(1, r) for r in range(10)] + [(2, r) for r in range(5, 8)], "region long, _row long")
    # Without counts, so a task that looked at the members of a large region would fail.
    described = spark.createDataFrame([(r, 1, None) for r in range(10)], "_row long, n long, counts binary")
    stars, small = jaccard.split_regions(members, 3)
    assert sorted(map(tuple, stars.collect())) == [(r, 0) for r in range(1, 10)]
    assert sorted(r._row for r in small.collect()) == [5, 6, 7]
    many = spark.range(jaccard.FOREST_SETS + 1).selectExpr("7L AS region", "id AS _row")
    joined_to = jaccard.candidate_edges(many, described, jaccard.Link(1, 90, 100))
    assert joined_to.count() == jaccard.FOREST_SETS and joined_to.filter("b <> 0").isEmpty()


def test_regions_of_many_bytes_become_stars(spark):
    members = spark.createDataFrame([(1, r, 500) for r in range(4)] + [(2, r, 20) for r in range(3)] + [(3, r, 900) for r in range(2)], "region long, _row long, n long")
    stars, small = jaccard.split_regions(members, most_bytes=1_000)
    assert sorted(map(tuple, stars.collect())) == [(r, 0) for r in range(1, 4)]
    assert sorted({r.region for r in small.collect()}) == [2, 3]


def test_tight_cluster_ships_few_copies_when_links_are_not_counted(spark, monkeypatch):
    """5,000 near copies and some sets at the edge of the cluster: pivots connect nearly all of them at once."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = []
    for i in range(5_000):
        s = base.copy()
        change = 5 if i % 100 else 12
        s[rng.choice(200, change, replace=False)] = rng.integers(0, 1 << 62, change).astype(np.uint64)
        sets.append(np.unique(s))
    link, shipped = jaccard.Link(1, 88, 100), []
    small = jaccard.join_small

    def counted(regions, link):
        shipped.append(regions.count())
        return small(regions, link)

    monkeypatch.setattr(jaccard, "join_small", counted)
    roots = joined(spark, sets, link, region_sets=100, count_links=False)[1]
    assert sum(shipped) < 3 * len(sets)
    sizes, least = np.array([len(s) for s in sets]), np.arange(len(sets))
    hit = link.links(jaccard.intersections(sets), sizes[:, None], sizes[None, :])
    while True:
        spread = np.where(hit, least, len(sets)).min(1)
        if (spread == least).all():
            break
        least = spread
    assert roots == least.tolist()


@pytest.mark.parametrize("sets", [12, 5])
def test_components_without_counts_are_exact(spark, sets, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rows = near_copies(7, 120)
    link = jaccard.Link(3, 80, 100)
    found = jaccard.similar_documents(spark.createDataFrame(rows, SCHEMA), link, region_sets=sets, count_links=False).collect()
    want = brute(rows, link)
    assert len(found) == 120 and "n_links" not in found[0].asDict()
    for r in found:
        assert (r.n_shingles, r.component_id) == want[(r.doc_id, rows[r.doc_id][1])][:2]
