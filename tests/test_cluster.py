import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from feltgrid.domain import CLUSTER_FEATURES, MONTHLY_FEATURES
from feltgrid.operators import cluster


def random_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims)) * 4
    return np.array([centres[i % 4] + rng.normal(size=dims) for i in range(n)])


def frame(spark, x):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(f"r{i:04d}", *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{n} double" for n in names)), names


def partition(labels):
    groups = {}
    for key, label in labels:
        groups.setdefault(label, set()).add(key)
    return {frozenset(g) for g in groups.values()}


def ward_by_hand(x, k):
    """Merge the pair of clusters whose union raises the sum of squares least."""
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        def cost(pair):
            a, b = clusters[pair[0]], clusters[pair[1]]
            gap = x[a].mean(axis=0) - x[b].mean(axis=0)
            return len(a) * len(b) / (len(a) + len(b)) * float(gap @ gap)

        i, j = min(itertools.combinations(range(len(clusters)), 2), key=cost)
        clusters[i] += clusters.pop(j)
    return {frozenset(f"r{i:04d}" for i in c) for c in clusters}


@pytest.mark.parametrize("n", [3, 8, 9, 40])
def test_ward_equals_brute_force(spark, n):
    x = random_rows(n, 3, n)
    df, names = frame(spark, x)
    labels = cluster.ward_labels(df, "key", names, [2, 3, 5]).collect()
    for k in (2, 3, 5):
        if k <= n:
            assert partition((r.key, r.label) for r in labels if r.k == k) == ward_by_hand(x, k)
        else:
            assert not [r for r in labels if r.k == k]
    assert {r.label for r in labels if r.key == "r0000"} == {0}


def test_linkage_distances_rise_and_sizes_add_up(spark):
    df, names = frame(spark, random_rows(20, 2, 1))
    steps = cluster.ward_linkage(df, "key", names).orderBy("step").collect()
    distances = [s.distance for s in steps]
    assert len(steps) == 19 and distances == sorted(distances) and steps[-1].sample_count == 20


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_blocks_give_the_same_tree(spark, block_rows):
    x = random_rows(60, 3, 7)
    df, names = frame(spark, x)
    merges = cluster.ward_merges(df, "key", names, block_rows=block_rows)
    heights = sorted(r.distance for r in merges.collect())
    total = ((x - x.mean(axis=0)) ** 2).sum()
    assert len(heights) == 59 and sum(h * h for h in heights) / 2 == pytest.approx(total)
    labels = cluster.cut_labels(merges, df, "key", [4]).collect()
    assert partition((r.key, r.label) for r in labels) == ward_by_hand(x, 4)


def test_equal_rows_and_single_rows(spark):
    x = np.array([[1.0, 2.0]] * 6 + [[5.0, 5.0]])
    df, names = frame(spark, x)
    labels = {r.key: r.label for r in cluster.ward_labels(df, "key", names, [2]).collect()}
    assert labels == {f"r{i:04d}": int(i == 6) for i in range(7)}
    assert cluster.ward_labels(df.limit(1), "key", names, [1]).collect()[0].label == 0


def silhouette_by_hand(x, labels):
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i, label in enumerate(labels):
        same = [j for j, o in enumerate(labels) if o == label and j != i]
        a = gaps[i, same].mean() if same else 0.0
        b = min(gaps[i, [j for j, o in enumerate(labels) if o == other]].mean() for other in set(labels) - {label})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_silhouette_equals_brute_force_for_any_block_size(spark, block_rows):
    x = random_rows(50, 3, 3)
    labels = [i % 3 for i in range(49)] + [9]
    df, names = frame(spark, x)
    df = df.withColumn("label", F.when(F.col("key") == "r0049", 9).otherwise(F.substring("key", 2, 4).cast("int") % 3)).withColumn("k", F.lit(4))
    got = cluster.silhouette(df, "key", names, block_rows=block_rows).first().silhouette
    assert got == pytest.approx(silhouette_by_hand(x, labels))


def test_silhouette_degenerate_cases(spark):
    df, names = frame(spark, random_rows(5, 2, 3))
    one = df.withColumn("label", F.lit(0)).withColumn("k", F.lit(1))
    assert cluster.silhouette(one, "key", names).first().silhouette == 0.0
    two = df.limit(2).withColumn("label", F.when(F.col("key") == "r0000", 0).otherwise(1)).withColumn("k", F.lit(2))
    assert cluster.silhouette(two, "key", names).first().silhouette == 0.0


def test_standardise(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("b", 2.0, 0.1), ("c", 6.0, 0.1)], "key string, x double, c double")
    rows = cluster.standardise(df, ["x", "c"]).orderBy("key").collect()
    x = np.array([1.0, 2.0, 6.0])
    assert [r.x for r in rows] == pytest.approx(list((x - x.mean()) / x.std()))
    assert [r.c for r in rows] == pytest.approx([0, 0, 0], abs=1e-12)


def test_sweep_range():
    assert list(cluster.sweep_range(34)) == [2, 3, 4, 5, 6]
    assert list(cluster.sweep_range(6)) == [2, 3, 4]
    assert list(cluster.sweep_range(3)) == [2]


def vectors(spark, n=12, seed=4):
    rng = random.Random(seed)
    rows = [(f"p{i:02d}", 40 + 10 * i, *[rng.random() + (i % 3) for _ in CLUSTER_FEATURES]) for i in range(n)]
    return spark.createDataFrame(rows, "province string, total_posts_all bigint, " + ", ".join(f"{f} double" for f in CLUSTER_FEATURES))


def test_cluster_provinces(spark):
    labels, scores, best = cluster.cluster_provinces(vectors(spark))
    assert {r.k for r in scores.collect()} == {2, 3, 4, 5, 6}
    rows = best.collect()
    assert len(rows) == 11 and all(r.province != "p00" for r in rows)
    top = max(scores.collect(), key=lambda r: (round(r.silhouette, 10), -r.k))
    assert len({r.cluster_label for r in rows}) == top.k == 3
    wide = cluster.label_stability(labels, "province", range(2, 7)).collect()
    assert len(wide) == 11 and set(wide[0].asDict()) == {"province", "k2", "k3", "k4", "k5", "k6"}
    summary = cluster.cluster_summaries(vectors(spark), best).collect()
    assert sum(len(r.provinces) for r in summary) == 12


def monthly(spark):
    rng = random.Random(2)
    rows = []
    for m in range(1, 8):
        for i in range(12 if m != 3 else 8):
            if (m, i) != (5, 0):
                rows.append((f"2020-{m:02d}", f"p{i:02d}", 20 if i else 30, *[rng.random() + (i + m) % 3 for _ in MONTHLY_FEATURES]))
        rows.append((f"2020-{m:02d}", "small", 19, *[0.5] * 6))
    return spark.createDataFrame(rows, "date_month string, province string, total_posts bigint, " + ", ".join(f"{f} double" for f in MONTHLY_FEATURES))


def test_monthly_evolution(spark):
    raw = cluster.monthly_ward(monthly(spark))
    aligned = cluster.align_by_risk(raw)
    rows = aligned.collect()
    assert {r.cluster for r in rows if r.date_month == "2020-03"} == {0}
    assert {r.cluster for r in rows if r.date_month == "2020-01"} == {0, 1, 2}
    assert all(r.province != "small" for r in rows)
    for m in ("2020-01", "2020-05"):
        risk = {}
        for r in rows:
            if r.date_month == m:
                risk.setdefault(r.cluster, []).append(r.sadness_mean + r.anger_mean + r.fear_mean - r.joy_mean)
        means = [np.mean(risk[c]) for c in sorted(risk)]
        assert means == sorted(means)
    matrix = cluster.evolution_matrix(aligned)
    by_province = {r.province: r.asDict() for r in matrix.collect()}
    assert by_province["p00"]["2020-05"] == -1 and by_province["p11"]["2020-03"] == -1
    long = cluster.matrix_to_long(matrix)
    assert long.filter("not present").count() == sum(v == -1 for r in by_province.values() for v in r.values())
    kept = cluster.present_filter(aligned, 7).select("province").distinct()
    assert kept.count() == 7
    shifts = {r.province: r.n_shifts for r in cluster.cluster_shifts(aligned, None).collect()}
    for province, row in by_province.items():
        seen = [row[m] for m in sorted(k for k in row if k != "province") if row[m] >= 0]
        assert shifts.get(province, 0) == sum(a != b for a, b in zip(seen, seen[1:]))


def test_pca_matches_numpy(spark):
    df = vectors(spark, 15)
    out = cluster.pca_scatter(df).orderBy("province").collect()
    x = np.array([[r[f] for f in CLUSTER_FEATURES] for r in df.orderBy("province").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, vecs = np.linalg.eigh(np.cov(z.T))
    for name, axis in (("x", vecs[:, -1]), ("y", vecs[:, -2])):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        assert [r[name] for r in out] == pytest.approx(list(z @ axis), abs=1e-6)


def test_kmeans_and_squared_silhouette(spark):
    df, names = frame(spark, random_rows(60, 3, 9))
    labels = cluster.kmeans_labels(df, "key", names, 4)
    assert len(partition((r.key, r.label) for r in labels.collect())) == 4
    joined = labels.join(df, "key").withColumn("v", F.array(*names))
    assert 0 < cluster.silhouette_squared(joined, "v", "label").first().silhouette <= 1


def test_kept_neighbours_save_comparisons(spark):
    """The same tree from any cut into blocks, and fewer pairs from round to round."""
    x = np.concatenate([random_rows(150, 2, 5), random_rows(50, 2, 5)[:7]])  # some rows twice
    df, names = frame(spark, x)
    whole = cluster.ward_merges(df, "key", names)
    work = []
    cut = cluster.ward_merges(df, "key", names, block_rows=12, work=work)
    heights = [sorted(r.distance for r in m.collect()) for m in (whole, cut)]
    assert heights[1] == pytest.approx(heights[0], abs=1e-9)
    for k in (2, 5, 20):
        labels = [partition((r.key, r.label) for r in cluster.cut_labels(m, df, "key", [k]).collect()) for m in (whole, cut)]
        assert labels[0] == labels[1]
    # All pairs in each of the rounds would be 157 * 156 comparisons and more.
    assert work[-1] < work[0] and sum(work) < 157 * 156
    assert all(a >= b for a, b in zip(work, work[2:]))


def test_groups_grow_their_own_trees(spark):
    x = random_rows(60, 2, 8)
    df, names = frame(spark, x)
    grouped = df.withColumn("g", F.when(F.substring("key", 2, 4).cast("int") < 45, "a").otherwise("b"))
    merges = cluster.ward_merges(grouped, "key", names, "g", block_rows=10)
    for g, rows in (("a", slice(0, 45)), ("b", slice(45, 60))):
        alone = cluster.ward_merges(df.filter(F.substring("key", 2, 4).cast("int").between(rows.start, rows.stop - 1)), "key", names)
        assert sorted(r.distance for r in merges.filter(F.col("_group") == g).collect()) == pytest.approx(sorted(r.distance for r in alone.collect()))


def test_few_clusters_need_no_rounds(spark):
    """In many features no box keeps blocks apart; clusters that fit into one block are done in one more round."""
    x = np.random.default_rng(11).normal(size=(160, 24))
    df, names = frame(spark, x)
    whole, work = cluster.ward_merges(df, "key", names), []
    cut = cluster.ward_merges(df, "key", names, block_rows=140, work=work)
    assert sorted(r.distance for r in cut.collect()) == pytest.approx(sorted(r.distance for r in whole.collect()), abs=1e-9)
    assert len(work) <= 4


def test_nearest_is_exact_with_copies_and_far_from_zero():
    rng = np.random.default_rng(5)
    for shift in (0, 1e6):
        y = rng.normal(size=(60, 7)) + shift
        y[20:40] = y[:20]
        n = rng.integers(1, 4, 60).astype(float)
        costs = ((y[:, None] - y[None]) ** 2).sum(axis=2) * (2 * n[:, None] * n / (n[:, None] + n))
        np.fill_diagonal(costs, np.inf)
        kept = np.where(np.arange(60) % 3 == 0, np.nan, np.sort(costs, axis=0)[4])
        best, least, (row, column, cost) = cluster._nearest(y, n, y, n, kept, np.arange(60))
        assert (best == costs.argmin(axis=1)).all() and (least == costs.min(axis=1)).all()
        assert {*zip(row, column)} >= {(i, j) for i, j in zip(*np.nonzero(costs <= kept)) if costs[i, j] == costs[:, j].min()}
        assert (costs[row, column] == cost).all() and (cost <= kept[column]).all()


def test_copies_are_joined_before_the_rounds(spark):
    """One join for each round would be left of many equal rows, whose nearest is the same row."""
    x = np.concatenate([random_rows(30, 2, 6), np.full((60, 2), 9.5)])
    df, names = frame(spark, x)
    work = []
    merges = cluster.ward_merges(df, "key", names, block_rows=12, work=work)
    rows = merges.collect()
    copies = [(r.lo, r.hi, r.sample_count) for r in sorted(rows, key=lambda r: r["round"]) if r.distance == 0]
    assert copies == [("r0030", f"r{i:04d}", i - 29) for i in range(31, 90)]
    assert len(rows) == 89 and len(work) <= 12
    assert sum(r.distance ** 2 for r in rows) / 2 == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_keys_that_come_again_and_rows_without_a_number(spark):
    x = np.array([[0.0, 0.0], [0.0, 1.0], [8.0, 8.0], [8.0, 9.0], [np.nan, 1.0], [0.0, 0.0], [8.0, 8.5]])
    df, names = frame(spark, x)
    df = df.withColumn("f0", F.when(F.col("key") != "r0004", F.col("f0")))
    df = df.withColumn("key", F.when(F.col("key") == "r0005", "r0000").when(F.col("key") == "r0006", "r0002").otherwise(F.col("key")))
    labels = sorted((r.key, r.label) for r in cluster.ward_labels(df, "key", names, [3]).collect())
    # A row without a distance stays alone.
    assert labels == [("r0000", 0), ("r0000", 0), ("r0001", 0), ("r0002", 1), ("r0002", 1), ("r0003", 1), ("r0004", 2)]


def test_blocks_compare_strips_and_give_the_same_tree(spark, monkeypatch):
    """Rounds over many strips of packed rows, in features that no box keeps apart, join what one block joins."""
    x = np.random.default_rng(12).normal(size=(120, 24))
    df, names = frame(spark, x)
    whole = {(r.lo, r.hi): r.distance for r in cluster.ward_merges(df, "key", names).collect()}
    cut = {(r.lo, r.hi): r.distance for r in cluster.ward_merges(df, "key", names, block_rows=60).collect()}
    assert cut.keys() == whole.keys() and list(cut.values()) == pytest.approx([whole[k] for k in cut], abs=1e-9)
    blocks = [Row(_group="g", _block=b, left=30, open=o, joined=0, _all=120) for b, o in enumerate((30, 0, 9, 4))]
    monkeypatch.setattr(cluster, "STRIP_ROWS", 50)
    assert [s[2:] for s in cluster._strips(blocks)] == [(0, 0, 3, 4), (1, 1, 3, 4), (1, 2, 3, 4), (2, 3, 3, 4)]
