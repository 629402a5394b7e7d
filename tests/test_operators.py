"""Panels, anomalies, merges, samples, skew handling and validation against plain Python."""

import random
from collections import Counter, defaultdict
from statistics import mean, median, stdev

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feltgrid.domain import EMOTIONS
from feltgrid.operators import anomaly, dashboard, enrich, merge, panels, sampling, skew, validate


def labelled(spark, n=400, provinces=("北京", "上海", "广东", "火星"), seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.randint(1, 20) for _ in EMOTIONS]
        week = rng.randint(1, 12)
        rows.append((f"p{i:05d}", f"2020-W{week:02d}", f"2020-{(week - 1) // 4 + 1:02d}", rng.choice(provinces),
                     rng.randint(10, 99), *[x / sum(w) for x in w], "ok"))
    schema = "post_id string, date_week string, date_month string, province string, word_count int, " + ", ".join(
        f"{e} double" for e in EMOTIONS) + ", label_status string"
    return spark.createDataFrame(rows, schema)


def test_panels_match_python(spark):
    df = labelled(spark)
    rows = df.collect()
    weekly = {(r.date_week, r.province): r for r in panels.weekly_panel(df).collect()}
    groups = defaultdict(list)
    for r in rows:
        if r.province != "火星":
            groups[r.date_week, r.province].append(r)
    assert set(weekly) == set(groups)
    for key, members in groups.items():
        got = weekly[key]
        assert got.total_posts == len(members)
        means = {e: mean(m[e] for m in members) for e in EMOTIONS}
        for e in EMOTIONS:
            assert got[f"{e}_mean"] == pytest.approx(means[e])
            if len(members) > 1:
                assert got[f"{e}_std"] == pytest.approx(stdev(m[e] for m in members))
        assert got.dominant_score == pytest.approx(max(means.values()))
        assert got.positive_index == pytest.approx(means["joy"] / (means["sadness"] + means["anger"] + means["fear"] + 0.01))
        assert got.reliable == (len(members) >= 30)
    national = panels.national_timeline(df)
    assert sum(r.total_posts for r in national.collect()) == len(rows)
    vectors = {r.province for r in panels.province_vectors(df).collect()}
    assert vectors == {"北京", "上海", "广东"}
    summary = panels.panel_summary(panels.weekly_panel(df), panels.monthly_panel(df), national, df).first()
    assert summary.national_weeks == 12 and summary.provinces == 4 and summary.weekly_rows == len(groups)


def test_single_row_group_has_null_std(spark):
    row = panels.weekly_panel(labelled(spark, 1, ("北京",))).first()
    assert row.joy_std is None and row.total_posts == 1 and row.reliable is False


def test_profile_and_distributions(spark):
    df = labelled(spark, 101)
    rows = df.collect()
    profile = panels.dataset_profile(df).first()
    assert profile.total_posts == 101 and profile.provinces == 4
    assert profile.avg_word_count == pytest.approx(mean(r.word_count for r in rows))
    assert profile.median_word_count == median(r.word_count for r in rows)
    counts = {r.dominant_emotion: r["count"] for r in panels.dominant_distribution(df).collect()}
    assert counts == Counter(max(EMOTIONS, key=lambda e: r[e]) for r in rows)


def national(spark, values, posts=100):
    rows = [(f"2020-W{i + 1:02d}", posts if not isinstance(v, tuple) else v[1], *[(v[0] if isinstance(v, tuple) else v)] * 3)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date_week string, total_posts bigint, fear_mean double, anger_mean double, joy_mean double")


def test_zscores_use_previous_kept_rows(spark):
    values = [0.1, 0.12, 0.11, (0.9, 5), 0.13, 0.5, 0.12, 0.12]
    kept = [v for v in values if not isinstance(v, tuple)]
    series = [r for r in anomaly.zscore_series(national(spark, values), ["fear"]).orderBy("date_week").collect()]
    assert len(series) == len(kept)
    for i, row in enumerate(series):
        base = kept[max(0, i - 4):i]
        if len(base) < 2:
            assert row.z_score is None
        else:
            assert row.z_score == pytest.approx((kept[i] - mean(base)) / (stdev(base) + 1e-8))


def test_constant_series_has_finite_z(spark):
    row = anomaly.zscore_series(national(spark, [0.1, 0.1, 0.1, 0.1, 0.2]), ["fear"]).orderBy("date_week").collect()[-1]
    assert row.z_score == pytest.approx(0.1 / 1e-8, rel=1e-6)
    event = anomaly.anomaly_events(anomaly.zscore_series(national(spark, [0.1, 0.1, 0.1, 0.1, 0.2]), ["fear"])).first()
    assert event.severity == "moderate" and event.deviation_pct == "+100%"


def test_contributors_direction_and_reasons(spark):
    events = spark.createDataFrame(
        [("w1", "fear", 3.0), ("w1", "joy", -3.0), ("w2", "fear", 3.0), ("w3", "fear", 3.0)],
        "date_week string, emotion string, z_score double")
    cells = [("w1", p, 30 + i, *[0.1 * (i + 1)] * 6) for i, p in enumerate("abcdefg")] + [("w1", "small", 29, *[0.99] * 6), ("w2", "a", 3, *[0.5] * 6)]
    weekly = spark.createDataFrame(cells, "date_week string, province string, total_posts bigint, " + ", ".join(f"{e}_mean double" for e in EMOTIONS))
    out = {(r.date_week, r.emotion): r for r in anomaly.with_contributors(events, weekly).collect()}
    assert [p.province for p in out["w1", "fear"].top_provinces] == list("gfedc")
    assert [p.province for p in out["w1", "joy"].top_provinces] == list("abcde")
    assert out["w1", "fear"].top_provinces_reason is None
    assert out["w2", "fear"].top_provinces_reason == "no_province_with_posts_gte_30" and out["w2", "fear"].top_provinces == []
    assert out["w3", "fear"].top_provinces_reason == "no_weekly_panel_data"


def test_merge_prefers_ok_then_old(spark):
    old = spark.createDataFrame([("1", "ok", "o"), ("2", "failed", "o"), ("3", None, "o"), ("4", "failed", "o")], "post_id string, label_status string, src string")
    new = spark.createDataFrame([("1", "ok", "n"), ("2", "ok", "n"), ("3", "failed", "n"), ("5", None, "n")], "post_id string, label_status string, src string")
    assert {r.post_id: r.src for r in merge.merge_best_status(old, new).collect()} == {"1": "o", "2": "n", "3": "o", "4": "o", "5": "n"}
    assert {r.post_id: r.src for r in merge.merge_last(old, new).collect()} == {"1": "n", "2": "n", "3": "n", "4": "o", "5": "n"}
    plain = merge.merge_best_status(old.drop("label_status"), new.drop("label_status").withColumn("extra", F.lit(1)))
    assert {r.post_id: (r.src, r.extra) for r in plain.collect()}["5"] == ("n", 1)


def test_quality_report_and_recommendation(spark):
    old = labelled(spark, 200, seed=2)
    new = labelled(spark, 260, seed=3).withColumn("joy", F.when(F.col("post_id") == "p00255", 1.5).otherwise(F.col("joy")))
    merged = merge.merge_best_status(old, new)
    report = merge.quality_report(merged, old, new)
    row = report.first()
    assert row.merged_total_rows == 260 and row.duplicate_post_ids_removed == 200 and row.duplicate_post_ids_remaining == 0
    assert row.out_of_range_rows == 1
    cells = Counter((r.date_week, r.province) for r in merged.collect() if r.province != "火星")
    assert row.grid_non_empty_cells == len(cells) and row.grid_cell_median == median(cells.values())
    assert row.grid_cells_gte_15 == sum(n >= 15 for n in cells.values())
    drift = merge.emotion_drift(merged, old)
    assert row.max_emotion_drift == max(abs(r.drift) for r in drift.collect())
    verdict = merge.release_recommendation(report).first()
    assert not verdict.recommend_replace and verdict.issues == "out_of_range_rows=1"
    twice = merge.quality_report(merged.union(merged), old, new).first()
    assert twice.duplicate_post_ids_remaining == 260


def test_salted_join_equals_plain_join(spark):
    # One author writes a third of the posts and another third has no author at all.
    posts = spark.range(9000).select(
        F.col("id").alias("post_id"),
        F.when(F.col("id") % 3 == 0, "star").when(F.col("id") % 3 == 2, F.col("id").cast("string")).alias("user_id"))
    users = spark.range(0, 9000, 4).select(F.col("id").cast("string").alias("user_id"), F.lit("北京").alias("province")).union(
        spark.createDataFrame([("star", "上海")], "user_id string, province string"))
    plain = enrich.attach_province(posts, users, salted=False)
    salted = enrich.attach_province(posts, users)
    assert salted.count() == 9000
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    hot = [r.user_id for r in skew.hot_keys(posts, "user_id", 0.1).collect()]
    assert hot == ["star"]


def test_smallest_per_group_is_exact_under_skew(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("post_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 5)).alias("month"))
    sizes = {"hot": 700, "m0": 10, "m1": 10 ** 6, "m2": 0, "absent": 5}
    out = sampling.exact_sample(rows, sizes, "month")
    draws = rows.withColumn("draw", sampling.draw()).collect()
    expected = set()
    for month, size in sizes.items():
        members = sorted((r.draw, r.post_id) for r in draws if r.month == month)
        expected |= {p for _, p in members[:size]}
    assert {r.post_id for r in out.collect()} == expected
    again = sampling.exact_sample(rows.repartition(3), sizes, "month")
    assert {r.post_id for r in again.collect()} == expected


def test_cap_plans_fill_gaps_exactly(spark):
    mini = labelled(spark, 600, seed=5)
    done = mini.filter(F.substring("post_id", 6, 1) < "3")
    cells = {(r.date_week, r.province): r for r in enrich.cell_status(mini, done, 10).collect()}
    plan = sampling.week_cap_plan(mini, done, 10).collect()
    done_ids = {r.post_id for r in done.collect()}
    assert not done_ids & {r.post_id for r in plan} and len({r.post_id for r in plan}) == len(plan)
    assert Counter((r.date_week, r.province) for r in plan) == {k: c.to_sample for k, c in cells.items() if c.to_sample}
    for c in cells.values():
        assert c.to_sample == min(c.gap, c.candidates_available) and c.shortage == c.gap - c.to_sample
    month = sampling.month_cap_cells(mini, done, 30)
    assert month.count() == 3 * 34
    by_month = Counter((r.date_month, r.province) for r in sampling.month_cap_plan(mini, done, 30).collect())
    assert by_month == {(r.date_month, r.province): r.planned_new for r in month.collect() if r.planned_new}
    summary = sampling.plan_summary(month).first()
    assert summary.planned_new_rows == sum(by_month.values()) and summary.total_month_province_cells == 102


def test_cap_above_the_prune_limit_is_still_exact(spark):
    mini = labelled(spark, 3000, ("北京",), seed=8).withColumn("date_week", F.lit("2020-W01"))
    plan = sampling.week_cap_plan(mini, mini.limit(0), 2500)
    assert plan.count() == 2500


def test_cap_sweep_recommendation(spark):
    mini = labelled(spark, 600, seed=5)
    done = mini.filter(F.substring("post_id", 6, 1) < "3")
    n_done = done.filter("province <> '火星'").count()
    rows = {r.cap: r for r in sampling.cap_sweep(mini, done, (2, 5, 8, 20), target_range=(150, 300)).collect()}
    for cap, r in rows.items():
        cells = enrich.cell_status(mini, done, cap).collect()
        assert r.new_samples == sum(c.to_sample for c in cells)
        assert r.total_after_merge == n_done + r.new_samples
        assert r.cell_median == median(c.current_labeled + c.to_sample for c in cells)
    inside = [r for r in rows.values() if 150 <= r.total_after_merge <= 300]
    assert inside and [r.cap for r in rows.values() if r.recommended] == [max(inside, key=lambda r: (r.new_samples, -r.cap)).cap]


def test_prefixes_are_nested(spark):
    df = labelled(spark, 5000)
    smoke = {r.post_id for r in sampling.rows_for_mode(df, "smoke").collect()}
    pilot = {r.post_id for r in sampling.rows_for_mode(df, "pilot").collect()}
    assert len(smoke) == 300 and len(pilot) == 3000 and smoke < pilot
    assert sampling.rows_for_mode(df, "full").count() == 5000


def test_spread_sample(spark):
    df = labelled(spark, 500, tuple("abcdefghij"))
    out = sampling.spread_sample(df, 15, 2).collect()
    per_province = Counter(r.province for r in out)
    assert len(out) == 15 and max(per_province.values()) <= 2
    assert len({(r.province, r.date_week) for r in out}) == 15
    few = sampling.spread_sample(labelled(spark, 100, ("a", "b")), 30).collect()
    assert len(few) == 30


def test_feasibility_levels(spark):
    def decide(per_week, known):
        rows = [(f"p{p}", "2020-01", f"2020-W{w:02d}", True, per_week) for p in range(25) for w in range(4)]
        rows += [("未知", "2020-01", "2020-W01", False, known)]
        counts = spark.createDataFrame(rows, "province string, file_month string, date_week string, hit boolean, posts bigint")
        return enrich.feasibility(counts, [f"p{p}" for p in range(25)]).first()

    good = decide(30, 10)
    assert good.can_do_province and good.recommended_geo_granularity == "weekly_province" and good.warnings == []
    low = decide(10, 5000)
    assert low.recommended_geo_granularity == "national_timeline_only" and len(low.warnings) == 4
    assert low.good_provinces_count == 0 and low.total_provinces_count == 25


def test_province_counts_skip_blank_users(spark):
    posts = spark.createDataFrame(
        [("1", "u1", "2020-01-06", "2020-01"), ("2", " ", "2020-01-06", "2020-01"), ("3", "nan", "2020-01-06", "2020-01"),
         ("4", "u2", "bad", "2020-01"), ("5", "u1", "2020-01-07", "2020-01")],
        "post_id string, user_id string, created_at string, file_month string")
    users = spark.createDataFrame([("u1", "北京")], "user_id string, province string")
    counts = enrich.province_counts(posts, users)
    assert sorted((r.province, r.date_week, r.hit, r.posts) for r in counts.collect() if r.date_week) == [("北京", "2020-W02", True, 2)]
    coverage = enrich.join_coverage(counts).first()
    assert (coverage.total_rows, coverage.join_hits, coverage.valid_province_count) == (3, 2, 2)


def test_validation_measures(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "a")] + [("c", "a")]
    df = spark.createDataFrame(rows, "label_true string, predicted string")
    report = {r.label: r for r in validate.class_report(df, ["a", "b", "c", "d"]).collect()}
    assert report["a"].precision == pytest.approx(5 / 7) and report["a"].recall == pytest.approx(5 / 7) and report["a"].support == 7
    assert report["c"].f1 == 0 and report["d"].support == 0
    row = validate.f1_summary(df, ["a", "b", "c", "d"]).first()
    assert row.accuracy == pytest.approx(8 / 12) and row.micro_f1 == pytest.approx(8 / 12)
    assert row.macro_f1 == pytest.approx(mean(r.f1 for r in report.values()))
    matrix = {r.label_true: r.asDict() for r in validate.confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert matrix["a"] == {"label_true": "a", "a": 5, "b": 2, "c": 0}


def test_pearson_edge_cases(spark):
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def r(rows):
        return validate.pearson_r(spark.createDataFrame(rows, schema), "x", "y").first()

    assert r([(1.0, 2.0), (2.0, 4.0), (float("nan"), 1.0), (float("inf"), 1.0), (3.0, 6.0), (None, 1.0)]).pearson_r == pytest.approx(1.0)
    assert r([(1.0, 2.0)]).pearson_r is None
    assert r([(1.0, 2.0), (1.0, 3.0)]).pearson_r is None


def test_label_map(spark):
    df = spark.createDataFrame([("1", "happy"), ("2", "bored"), ("3", "sad")], "id string, label string")
    assert {r.id: r.label_cn for r in validate.map_labels(df).collect()} == {"1": "喜悦", "3": "悲伤"}


def test_dashboard_queries(spark):
    df = labelled(spark, 300)
    top = dashboard.top_posts(df.withColumn("content_clean", F.when(F.col("post_id") == "p00001", " 　").otherwise("text")))
    rows = top.collect()
    assert all(r.post_id != "p00001" for r in rows)
    best = defaultdict(list)
    for r in df.collect():
        if r.post_id != "p00001":
            for e in EMOTIONS:
                best[r.province, e].append((-r[e], r.post_id))
    for key, members in best.items():
        assert [r.post_id for r in sorted((r for r in rows if (r.province, r.emotion) == key), key=lambda r: r["rank"])] == [
            p for _, p in sorted(members)[:5]]
    monthly = panels.monthly_panel(df, None, 10 ** 6)
    assert {r.source for r in dashboard.map_dataset(monthly, panels.province_vectors(df)).collect()} == {"whole"}
    assert {r.source for r in dashboard.map_dataset(panels.monthly_panel(df, None, 1), panels.province_vectors(df)).collect()} == {"month"}
    same = spark.createDataFrame([("a", 0.1, 0.1, 0.2), ("b", 0.1, 0.1, 0.2)], "province string, joy_mean_all double, surprise_mean_all double, neutral_mean_all double")
    assert {r.normalized for r in dashboard.map_normalised(same).collect()} == {50.0}


def test_period_delta_with_one_week(spark):
    row = anomaly.period_delta(panels.national_timeline(labelled(spark, 1))).first()
    assert row.previous_week is None and row.positive_delta == 0.0


def test_a_salted_join_computes_its_posts_once(spark):
    posts = spark.range(3000).select(F.col("id").alias("post_id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("u"), "id")).alias("user_id"))
    staged, hot = skew.stage_with_hot_keys(posts, "user_id", 0.1)
    assert hot == ["hot"] and staged.count() == 3000
    users = spark.createDataFrame([("hot", "北京"), ("u1", "上海")], "user_id string, province string")
    joined = enrich.attach_province(posts, users)
    assert joined.filter("province = '北京'").count() == 1500 and joined.count() == 3000
    # The plan reads the staged posts once, and not the posts themselves.
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [post_id") == 1 and "Range (" not in plan


def test_sample_by_month_does_not_shuffle_the_texts(spark):
    """No task reads a month: rows meet their group's cut where they are."""
    rows = spark.range(4000).select(F.col("id").alias("post_id"), F.when(F.col("id") % 3 < 2, "m").otherwise("n").alias("file_month"), F.repeat(F.lit("x"), 100).alias("text"))
    out = sampling.exact_sample(rows, {"m": 50})
    plan = out._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sampling.exact_sample(rows, {"m": 50})
        assert "SortMergeJoin" not in out._jdf.queryExecution().toString() and out.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
