import random

import pytest
from pyspark.sql import functions as F

from feltgrid.domain import EMOTIONS
from feltgrid.operators import moments, panels
from feltgrid.plans import build


def posts(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        scores = [None if rng.random() < 0.05 else 1e6 + rng.random() if e == "fear" else rng.random() for e in EMOTIONS]
        rows.append((f"p{i}", f"2020-W{rng.randrange(1, 7):02d}", f"2020-0{rng.randrange(1, 4)}", rng.choice(["北京", "上海", "广东"]), rng.randrange(5, 90), *scores))
    return spark.createDataFrame(rows, "post_id string, date_week string, date_month string, province string, word_count int, " + ", ".join(f"{e} double" for e in EMOTIONS))


def rows_of(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def same(got, want, keys):
    got, want = rows_of(got, keys), rows_of(want, keys)
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k].keys() == row.keys()
        for c, value in row.items():
            assert got[k][c] == (pytest.approx(value, rel=1e-9, abs=1e-7) if isinstance(value, float) else value), (k, c)


def test_views_over_merged_states_equal_the_panels(spark):
    df = posts(spark)
    number = F.substring("post_id", 2, 9).cast("int")
    state = moments.merge_moments(*[moments.post_moments(df.filter(number % 4 == i)) for i in range(4)])
    same(moments.weekly_panel(state, min_posts=5), panels.weekly_panel(df, min_posts=5), ["date_week", "province"])
    same(moments.monthly_panel(state, min_posts=5), panels.monthly_panel(df, min_posts=5), ["date_month", "province"])
    same(moments.national_timeline(state), panels.national_timeline(df), ["date_week"])
    same(moments.province_vectors(state), panels.province_vectors(df), ["province"])
    same(moments.emotion_distribution(state), panels.emotion_distribution(df), ["emotion"])


def test_replaced_and_removed_posts(spark, tmp_path):
    df = posts(spark)
    number = F.substring("post_id", 2, 9).cast("int")
    wrong = df.withColumn("joy", F.lit(0.5)).withColumn("province", F.when(number % 7 == 0, "广东").otherwise(F.col("province")))
    old = wrong.filter(number % 2 == 0)
    first = build.expand_panels(None, old, str(tmp_path / "one"), min_posts=5)
    full = build.expand_panels(first["moments"], df, str(tmp_path / "two"), replaced=old, min_posts=5)
    same(full["emotion_panel_weekly"], panels.weekly_panel(df, min_posts=5), ["date_week", "province"])
    same(full["province_emotion_vectors"], panels.province_vectors(df), ["province"])
    # Taking everything out leaves nothing.
    assert moments.merge_moments(full["moments"], moments.negative(moments.post_moments(df))).count() == 0


def test_an_expansion_does_not_read_earlier_posts(spark, tmp_path):
    df = posts(spark)
    df.write.parquet(str(tmp_path / "old"))
    df.limit(20).write.parquet(str(tmp_path / "new"))
    moments.post_moments(spark.read.parquet(str(tmp_path / "old"))).write.parquet(str(tmp_path / "state"))
    merged = moments.merge_moments(spark.read.parquet(str(tmp_path / "state")), moments.post_moments(spark.read.parquet(str(tmp_path / "new"))))
    plan = moments.weekly_panel(merged)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("/old" in f for f in merged.inputFiles()) and "content" not in plan
