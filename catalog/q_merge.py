"""Merging labelled sets and release checks."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.domain import EMOTIONS
from feltgrid.operators import merge

SETS = f"""
old_set AS (SELECT *, CASE WHEN post_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS label_status FROM posts WHERE post_id % 3 <> 0),
new_set AS (SELECT * REPLACE (joy + 0.001 AS joy), CASE WHEN post_id % 5 = 0 THEN NULL ELSE 'ok' END AS label_status
            FROM posts WHERE post_id % 2 = 0),
both_sets AS (SELECT *, 0 AS source FROM old_set UNION ALL SELECT *, 1 FROM new_set),
best AS (SELECT * FROM both_sets QUALIFY row_number() OVER (PARTITION BY post_id
           ORDER BY CASE WHEN label_status = 'ok' THEN 0 ELSE 1 END, source) = 1)"""


def sets(spark, d):
    posts = v.posts(spark, d)
    key = F.col("post_id")
    old = posts.filter(key % 3 != 0).withColumn("label_status", F.when(key % 7 == 0, "failed").otherwise("ok"))
    new = (
        posts.filter(key % 2 == 0)
        .withColumn("joy", F.col("joy") + 0.001)
        .withColumn("label_status", F.when(key % 5 != 0, "ok"))
    )
    return old, new


def merged(spark, d):
    return merge.merge_best_status(*sets(spark, d))


@query(v.with_(v.POSTS, SETS, select="SELECT post_id, label_status, round(joy, 6) AS joy FROM best"))
def merge_best_status(spark, d):
    return v.rounded(merged(spark, d).select("post_id", "label_status", "joy"))


@query(v.with_(v.POSTS, SETS, select="""
SELECT post_id, label_status, round(joy, 6) AS joy FROM both_sets
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY source DESC) = 1"""))
def merge_last(spark, d):
    return v.rounded(merge.merge_last(*sets(spark, d)).select("post_id", "label_status", "joy"))


@query(v.with_(v.POSTS, SETS, select="SELECT post_id FROM old_set INTERSECT SELECT post_id FROM new_set"))
def id_overlap(spark, d):
    return merge.id_overlap(*sets(spark, d))


@query(v.with_(v.POSTS, SETS, select="""
SELECT count(*)::BIGINT AS rows, count(DISTINCT post_id)::BIGINT AS distinct_ids,
       (count(*) - count(DISTINCT post_id))::BIGINT AS duplicate_rows FROM both_sets"""))
def dup_report(spark, d):
    old, new = sets(spark, d)
    return merge.duplicate_report(old.unionByName(new))


@query(v.with_(v.POSTS, SETS, select="""
SELECT DISTINCT post_id FROM new_set WHERE post_id NOT IN (SELECT post_id FROM old_set)"""))
def plan_check(spark, d):
    old, new = sets(spark, d)
    return merge.plan_check(new.unionByName(new), old, "created_at").select("post_id")


SUM_VALID = f"round(avg((abs({' + '.join(EMOTIONS)} - 1.0) < 0.05)::INT), 4)"


@query(v.with_(v.POSTS, SETS, select=f"""
SELECT (SELECT count(*) FROM old_set)::BIGINT AS old_rows, (SELECT count(*) FROM new_set)::BIGINT AS new_rows,
       count(*)::BIGINT AS merged_rows,
       (SELECT count(*) FROM old_set WHERE post_id IN (SELECT post_id FROM new_set))::BIGINT AS duplicate_post_ids,
       round(avg(CASE WHEN label_status = 'ok' THEN 1 ELSE 0 END), 4) AS ok_rate,
       {SUM_VALID} AS emotion_sum_valid_rate FROM best"""))
def merge_summary(spark, d):
    old, new = sets(spark, d)
    return merge.merge_summary(old, new, merge.merge_best_status(old, new))


DRIFT = "drift AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS emotion, round((SELECT avg({e}) FROM best), 4) AS merged_mean, round((SELECT avg({e}) FROM old_set), 4) AS old_mean, "
    f"round((SELECT avg({e}) FROM best) - (SELECT avg({e}) FROM old_set), 4) AS drift" for e in EMOTIONS
) + ")"


@query(v.with_(v.POSTS, SETS, DRIFT, select="SELECT * FROM drift"))
def emotion_drift(spark, d):
    return merge.emotion_drift(merged(spark, d), sets(spark, d)[0])


REPORT = f"""
cells AS (SELECT date_week, province, count(*) AS n FROM best GROUP BY 1, 2),
by_province AS (SELECT province, count(*) AS n FROM best GROUP BY 1),
by_week AS (SELECT date_week, count(*) AS n FROM best GROUP BY 1),
report AS (SELECT
  (SELECT count(*) FROM old_set)::BIGINT AS old_merged_rows, (SELECT count(*) FROM new_set)::BIGINT AS new_labeled_rows,
  0::BIGINT AS plan_rows, (SELECT count(*) FROM best)::BIGINT AS merged_total_rows,
  (SELECT count(*) FROM old_set WHERE post_id IN (SELECT post_id FROM new_set))::BIGINT AS duplicate_post_ids_removed,
  (SELECT count(*) - count(DISTINCT post_id) FROM best)::BIGINT AS duplicate_post_ids_remaining,
  (SELECT {SUM_VALID} FROM best) AS emotion_sum_valid_rate,
  (SELECT count(*) FROM best WHERE {" OR ".join(f"{e} < 0 OR {e} > 1" for e in EMOTIONS)})::BIGINT AS out_of_range_rows,
  {", ".join(f"(SELECT round(avg({e}), 4) FROM best) AS {e}_mean" for e in EMOTIONS)},
  (SELECT min(n) FROM by_province)::BIGINT AS province_sample_min, (SELECT max(n) FROM by_province)::BIGINT AS province_sample_max,
  (SELECT round(median(n), 1) FROM by_province) AS province_sample_median, (SELECT count(*) FROM by_province)::BIGINT AS province_count,
  (SELECT count(*) FROM by_week)::BIGINT AS week_count, (SELECT min(n) FROM by_week)::BIGINT AS week_sample_min,
  (SELECT max(n) FROM by_week)::BIGINT AS week_sample_max,
  (SELECT count(*) FROM cells)::BIGINT AS grid_non_empty_cells,
  ((SELECT count(*) FROM by_week) * (SELECT count(*) FROM by_province))::BIGINT AS grid_total_cells_theoretical,
  (SELECT count(*) FROM cells WHERE n >= 15)::BIGINT AS grid_cells_gte_15, (SELECT count(*) FROM cells WHERE n >= 30)::BIGINT AS grid_cells_gte_30,
  (SELECT min(n) FROM cells)::BIGINT AS grid_cell_min, (SELECT max(n) FROM cells)::BIGINT AS grid_cell_max,
  (SELECT round(median(n), 1) FROM cells) AS grid_cell_median,
  (SELECT round(max(abs(drift)), 4) FROM drift) AS max_emotion_drift)"""


def report(spark, d):
    old, new = sets(spark, d)
    return merge.quality_report(merge.merge_best_status(old, new), old, new, 0, v.NATIONS)


@query(v.with_(v.POSTS, SETS, DRIFT, REPORT, select="SELECT * FROM report"))
def quality_report(spark, d):
    return report(spark, d)


@query(v.with_(v.POSTS, SETS, DRIFT, REPORT, select="""
SELECT concat_ws('; ',
         CASE WHEN duplicate_post_ids_remaining > 0 THEN 'duplicate_post_ids=' || duplicate_post_ids_remaining END,
         CASE WHEN out_of_range_rows > 0 THEN 'out_of_range_rows=' || out_of_range_rows END,
         CASE WHEN emotion_sum_valid_rate < 0.95 THEN 'sum_valid_rate=' || emotion_sum_valid_rate END,
         CASE WHEN max_emotion_drift > 0.0001 THEN 'emotion_drift=' || printf('%.4f', max_emotion_drift) END) AS issues,
       duplicate_post_ids_remaining = 0 AND out_of_range_rows = 0 AND emotion_sum_valid_rate >= 0.95
         AND max_emotion_drift <= 0.0001 AS recommend_replace FROM report"""))
def release_recommendation(spark, d):
    # A tight drift limit, so that the fixture raises an issue.
    return merge.release_recommendation(report(spark, d), max_drift=0.0001)
