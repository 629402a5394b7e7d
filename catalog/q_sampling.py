"""Samples, cap plans and cap sweeps."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.q_enrich import GRID, cells_sql, mini_and_labelled
from feltgrid.operators import sampling
from feltgrid.operators.skew import smallest_per_group

MONTH_CELLS = f"""
month_cells AS (
  SELECT *, existing_labeled + planned_new AS expected_total, existing_labeled + planned_new >= 30 AS reliable_after
  FROM (SELECT *, least(gap, available_candidates) AS planned_new, gap - least(gap, available_candidates) AS shortage
        FROM (SELECT *, {v.CAP}::BIGINT AS cap, greatest({v.CAP} - existing_labeled, 0)::BIGINT AS gap FROM grid_counts)))"""


def month_cells(spark, d):
    return sampling.month_cap_cells(*mini_and_labelled(spark, d), v.CAP, v.NATIONS)


@query(v.with_(v.POSTS, GRID, MONTH_CELLS, select="SELECT * FROM month_cells"))
def cap_plan_month(spark, d):
    return month_cells(spark, d)


@query(v.with_(v.POSTS, GRID, MONTH_CELLS, select="""
SELECT sum(existing_labeled)::BIGINT AS existing_labeled_rows, sum(available_candidates)::BIGINT AS candidate_unlabeled_rows,
       sum(planned_new)::BIGINT AS planned_new_rows, sum(expected_total)::BIGINT AS expected_total_after_labeling,
       count(*) FILTER (existing_labeled > 0)::BIGINT AS before_month_province_coverage,
       count(*) FILTER (expected_total > 0)::BIGINT AS after_month_province_coverage,
       count(*)::BIGINT AS total_month_province_cells,
       count(*) FILTER (existing_labeled >= 5)::BIGINT AS before_reliable_cells_count,
       count(*) FILTER (reliable_after)::BIGINT AS after_reliable_cells_count,
       round(count(*) FILTER (existing_labeled >= 5) * 100.0 / count(*), 1)::DOUBLE AS before_reliable_pct,
       round(count(*) FILTER (reliable_after) * 100.0 / count(*), 1)::DOUBLE AS after_reliable_pct,
       count(*) FILTER (shortage > 0)::BIGINT AS shortage_cells_count, sum(shortage)::BIGINT AS shortage_total_missing
FROM month_cells"""))
def plan_summary(spark, d):
    return sampling.plan_summary(month_cells(spark, d), 5)


LOW, HIGH = 9000, 11000


@query(v.with_(v.POSTS, cells_sql("cap", f", (VALUES {', '.join(f'({c})' for c in (2, 3, 4, 5, 6, 8))}) AS c(cap)"), f"""
sweep AS (SELECT cap, sum(to_sample)::BIGINT AS new_samples, count(*) FILTER (shortage > 0)::BIGINT AS shortage_cells,
                 sum(shortage)::BIGINT AS total_shortage, min(current_labeled + to_sample)::BIGINT AS cell_min,
                 max(current_labeled + to_sample)::BIGINT AS cell_max, round(median(current_labeled + to_sample), 1) AS cell_median,
                 count(*) FILTER (current_labeled + to_sample >= 15)::BIGINT AS cells_gte_15,
                 count(*) FILTER (current_labeled + to_sample >= 30)::BIGINT AS cells_gte_30, count(*)::BIGINT AS total_cells,
                 (SELECT count(*) FROM posts WHERE post_id % 3 = 0)::BIGINT + sum(to_sample)::BIGINT AS total_after_merge
          FROM week_cells GROUP BY cap)""", select=f"""
SELECT *, total_after_merge BETWEEN {LOW} AND {HIGH} AS in_target_range, total_after_merge <= {HIGH} AS within_limit,
       row_number() OVER (ORDER BY (total_after_merge BETWEEN {LOW} AND {HIGH}) DESC,
         CASE WHEN total_after_merge BETWEEN {LOW} AND {HIGH} THEN -new_samples ELSE abs(total_after_merge - {(LOW + HIGH) // 2}) END, cap) = 1 AS recommended
FROM sweep"""))
def cap_sweep(spark, d):
    return sampling.cap_sweep(*mini_and_labelled(spark, d), (2, 3, 4, 5, 6, 8), v.NATIONS, (LOW, HIGH))


TARGETS = {f"{y}-{m:02d}": 40 + 10 * m for y in range(1995, 2002) for m in range(1, 13)}


@query(v.with_(v.POSTS, select=f"""
SELECT post_id, date_month FROM posts
QUALIFY row_number() OVER (PARTITION BY date_month ORDER BY {v.DRAW_SQL}, post_id) <= 40 + 10 * CAST(substr(date_month, 6, 2) AS INT)"""))
def exact_k_sample(spark, d):
    rows = v.posts(spark, d).select("post_id", "date_month")
    return sampling.exact_sample(rows, TARGETS, "date_month", order=v.arithmetic_draw())


PICK = "row_number() OVER (PARTITION BY {keys} ORDER BY " + v.DRAW_SQL + ", post_id)"


@query(v.with_(v.POSTS, GRID, MONTH_CELLS, select=f"""
SELECT post_id, date_month, province FROM (
  SELECT *, {PICK.format(keys="date_month, province")} AS rank FROM posts WHERE post_id % 3 <> 0)
JOIN month_cells USING (date_month, province) WHERE rank <= planned_new"""))
def stratified_pick_month(spark, d):
    plan = sampling.month_cap_plan(*mini_and_labelled(spark, d), v.CAP, v.NATIONS, v.arithmetic_draw())
    return plan.select("post_id", "date_month", "province")


@query(v.with_(v.POSTS, cells_sql("2"), select=f"""
SELECT post_id, date_week, province FROM (
  SELECT *, {PICK.format(keys="date_week, province")} AS rank FROM posts WHERE post_id % 3 <> 0)
JOIN week_cells USING (date_week, province) WHERE rank <= to_sample"""))
def stratified_pick_week(spark, d):
    plan = sampling.week_cap_plan(*mini_and_labelled(spark, d), 2, v.NATIONS, v.arithmetic_draw())
    return plan.select("post_id", "date_week", "province")


@query(v.with_(v.POSTS, select=f"SELECT post_id FROM posts ORDER BY {v.DRAW_SQL}, post_id LIMIT 300"))
def shuffled_prefix(spark, d):
    return sampling.rows_for_mode(v.posts(spark, d), "smoke", order=v.arithmetic_draw()).select("post_id")


@query(v.with_(v.POSTS, f"""
drawn AS (SELECT post_id, province, date_week, {v.DRAW_SQL} AS draw FROM posts),
one AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY province, date_week ORDER BY draw, post_id) = 1),
two AS (SELECT *, row_number() OVER (PARTITION BY province ORDER BY draw, post_id) AS r FROM one QUALIFY r <= 2),
spread AS (SELECT post_id, draw FROM two ORDER BY r, draw, post_id LIMIT 60),
extra AS (SELECT post_id, draw FROM drawn WHERE post_id NOT IN (SELECT post_id FROM spread) ORDER BY draw, post_id
          LIMIT (SELECT 60 - count(*) FROM spread))""", select="""
SELECT post_id, province, date_week FROM drawn
WHERE post_id IN (SELECT post_id FROM spread UNION ALL SELECT post_id FROM extra)"""))
def spread_smoke(spark, d):
    return sampling.spread_sample(v.posts(spark, d), order=v.arithmetic_draw()).select("post_id", "province", "date_week")


@query("""
SELECT item_id FROM benchmark ORDER BY ((item_id % 1000003) * 2654435761 % 2147483647), item_id LIMIT 25""")
def bounded_sample(spark, d):
    bench = v.table(spark, d, "benchmark")
    return sampling.bounded_sample(bench, 25, "item_id", v.arithmetic_draw("item_id")).select("item_id")


@query(v.with_(v.POSTS, select="""
SELECT post_id, date_month FROM posts
QUALIFY row_number() OVER (PARTITION BY date_month ORDER BY created_at, post_id) <= 50"""))
def first_posts_per_month(spark, d):
    day = F.unix_date(F.to_date("created_at")).cast("bigint")
    rows = v.posts(spark, d).select("post_id", "date_month", "created_at")
    return smallest_per_group(rows, "date_month", 50, day, day, "post_id").drop("created_at")
