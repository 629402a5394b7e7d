"""Clustering of province vectors and its evolution."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from catalog.q_dashboard import vectors
from catalog.q_panels import monthly
from feltgrid.domain import CLUSTER_FEATURES, EMOTIONS, MONTHLY_CLUSTERS, MONTHLY_FEATURES
from feltgrid.operators import cluster
from feltgrid.operators.rows import beside as rows_beside
from feltgrid.operators.stage import stage

SCALED = "scaled AS (SELECT province, " + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" for f in CLUSTER_FEATURES
) + " FROM vectors)"
# A fixed rule stands in for cluster labels where SQL has to know them.
RULE = "CAST(substr(province, 8) AS INT) % 4"


def rule_label():
    return F.substring("province", 8, 4).cast("int") % 4


def scaled(spark, d):
    rows = stage(cluster.eligible(vectors(spark, d), "total_posts_all", 1, CLUSTER_FEATURES))
    return cluster.standardise(rows, CLUSTER_FEATURES).select("province", *CLUSTER_FEATURES)


@query(v.with_(v.POSTS, v.VECTORS, SCALED, select=f"SELECT province, {v.round_cols(*CLUSTER_FEATURES)} FROM scaled"))
def scaled_features(spark, d):
    return v.rounded(scaled(spark, d))


DISTANCE = " + ".join(f"power(a.{f} - b.{f}, 2)" for f in CLUSTER_FEATURES)


@query(v.with_(v.POSTS, v.VECTORS, SCALED, f"""
pts AS (SELECT *, {RULE} AS label FROM scaled),
dist AS (SELECT a.province, a.label, b.label AS other, sum(sqrt({DISTANCE})) AS total, count(*) AS n FROM pts a, pts b GROUP BY 1, 2, 3),
ab AS (SELECT province, label, coalesce(max(total / nullif(n - 1, 0)) FILTER (label = other), 0) AS a,
              min(total / n) FILTER (label <> other) AS b FROM dist GROUP BY 1, 2)""", select="""
SELECT 'rule' AS k, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab"""))
def silhouette(spark, d):
    labelled = scaled(spark, d).withColumn("label", rule_label()).withColumn("k", F.lit("rule"))
    return v.rounded(cluster.silhouette(labelled, "province", CLUSTER_FEATURES))


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
stats AS (SELECT label, count(*) AS n, sum(list_dot_product(x, x)) AS q FROM e GROUP BY 1),
dims AS (SELECT label, i, sum(x[i]) AS s FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
centres AS (SELECT label, list(s ORDER BY i) AS s FROM dims GROUP BY 1),
dist AS (SELECT vec_id, e.label, t.label AS other, n,
                (n * list_dot_product(x, x) - 2 * list_dot_product(x, c.s) + q) AS total
         FROM e, stats t JOIN centres c ON c.label = t.label),
ab AS (SELECT vec_id, max(total / nullif(n - 1, 0)) FILTER (label = other) AS a, min(total / n) FILTER (label <> other) AS b
       FROM dist GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette_embeddings(spark, d):
    return v.rounded(cluster.silhouette_squared(v.table(spark, d, "embeddings"), "embedding", "label"))


@query(v.with_(v.POSTS, v.VECTORS, select=f"""
SELECT {RULE} AS cluster_label, count(*)::BIGINT AS province_count, string_agg(province, ', ' ORDER BY province) AS provinces,
       {", ".join(f"round(avg({f}), 6) AS {f}" for f in CLUSTER_FEATURES)} FROM vectors GROUP BY 1"""))
def cluster_profiles(spark, d):
    return v.rounded(cluster.cluster_profiles(vectors(spark, d).withColumn("cluster_label", rule_label())))


@query(v.with_(v.POSTS, v.VECTORS, f"""
summary AS (SELECT CASE WHEN {RULE} = 3 THEN 0 ELSE {RULE} END AS cluster, string_agg(province, ',' ORDER BY province) AS provinces,
                   sum(total_posts_all)::BIGINT AS posts, {", ".join(f"avg({e}_mean_all) AS {e}" for e in EMOTIONS)},
                   avg(emotional_intensity_mean) AS intensity FROM vectors GROUP BY 1)""", select=f"""
SELECT cluster, provinces, posts, {v.round_cols(*EMOTIONS, "intensity")}, {v.dominant_sql("")} AS dominant FROM summary"""))
def cluster_summaries(spark, d):
    rows = vectors(spark, d)
    # Provinces of rule label 3 have no label here and count as cluster 0.
    labels = rows.select("province", rule_label().alias("cluster_label")).filter("cluster_label <> 3")
    summary = cluster.cluster_summaries(rows, labels)
    return v.rounded(summary.withColumn("provinces", F.array_join("provinces", ",")))


MONTH_LABELS = f"""
eligible AS (SELECT date_month, province, {", ".join(MONTHLY_FEATURES)},
                    (CAST(substr(province, 8) AS INT) + CAST(substr(date_month, 6, 2) AS INT)) % 3 AS label
             FROM monthly WHERE total_posts >= {v.MIN_POSTS}),
risks AS (SELECT date_month, label, row_number() OVER (PARTITION BY date_month ORDER BY round(
            avg(sadness_mean) + avg(anger_mean) + avg(fear_mean) - avg(joy_mean), 12), label) - 1 AS cluster
          FROM eligible GROUP BY 1, 2),
aligned AS (SELECT date_month, province, label, cluster::INT AS cluster FROM eligible JOIN risks USING (date_month, label))"""


def month_labels(spark, d):
    rows = stage(cluster.eligible(monthly(spark, d), "total_posts", v.MIN_POSTS, MONTHLY_FEATURES))
    label = (F.substring("province", 8, 4).cast("int") + F.substring("date_month", 6, 2).cast("int")) % 3
    labelled = rows.select("date_month", "province", *MONTHLY_FEATURES, label.alias("label"))
    return cluster.align_by_risk(labelled).select("date_month", "province", "label", "cluster")


@query(v.with_(v.POSTS, v.MONTHLY, MONTH_LABELS, select="SELECT * FROM aligned"))
def risk_alignment(spark, d):
    return month_labels(spark, d)


@query(v.with_(v.POSTS, v.MONTHLY, MONTH_LABELS, select="""
SELECT province, string_agg(date_month || '=' || cluster, ',' ORDER BY date_month) AS cells
FROM (SELECT p.province, m.date_month, coalesce(a.cluster, -1) AS cluster
      FROM (SELECT DISTINCT province FROM aligned) p CROSS JOIN (SELECT DISTINCT date_month FROM aligned) m
      LEFT JOIN aligned a ON a.province = p.province AND a.date_month = m.date_month)
GROUP BY province"""))
def evolution_matrix(spark, d):
    """Each row of the matrix as one text, month by month in the order of its columns."""
    matrix = cluster.evolution_matrix(month_labels(spark, d))
    cells = [F.concat(F.lit(f"{m}="), F.col(m)) for m in matrix.columns if m != "province"]
    return matrix.select("province", F.concat_ws(",", *cells).alias("cells"))


@query(v.with_(v.POSTS, v.MONTHLY, MONTH_LABELS, select="""
SELECT p.province, m.date_month, coalesce(a.cluster, -1) AS cluster, a.cluster IS NOT NULL AS present
FROM (SELECT DISTINCT province FROM aligned) p, (SELECT DISTINCT date_month FROM aligned) m
LEFT JOIN aligned a ON a.province = p.province AND a.date_month = m.date_month"""))
def evolution_cells(spark, d):
    return cluster.matrix_to_long(cluster.evolution_matrix(month_labels(spark, d)))


@query(v.with_(v.POSTS, v.MONTHLY, MONTH_LABELS, """
kept AS (SELECT * FROM aligned WHERE province IN (SELECT province FROM aligned GROUP BY 1 HAVING count(*) >= 6)),
steps AS (SELECT province, (cluster <> lag(cluster) OVER (PARTITION BY province ORDER BY date_month))::INT AS changed FROM kept)""",
               select="""
SELECT province, sum(coalesce(changed, 0))::BIGINT AS n_shifts, count(*)::BIGINT AS n_months FROM steps
GROUP BY province HAVING n_shifts > 0 AND n_months >= 2 ORDER BY n_shifts DESC, province LIMIT 10"""))
def cluster_shifts(spark, d):
    return cluster.cluster_shifts(cluster.present_filter(month_labels(spark, d)))


# --- Trees -----------------------------------------------------------------------------------


def tree_sql(rows: str, features, least: int = 1) -> str:
    """One join of the cheapest pair at a time, for each group g of ``rows`` (g, key and features), down to ``least`` clusters.

    A state holds its clusters as a list: name, number, size, members and centre.
    """
    return f"""
leaves AS (SELECT g, key, row_number() OVER (PARTITION BY g ORDER BY key) - 1 AS id, [{", ".join(f"{f}::DOUBLE" for f in features)}] AS x FROM {rows}),
tree AS (
  SELECT g, 0::BIGINT AS step, count(*) AS n, list({{'k': key, 'id': id, 'n': 1::DOUBLE, 'm': [key], 'x': x}} ORDER BY key) AS cl,
         0::BIGINT AS l, 0::BIGINT AS r, 0::DOUBLE AS cost, 0::DOUBLE AS size
  FROM leaves GROUP BY g
  UNION ALL
  SELECT g, step + 1, n,
         list_append(list_filter(cl, lambda c: c.id <> a.id AND c.id <> b.id),
                     {{'k': a.k, 'id': n + step, 'n': a.n + b.n, 'm': list_concat(a.m, b.m),
                       'x': list_transform(list_zip(a.x, b.x), lambda p: (p[1] * a.n + p[2] * b.n) / (a.n + b.n))}}),
         least(a.id, b.id), greatest(a.id, b.id), best.c, a.n + b.n
  FROM (SELECT *, list_filter(cl, lambda c: c.k = best.lo)[1] AS a, list_filter(cl, lambda c: c.k = best.hi)[1] AS b
        FROM (SELECT *, list_min(flatten(list_transform(cl, lambda a: list_transform(list_filter(cl, lambda b: b.k > a.k), lambda b: {{
                'c': 2 * a.n * b.n / (a.n + b.n) * list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                'lo': a.k, 'hi': b.k}})))) AS best
              FROM tree WHERE len(cl) > {least})))"""


#: Labels of every cut, clusters numbered by their smallest members.
CUTS = """
cut AS (SELECT g, len(cl) AS k, unnest(cl) AS c FROM tree),
cuts AS (SELECT g, k, unnest(c.m) AS key, row_number() OVER (PARTITION BY g, k ORDER BY c.k) - 1 AS label FROM cut)"""


def recursive(*ctes: str, select: str) -> str:
    return v.with_(*ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


PROVINCE_TREE = (v.POSTS, v.VECTORS, SCALED, f"named AS (SELECT '' AS g, province AS key, {', '.join(CLUSTER_FEATURES)} FROM scaled)", tree_sql("named", CLUSTER_FEATURES))
SWEEP = f"""
swept AS (SELECT k, key AS province, label FROM cuts, (SELECT count(*) AS n FROM scaled)
          WHERE k BETWEEN 2 AND CASE WHEN least(7, n - 1) < 3 THEN n - 1 ELSE least(7, n - 1) - 1 END),
gaps AS (SELECT a.province, b.province AS other, sqrt({DISTANCE}) AS gap FROM scaled a, scaled b),
sums AS (SELECT x.k, x.province, x.label, y.label AS other, sum(gap) AS total, count(*) AS n
         FROM swept x JOIN swept y ON x.k = y.k JOIN gaps ON gaps.province = x.province AND gaps.other = y.province GROUP BY ALL),
sides AS (SELECT k, province, coalesce(max(total / nullif(n - 1, 0)) FILTER (label = other), 0) AS a, min(total / n) FILTER (label <> other) AS b
          FROM sums GROUP BY k, province),
scores AS (SELECT k, avg((b - a) / greatest(a, b)) AS silhouette FROM sides GROUP BY k)"""


@query(recursive(*PROVINCE_TREE, CUTS, SWEEP, select="""
SELECT province, total_posts_all, label::INT AS cluster_label FROM swept JOIN vectors USING (province)
WHERE k = (SELECT k FROM scores ORDER BY round(silhouette, 10) DESC, k LIMIT 1)"""))
def ward_labels(spark, d):
    return cluster.cluster_provinces(vectors(spark, d), min_posts=1)[2]


@query(recursive(*PROVINCE_TREE, CUTS, SWEEP, select="SELECT k::INT AS k, round(silhouette, 6) AS silhouette FROM scores"))
def ward_sweep(spark, d):
    return v.rounded(cluster.cluster_provinces(vectors(spark, d), min_posts=1)[1])


@query(recursive(*PROVINCE_TREE, select="""
SELECT (step - 1)::INT AS step, l::INT AS "left", r::INT AS "right", round(sqrt(cost), 6) AS distance, size::BIGINT AS sample_count FROM tree WHERE step > 0"""))
def ward_linkage(spark, d):
    return v.rounded(cluster.ward_linkage(scaled(spark, d), "province", CLUSTER_FEATURES))


SQUARES = " + ".join(f"var_pop({f}) * count(*)" for f in CLUSTER_FEATURES)


@query(v.with_(v.POSTS, v.VECTORS, SCALED, select=f"SELECT count(*) - 1 AS joins, round({SQUARES}, 6) AS squares FROM scaled"))
def ward_squares(spark, d):
    """Each join raises the sum of squares within clusters by half its squared height; all joins by all of it."""
    merges = cluster.ward_merges(scaled(spark, d), "province", CLUSTER_FEATURES)
    total = F.round(F.sum(F.col("distance") * F.col("distance")) / 2, 6)
    return merges.agg(F.count(F.lit(1)).alias("joins"), total.alias("squares"))


@query(recursive(*PROVINCE_TREE, CUTS, select=f"""
SELECT key AS province, {", ".join(f"(max(label) FILTER (k = {k}))::INT AS k{k}" for k in range(2, 7))} FROM cuts GROUP BY key"""))
def label_stability(spark, d):
    rows = stage(scaled(spark, d))
    ks = list(cluster.sweep_range(rows.count()))
    return cluster.label_stability(cluster.ward_labels(rows, "province", CLUSTER_FEATURES, ks), "province", ks)


def month_scale(f: str) -> str:
    return f"({f} - avg({f}) OVER m) / CASE WHEN stddev_pop({f}) OVER m < 1e-12 THEN 1 ELSE stddev_pop({f}) OVER m END AS {f}"


@query(recursive(v.POSTS, v.MONTHLY, f"""
able AS (SELECT date_month, province, {", ".join(MONTHLY_FEATURES)}, count(*) OVER (PARTITION BY date_month) AS n FROM monthly WHERE total_posts >= {v.MIN_POSTS}),
named AS (SELECT date_month AS g, province AS key, {", ".join(map(month_scale, MONTHLY_FEATURES))} FROM able
          WHERE n >= {3 * MONTHLY_CLUSTERS} WINDOW m AS (PARTITION BY date_month))""", tree_sql("named", MONTHLY_FEATURES, MONTHLY_CLUSTERS), CUTS, f"""
found AS (SELECT able.*, coalesce(label, 0) AS label FROM able LEFT JOIN cuts ON g = date_month AND key = province AND k = {MONTHLY_CLUSTERS}),
risks AS (SELECT date_month, label, row_number() OVER (PARTITION BY date_month ORDER BY round(
            avg(sadness_mean) + avg(anger_mean) + avg(fear_mean) - avg(joy_mean), 12), label) - 1 AS cluster
          FROM found GROUP BY date_month, label)""", select="""
SELECT date_month, province, cluster::INT AS cluster FROM found JOIN risks USING (date_month, label)"""))
def monthly_ward(spark, d):
    labels = cluster.monthly_ward(monthly(spark, d), min_posts=v.MIN_POSTS)
    return cluster.align_by_risk(labels).select("date_month", "province", "cluster")


F_LIST = ", ".join(CLUSTER_FEATURES)


def axis_sql(name: str, matrix: str) -> str:
    """The first eigenvector of a symmetric matrix, a list of rows: 24 squarings leave its outer product with itself."""
    return f"""
{name}_power AS (
  SELECT 0 AS i, m FROM {matrix}
  UNION ALL
  SELECT i + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / size))
  FROM (SELECT i, s, list_max(list_transform(flatten(s), lambda x: abs(x))) AS size
        FROM (SELECT i, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS s FROM {name}_power WHERE i < 24))),
{name}_column AS (SELECT list_max(list_transform(m, lambda r: {{'n': list_dot_product(r, r), 'r': r}})).r AS v FROM {name}_power WHERE i = 24),
{name}_unit AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM {name}_column),
{name} AS (SELECT list_transform(v, lambda x: x * sign(list_max(list_transform(v, lambda y, i: {{'a': round(abs(y), 9), 'i': -i, 'y': y}})).y)) AS v FROM {name}_unit)"""


@query(recursive(v.POSTS, v.VECTORS, f"""
centred AS (SELECT province, {", ".join(f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}" for f in CLUSTER_FEATURES)} FROM vectors),
points AS (SELECT province, [{F_LIST}] AS p FROM centred),
covariance AS (SELECT [{", ".join("[" + ", ".join(f"covar_samp({a}, {b})" for b in CLUSTER_FEATURES) + "]" for a in CLUSTER_FEATURES)}] AS m FROM centred)""",
    axis_sql("one", "covariance"), """
value AS (SELECT m, v, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS e FROM covariance, one),
rest AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - e * v[i] * v[j])) AS m FROM value)""",
    axis_sql("two", "rest"), select="""
SELECT province, round(list_dot_product(p, one.v), 6) AS x, round(list_dot_product(p, two.v), 6) AS y FROM points, one, two"""))
def pca_scatter(spark, d):
    return v.rounded(cluster.pca_scatter(vectors(spark, d)).select("province", "x", "y"))


@query("SELECT (SELECT count(DISTINCT n_name) FROM nation) AS n, 0 AS misplaced, 4 AS clusters")
def kmeans_fixed_point(spark, d):
    """KMeans has come to rest: every row is nearest to the mean of its own cluster."""
    rows = stage(scaled(spark, d))
    labelled = stage(cluster.kmeans_labels(rows, "province", CLUSTER_FEATURES, 4).join(rows, "province"))
    means = labelled.groupBy("label").agg(*[F.avg(f).alias(f"_{f}") for f in CLUSTER_FEATURES])
    centres = means.agg(F.collect_list(F.struct("*")).alias("centres"))  # one row per cluster

    def gap(c):
        return sum((F.pow(F.col(f) - c[f"_{f}"], F.lit(2.0)) for f in CLUSTER_FEATURES), F.lit(0.0))

    best = F.array_min(F.transform("centres", lambda c: F.struct(gap(c).alias("gap"), c["label"].alias("label"))))
    found = rows_beside(labelled, centres).withColumn("_near", best["label"])
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_near") != F.col("label")).cast("int").alias("misplaced"),
        F.countDistinct("label").cast("int").alias("clusters"),
    )


# --- No SQL: the start of KMeans is drawn, a tree over all embeddings is too slow; see the tests ----


@query()
def kmeans_labels(spark, d):
    return cluster.kmeans_labels(scaled(spark, d), "province", CLUSTER_FEATURES, 4)


@query()
def ward_embeddings(spark, d):
    """Ward over all embeddings, exactly."""
    dims = [f"x{i}" for i in range(64)]
    rows = v.table(spark, d, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(dims)]
    )
    return cluster.ward_labels(rows, "vec_id", dims, [10]).select("vec_id", "label")
