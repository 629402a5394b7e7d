"""Agreement of predicted with human labels."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.operators import validate

LABELS = ["good", "bad", "plain"]

# True class from the human labels, predicted class from a rule on the text length.
JUDGED = """
judged AS (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS label_true,
                  CASE n_chars % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' ELSE 'plain' END AS predicted, n_chars, quality
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
CONFUSION = """
confusion AS (SELECT t.label AS label_true, p.label AS predicted, count(j.doc_id)::BIGINT AS n
              FROM (VALUES ('good'), ('bad'), ('plain')) t(label), (VALUES ('good'), ('bad'), ('plain')) p(label)
              LEFT JOIN judged j ON j.label_true = t.label AND j.predicted = p.label GROUP BY 1, 2)"""
REPORT = """
sides AS (SELECT label_true AS label, n AS support, 0 AS said, CASE WHEN label_true = predicted THEN n ELSE 0 END AS hits FROM confusion
          UNION ALL SELECT predicted, 0, n, 0 FROM confusion),
report AS (SELECT label, coalesce(sum(hits) / nullif(sum(said), 0), 0)::DOUBLE AS precision,
                  coalesce(sum(hits) / nullif(sum(support), 0), 0)::DOUBLE AS recall,
                  coalesce(2 * sum(hits) / nullif(sum(said) + sum(support), 0), 0)::DOUBLE AS f1, sum(support)::BIGINT AS support
           FROM sides GROUP BY label)"""


def judged(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "n_chars")
    rows = docs.join(v.table(spark, d, "labels"), "doc_id")
    kind = F.col("n_chars") % 3
    return rows.select(
        "doc_id", "n_chars", "quality",
        F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").otherwise("plain").alias("label_true"),
        F.when(kind == 0, "good").when(kind == 1, "bad").otherwise("plain").alias("predicted"),
    )


@query(v.with_(JUDGED, CONFUSION, select="SELECT * FROM confusion"))
def confusion_counts(spark, d):
    return validate.confusion_counts(judged(spark, d), LABELS)


@query(v.with_(JUDGED, CONFUSION, select="""
SELECT label_true, sum(n) FILTER (predicted = 'good')::BIGINT AS good, sum(n) FILTER (predicted = 'bad')::BIGINT AS bad,
       sum(n) FILTER (predicted = 'plain')::BIGINT AS plain FROM confusion GROUP BY 1"""))
def confusion_matrix(spark, d):
    return validate.confusion_matrix(judged(spark, d), LABELS)


@query(v.with_(JUDGED, CONFUSION, REPORT, select=f"SELECT label, {v.round_cols('precision', 'recall', 'f1')}, support FROM report"))
def class_report(spark, d):
    return v.rounded(validate.class_report(judged(spark, d), LABELS))


@query(v.with_(JUDGED, CONFUSION, REPORT, select="""
SELECT round((SELECT avg((label_true = predicted)::INT) FROM judged), 6) AS accuracy,
       round((SELECT avg((label_true = predicted)::INT) FROM judged), 6) AS micro_f1,
       (SELECT count(*) FROM judged)::BIGINT AS rows,
       round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(recall * support) / sum(support), 6) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM report"""))
def f1_summary(spark, d):
    return v.rounded(validate.f1_summary(judged(spark, d), LABELS))


@query(v.with_(JUDGED, select="""
SELECT count(*)::BIGINT AS pairs, round(corr(n_chars, quality), 6) AS pearson_r FROM judged"""))
def pearson_r(spark, d):
    return v.rounded(validate.pearson_r(judged(spark, d), "n_chars", "quality"))
