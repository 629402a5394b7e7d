"""Dictionary tokenising: Latin letters written as Chinese characters, benchmark words as the dictionary."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.operators import keywords
from feltgrid.operators.stage import stage

LETTERS, SIGNS = "aeiouthnrsld", "甲乙丙丁戊己庚辛壬癸子丑"

WORDS_SQL = r"[一-鿿]+|[\p{L}\p{M}\p{N}_.]+"
TOKENS_SQL = f"""
written AS (SELECT post_id, date_week, translate(lower(content_clean), '{LETTERS}', '{SIGNS}') AS c FROM texts),
pieces AS (SELECT post_id, date_week, unnest(regexp_extract_all(c, '{WORDS_SQL}')) AS run FROM written),
runs AS (SELECT * FROM pieces WHERE regexp_full_match(run, '[一-鿿]+')),
dictionary AS (
  SELECT DISTINCT word, CASE WHEN length(word) % 2 = 0 THEN 'n' ELSE 'v' END AS pos
  FROM (SELECT unnest(regexp_extract_all(translate(lower(text), '{LETTERS}', '{SIGNS}'), '[一-鿿]+')) AS word FROM benchmark)
  WHERE length(word) >= 2),
sizes AS (SELECT DISTINCT length(word) AS n FROM dictionary),
grams AS (SELECT post_id, date_week, substr(run, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS word
          FROM runs, sizes, LATERAL unnest(generate_series(1, length(run) - n + 1)) p(i)),
tokens AS (SELECT post_id, date_week, word, pos FROM grams JOIN dictionary USING (word))"""


def written(text):
    return F.translate(F.lower(text), LETTERS, SIGNS)


def dictionary(spark, d):
    runs = v.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(written(F.col("text")), F.lit("([一-鿿]+)"), F.lit(1))).alias("word"))
    words = runs.filter(F.length("word") >= 2).distinct()
    return stage(words.withColumn("pos", F.when(F.length("word") % 2 == 0, "n").otherwise("v")))


def tokens(spark, d, **together):
    texts = v.texts(spark, d).select("post_id", "date_week", written(F.col("content_clean")).alias("content_clean"))
    found = keywords.tokenise(texts, dictionary=dictionary(spark, d), filtered=False, together=together)
    return found.filter("pos <> ''")


@query(v.with_(v.TEXTS, TOKENS_SQL, select="SELECT date_week, word, pos, count(*)::BIGINT AS tf FROM tokens GROUP BY ALL"))
def tokens_pos(spark, d):
    return keywords.week_term_counts(tokens(spark, d, tf=F.count(F.lit(1))))


@query(v.with_(v.TEXTS, TOKENS_SQL, select="SELECT date_week, word, arg_min(pos, post_id) AS pos FROM tokens GROUP BY ALL"))
def first_pos(spark, d):
    return keywords.first_pos(tokens(spark, d, post_id=F.min("post_id")), "post_id")


PATHS_SQL = f"""
written AS (SELECT post_id, date_week, translate(lower(content_clean), '{LETTERS}', '{SIGNS}') AS c FROM texts),
pieces AS (SELECT post_id, date_week, unnest(regexp_extract_all(c, '{WORDS_SQL}')) AS run FROM written),
runs AS (SELECT * FROM pieces WHERE regexp_full_match(run, '[一-鿿]+')),
dictionary AS (
  SELECT word, CASE WHEN length(word) % 2 = 0 THEN 'n' ELSE 'v' END AS pos, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(translate(lower(text), '{LETTERS}', '{SIGNS}'), '[一-鿿]+')) AS word FROM benchmark)
  WHERE length(word) >= 2 GROUP BY word),
total AS (SELECT sum(freq) AS n FROM dictionary),
costs AS (SELECT word, pos, length(word) AS size, CAST(round(1000 * ln(n / freq)) AS BIGINT) AS cost FROM dictionary, total),
sizes AS (SELECT DISTINCT size FROM costs),
distinct_runs AS (SELECT DISTINCT run FROM runs),
places AS (SELECT run, unnest(generate_series(1, length(run))) AS place FROM distinct_runs),
starts AS (
  SELECT p.run, p.place, c.size, c.cost FROM places p, sizes s, costs c
  WHERE p.place + s.size - 1 <= length(p.run) AND c.word = substr(p.run, p.place, s.size)),
ways AS (
  SELECT p.run, p.place, list(struct_pack(cost := s.cost, size := s.size)) FILTER (s.size IS NOT NULL) AS words
  FROM places p LEFT JOIN starts s USING (run, place) GROUP BY ALL),
back AS (
  SELECT run, CAST(length(run) AS BIGINT) AS place, [0::BIGINT] AS best, []::BIGINT[] AS path FROM distinct_runs
  UNION ALL
  SELECT run, place - 1, list_prepend(way.total, best), list_prepend(-way.less, path)
  FROM (
    SELECT b.run, b.place, b.best, b.path, list_min(list_append(
      list_transform(coalesce(w.words, []), lambda x: struct_pack(total := x.cost + b.best[x.size], less := CAST(-x.size AS BIGINT))),
      struct_pack(total := b.best[1] + (SELECT CAST(round(1000 * ln(n)) AS BIGINT) FROM total), less := CAST(0 AS BIGINT)))) AS way
    FROM back b JOIN ways w ON w.run = b.run AND w.place = b.place)),
walk AS (
  SELECT run, CAST(1 AS BIGINT) AS place, path FROM back WHERE place = 0
  UNION ALL
  SELECT run, place + greatest(path[place], 1), path FROM walk WHERE place <= length(run)),
chosen AS (SELECT run, substr(run, place, path[place]) AS word FROM walk WHERE place <= length(run) AND path[place] > 0),
tokens AS (SELECT post_id, date_week, word, pos FROM runs JOIN chosen USING (run) JOIN dictionary USING (word))"""


@query("WITH RECURSIVE " + v.TEXTS.strip() + "," + PATHS_SQL
       + "\nSELECT date_week, word, pos, count(*)::BIGINT AS tf FROM tokens GROUP BY ALL")
def tokens_path(spark, d):
    """Words on the likeliest path by their frequency in the benchmark, counted by week."""
    words = v.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(written(F.col("text")), F.lit("([一-鿿]+)"), F.lit(1))).alias("word"))
    counted = words.filter(F.length("word") >= 2).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    entries = stage(counted.withColumn("pos", F.when(F.length("word") % 2 == 0, "n").otherwise("v")))
    texts = v.texts(spark, d).select("post_id", "date_week", written(F.col("content_clean")).alias("content_clean"))
    found = keywords.tokenise(texts, dictionary=entries, filtered=False, best_path=True, together={"tf": F.count(F.lit(1))})
    return keywords.week_term_counts(found.filter("pos <> ''"))
