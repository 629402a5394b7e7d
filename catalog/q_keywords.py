"""Tokens, TF-IDF and keyword tables over the documents."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.domain import EMOTIONS, NOISE_WORDS, STOP_WORDS
from feltgrid.operators import anomaly, keywords, panels
from feltgrid.operators.stage import stage
from feltgrid.sources import tables

PATTERN = r"\p{L}{2,}"
MIN_WEEK = 8


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


RAW_TOKENS = r"""
raw_tokens AS (SELECT post_id, date_week, province, unnest(regexp_extract_all(lower(content_clean), '\p{L}{2,}')) AS word FROM texts)"""
TOKENS = f"""
tokens AS (SELECT * FROM raw_tokens WHERE length(word) >= 2 AND NOT regexp_full_match(word, '[a-zA-Z]{{1,4}}')
             AND word NOT IN {_listed(STOP_WORDS + NOISE_WORDS)})"""
COUNTS = """
counts AS (SELECT date_week, word, count(*)::BIGINT AS tf, '' AS pos FROM tokens GROUP BY 1, 2)"""
WEIGHTS = """
nw AS (SELECT count(DISTINCT date_week) AS n FROM counts),
vocab AS (SELECT word, df, total_tf, n, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
          FROM (SELECT word, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM counts GROUP BY word), nw
          WHERE df >= CASE WHEN n < 20 THEN 1 ELSE 2 END AND df <= 0.85 * n
          ORDER BY total_tf DESC, word LIMIT 8000),
weights AS (SELECT date_week, word, pos, tf, total_tf, n,
                   tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY date_week)) AS tfidf
            FROM counts JOIN vocab USING (word))"""
STATUS = f"""
status AS (SELECT date_week, count(*)::BIGINT AS total_posts,
                  CASE WHEN count(*) < {MIN_WEEK} THEN 'insufficient_data' ELSE 'ok' END AS status FROM texts GROUP BY 1)"""
KEYWORDS = """
overall AS (SELECT word, sum(tfidf) / max(n) AS g FROM weights GROUP BY word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date_week ORDER BY round(tfidf, 10) DESC, word) AS rank
           FROM weights QUALIFY rank <= 80),
keywords AS (SELECT date_week, rank, word, pos, tf, round(tfidf, 4) AS tfidf, round(g, 4) AS global_tfidf,
                    round(tfidf / greatest(g, 1e-6), 9) >= 2.0 AS surge, round(tfidf / greatest(g, 1e-6), 2) AS surge_ratio
             FROM ranked JOIN overall USING (word)
             WHERE date_week IN (SELECT date_week FROM status WHERE status = 'ok'))"""
LISTS = """
offers AS (SELECT *, 'top' AS list_kind, tfidf AS key FROM keywords UNION ALL
           SELECT *, 'frequent', tf FROM keywords UNION ALL
           SELECT *, 'surge', surge_ratio FROM keywords WHERE surge),
lists AS (SELECT date_week, list_kind, row_number() OVER (PARTITION BY date_week, list_kind ORDER BY key DESC, rank) AS list_rank,
                 word, pos, tf, tfidf, global_tfidf, surge, surge_ratio
          FROM offers QUALIFY list_rank <= 30)"""
WEEK_EMOTIONS = f"""
week_means AS (SELECT date_week, {", ".join(f"avg({e}) AS {e}" for e in EMOTIONS)} FROM texts GROUP BY 1),
week_emotions AS (
  SELECT date_week, emotion, mean, row_number() OVER (PARTITION BY date_week ORDER BY round(mean, 12) DESC, i) AS rank
  FROM (SELECT date_week, e.emotion, e.i, CASE e.i {" ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(EMOTIONS))} END AS mean
        FROM week_means, (VALUES {", ".join(f"({i}, '{e}')" for i, e in enumerate(EMOTIONS))}) AS e(i, emotion)))"""
MIN_MEAN = 0.15
EMOTION_KEYWORDS = f"""
active AS (SELECT date_week, emotion FROM (SELECT *, max(mean) OVER (PARTITION BY date_week) AS top FROM week_emotions)
           WHERE mean >= {MIN_MEAN} OR (top < {MIN_MEAN} AND rank = 1)),
emotion_stats AS (
  SELECT emotion, word, round(CAST(avg(tfidf) AS DECIMAL(28,12)), 4)::DOUBLE AS avg_tfidf, max(tfidf) AS peak_tfidf,
         first(date_week ORDER BY tfidf DESC, date_week) AS peak_week
  FROM keywords JOIN active USING (date_week) GROUP BY emotion, word),
emotion_keywords AS (SELECT emotion, row_number() OVER (PARTITION BY emotion ORDER BY avg_tfidf DESC, word) AS rank,
                            word, avg_tfidf, peak_week, peak_tfidf FROM emotion_stats QUALIFY rank <= 30)"""


def tokens(spark, d, keep=("date_week",)):
    return keywords.tokenise(v.texts(spark, d), PATTERN, keep=keep)


def counts(spark, d):
    """Term counts, written once because vocabulary, frequencies and weights all read them."""
    return stage(keywords.week_term_counts(tokens(spark, d)))


def weights(spark, d):
    return keywords.tfidf(counts(spark, d))


def status(spark, d):
    return keywords.week_status(v.texts(spark, d), MIN_WEEK)


def week_words(spark, d):
    return keywords.week_keywords(stage(weights(spark, d)), status(spark, d))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, select="""
SELECT post_id, count(*)::BIGINT AS tokens, min(word) AS first_word, max(word) AS last_word, sum(length(word))::BIGINT AS letters
FROM tokens GROUP BY post_id"""))
def token_totals(spark, d):
    return tokens(spark, d, ("post_id",)).groupBy("post_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.min("word").alias("first_word"), F.max("word").alias("last_word"),
        F.sum(F.length("word")).alias("letters"),
    )


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, select="SELECT * FROM counts"))
def week_term_counts(spark, d):
    return keywords.week_term_counts(tokens(spark, d))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, select="""
SELECT date_week, word, pos, tf, round(tfidf, 6) AS tfidf, total_tf, n::BIGINT AS n_weeks FROM weights"""))
def tfidf(spark, d):
    return v.rounded(weights(spark, d))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, select="""
SELECT word, round(sum(tfidf) / max(n), 6) AS global_tfidf, max(total_tf) AS total_tf FROM weights GROUP BY word"""))
def global_tfidf(spark, d):
    return v.rounded(keywords.global_tfidf(weights(spark, d)))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, select="""
SELECT date_week, rank::INT AS rank, word, pos, tf, tfidf, global_tfidf, surge, surge_ratio FROM keywords"""))
def week_keywords(spark, d):
    return week_words(spark, d)


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, LISTS, select="""
SELECT date_week, list_kind, list_rank::INT AS rank, word, pos, tf, tfidf, global_tfidf, surge, surge_ratio FROM lists"""))
def keyword_lists(spark, d):
    return keywords.keyword_lists(week_words(spark, d))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, LISTS, select="""
SELECT date_week, list_kind, list_rank::INT AS rank, word,
       round(tfidf / first_value(tfidf) OVER (PARTITION BY date_week, list_kind ORDER BY list_rank), 6) AS relative
FROM lists WHERE list_rank <= 20"""))
def keyword_bars(spark, d):
    lists = keywords.keyword_lists(week_words(spark, d))
    return v.rounded(keywords.relative_bars(lists).select("date_week", "list_kind", "rank", "word", "relative"))


@query(v.with_(v.TEXTS, STATUS, select="SELECT * FROM status"))
def week_status(spark, d):
    return status(spark, d)


@query(v.with_(v.TEXTS, WEEK_EMOTIONS, select="""
SELECT date_week, emotion, round(mean, 6) AS mean, rank::INT AS rank FROM week_emotions"""))
def week_emotions(spark, d):
    return v.rounded(keywords.week_emotions(v.texts(spark, d)))


@query(v.with_(v.TEXTS, WEEK_EMOTIONS, select="""
SELECT date_week, max(emotion) FILTER (rank = 1) AS dominant_emotion,
       string_agg(emotion, ',' ORDER BY rank) FILTER (rank <= 3) AS top_emotions FROM week_emotions GROUP BY 1"""))
def week_top_emotions(spark, d):
    top = keywords.week_top_emotions(keywords.week_emotions(v.texts(spark, d)))
    return top.withColumn("top_emotions", F.array_join("top_emotions", ","))


def by_emotion(spark, d, words):
    return keywords.emotion_keywords(words, keywords.week_emotions(v.texts(spark, d)), MIN_MEAN)


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, WEEK_EMOTIONS, EMOTION_KEYWORDS, select="""
SELECT emotion, rank::INT AS rank, word, avg_tfidf, peak_week, peak_tfidf FROM emotion_keywords"""))
def emotion_keywords(spark, d):
    return by_emotion(spark, d, stage(week_words(spark, d)))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, """
week_index AS (SELECT date_week, row_number() OVER (ORDER BY date_week) - 1 AS idx FROM (SELECT DISTINCT date_week FROM weights))""",
               select="""
SELECT word, max(total_tf) AS total_tf, round(sum(tfidf) / max(n), 4) AS avg_tfidf,
       first(idx ORDER BY round(tfidf, 12) DESC, date_week)::INT AS peak_week_idx, round(max(tfidf), 4) AS peak_tfidf
FROM weights JOIN week_index USING (date_week) GROUP BY word ORDER BY avg_tfidf DESC, word LIMIT 5000"""))
def global_vocabulary(spark, d):
    return keywords.global_vocabulary(stage(weights(spark, d)))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, select="""
SELECT date_week, rank::INT AS rank, word, tf, tfidf, surge FROM keywords WHERE rank <= 50"""))
def keyword_review(spark, d):
    return keywords.keyword_review(week_words(spark, d)).select("date_week", "rank", "word", "tf", "tfidf", "surge")


@query(v.with_(v.TEXTS, RAW_TOKENS, """
raw_counts AS (SELECT word, count(*)::BIGINT AS count FROM raw_tokens GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""", select=f"""
SELECT word, count FROM raw_counts WHERE word IN {_listed(["un", "le", "the", "la", "der", "il", "we", "en", "et", "que"] + STOP_WORDS + NOISE_WORDS)}"""))
def noise_check(spark, d):
    raw = keywords.week_term_counts(keywords.tokenise(v.texts(spark, d), PATTERN, filtered=False))
    extra = spark.createDataFrame([(w,) for w in ["un", "le", "the", "la", "der", "il", "we", "en", "et", "que"]], "word string")
    return keywords.noise_check(raw, tables.stop_words(spark).union(tables.noise_words(spark)).union(extra).distinct())


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, select="""
SELECT (SELECT count(*) FROM status WHERE status = 'ok')::BIGINT AS ok_weeks,
       (SELECT count(*) FROM status WHERE status <> 'ok')::BIGINT AS insufficient_weeks,
       (SELECT count(DISTINCT date_week) FROM counts)::BIGINT AS weeks_with_text,
       (SELECT count(DISTINCT word) FROM weights)::BIGINT AS vocabulary_size"""))
def keyword_run_summary(spark, d):
    terms = counts(spark, d)
    return keywords.keyword_run_summary(terms, keywords.tfidf(terms), status(spark, d))


def _frequent(key: str, size: int, where: str) -> str:
    return f"""
SELECT {key}, word, freq, rank::INT AS rank FROM (
  SELECT {key}, word, count(*)::BIGINT AS freq, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, word) AS rank
  FROM raw_tokens WHERE {where} GROUP BY 1, 2 QUALIFY rank <= {size}) WHERE length(word) >= 2"""


TEXTS_AS_POSTS = "posts AS (SELECT * FROM texts)"


@query(v.with_(v.TEXTS, TEXTS_AS_POSTS, v.NATIONAL, RAW_TOKENS, select=_frequent("date_week", 50, """date_week IN (
  (SELECT date_week FROM national ORDER BY round(fear_mean, 12) DESC, date_week LIMIT 1)
  UNION ALL (SELECT date_week FROM national ORDER BY round(joy_mean, 12) DESC, date_week LIMIT 1))""")))
def peak_week_terms(spark, d):
    texts = v.texts(spark, d)
    return keywords.peak_week_terms(texts, panels.national_timeline(texts), 50, PATTERN)


@query(v.with_(v.TEXTS, RAW_TOKENS, select=_frequent("province", 80, """province IN (
  SELECT province FROM (SELECT province, count(*) FROM texts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6))""")))
def province_terms(spark, d):
    return keywords.province_terms(v.texts(spark, d), 6, 80, PATTERN)


EVENT_Z = 1.0
TEXT_EVENTS = v.EVENTS.replace("> 2.5", f"> {EVENT_Z}")


def text_events(spark, d):
    series = anomaly.zscore_series(panels.national_timeline(v.texts(spark, d)), min_posts=v.NATIONAL_MIN)
    return anomaly.anomaly_events(series, EVENT_Z)


@query(v.with_(v.TEXTS, TEXTS_AS_POSTS, v.NATIONAL, v.ZSERIES, TEXT_EVENTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, """
surging AS (SELECT date_week, word, row_number() OVER (PARTITION BY date_week ORDER BY rank) AS r FROM keywords WHERE surge QUALIFY r <= 3)""",
               select="""
SELECT e.date_week, e.emotion, coalesce(string_agg(s.word, ',' ORDER BY s.r), '') AS keywords
FROM events_z e LEFT JOIN surging s ON e.date_week = s.date_week GROUP BY 1, 2"""))
def event_keywords(spark, d):
    found = keywords.event_keywords(text_events(spark, d), week_words(spark, d))
    return found.select("date_week", "emotion", F.array_join("keywords", ",").alias("keywords"))


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, WEEK_EMOTIONS, EMOTION_KEYWORDS, select="""
SELECT * EXCLUDE (r), r::INT AS rank FROM (
SELECT w.date_week, k.emotion, row_number() OVER (PARTITION BY w.date_week, k.emotion ORDER BY k.rank) AS r, k.word,
       coalesce(l.tf, 0)::BIGINT AS tf, coalesce(l.tfidf, k.peak_tfidf) AS tfidf, coalesce(l.global_tfidf, 0) AS global_tfidf,
       coalesce(l.surge, false) AS surge, coalesce(l.surge_ratio, 1) AS surge_ratio, coalesce(l.pos, '') AS pos
FROM (SELECT date_week FROM status WHERE status = 'ok') w, emotion_keywords k
LEFT JOIN keywords l ON l.date_week = w.date_week AND l.word = k.word
WHERE k.peak_week = w.date_week OR l.word IS NOT NULL) WHERE r <= 30"""))
def emotion_week_keywords(spark, d):
    words = stage(week_words(spark, d))
    usable = status(spark, d).filter("status = 'ok'")
    return keywords.emotion_week_keywords(by_emotion(spark, d, words), words, usable)


@query(v.with_(v.TEXTS, RAW_TOKENS, select="""
SELECT province, count(*)::BIGINT AS posts, sum(length(content_clean))::BIGINT AS characters,
       (SELECT count(*) FROM raw_tokens t WHERE t.province = x.province)::BIGINT AS tokens
FROM texts x GROUP BY province"""))
def text_volume(spark, d):
    return keywords.text_volume(v.texts(spark, d), "province", PATTERN)


@query(v.with_(v.TEXTS, RAW_TOKENS, TOKENS, COUNTS, WEIGHTS, STATUS, KEYWORDS, LISTS, WEEK_EMOTIONS, select="""
SELECT s.date_week, s.total_posts, s.status,
       (SELECT string_agg(emotion, ',' ORDER BY rank) FROM week_emotions e WHERE e.date_week = s.date_week AND rank <= 3) AS top_emotions,
       (SELECT string_agg(word, ',' ORDER BY rank) FROM keywords k WHERE k.date_week = s.date_week) AS keywords,
       (SELECT string_agg(word, ',' ORDER BY list_rank) FROM lists l WHERE l.date_week = s.date_week AND list_kind = 'top') AS top_keywords,
       (SELECT string_agg(word, ',' ORDER BY list_rank) FROM lists l WHERE l.date_week = s.date_week AND list_kind = 'frequent') AS frequent_keywords
FROM status s"""))
def nested_week_keywords(spark, d):
    words = stage(week_words(spark, d))
    emotions = keywords.week_top_emotions(keywords.week_emotions(v.texts(spark, d)))
    nested = keywords.nested_week_keywords(status(spark, d), words, keywords.keyword_lists(words), emotions)

    def joined(column):
        return F.array_join(F.transform(column, lambda k: k.word), ",").alias(column)

    return nested.select(
        "date_week", "total_posts", "status", F.array_join("top_emotions", ",").alias("top_emotions"),
        joined("keywords"), joined("top_keywords"), joined("frequent_keywords"),
    )
