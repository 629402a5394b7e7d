"""Scoring jobs over the documents."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.domain import EMOTIONS
from feltgrid.functions import metrics
from feltgrid.operators import scoring, validate

# One letter per emotion: small word lists that occur in texts of every language.
LEXICON = {"joy": ["a"], "sadness": ["e"], "anger": ["i"], "fear": ["o"], "surprise": ["u"], "neutral": ["n"]}


def _letters(word: str) -> str:
    return f"(length(lower(content_clean)) - length(replace(lower(content_clean), '{word}', '')))"


SCORED = f"""
hits AS (SELECT doc_id AS post_id, text AS content_clean FROM documents),
hit_counts AS (SELECT post_id, content_clean, {", ".join(f"{_letters(LEXICON[e][0])} + {1 if e == 'neutral' else 0} AS h{i}" for i, e in enumerate(EMOTIONS, 1))} FROM hits),
scored AS (SELECT post_id, content_clean, {", ".join(f"CAST(h{i} AS DOUBLE)/(h1+h2+h3+h4+h5+h6) AS {e}" for i, e in enumerate(EMOTIONS, 1))} FROM hit_counts)"""


def docs(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("content_clean"))


def make_letter_scorer():
    """Scorer with the lexicon's rule, called with batches of texts."""

    def score(texts):
        out = []
        for text in texts:
            low = text.lower()
            hits = {e: low.count(words[0]) + (1 if e == "neutral" else 0) for e, words in LEXICON.items()}
            total = sum(hits.values())
            out.append({e: h / total for e, h in hits.items()})
        return out

    return score


def make_failing_scorer():
    """As above, but texts with an odd number of characters get an invalid score."""
    good = make_letter_scorer()

    def score(texts):
        return [{**s, "joy": 1.5} if len(t) % 2 else s for t, s in zip(texts, good(texts))]

    return score


ROUNDED = v.round_cols(*EMOTIONS)


@query(v.with_(SCORED, select=f"SELECT post_id, {ROUNDED}, 'ok' AS label_status FROM scored"))
def lexicon_scores(spark, d):
    scored = scoring.score_with_lexicon(docs(spark, d), LEXICON)
    return v.rounded(scored.select("post_id", *EMOTIONS, "label_status"))


@query(v.with_(SCORED, select=f"""
SELECT post_id, {ROUNDED}, 'ok' AS label_status, 'letters' AS label_model, 'v1' AS prompt_version FROM scored"""))
def score_posts(spark, d):
    scored = scoring.score_posts(docs(spark, d), make_letter_scorer, model="letters")
    return v.rounded(scored.drop("content_clean", "score_errors"))


@query(v.with_(SCORED, select=f"""
SELECT post_id, round(CASE WHEN post_id % 2 = 0 THEN 0 ELSE joy END, 6) AS joy,
       CASE WHEN post_id % 2 = 0 THEN 'ok' ELSE 'ok' END AS label_status,
       CASE WHEN post_id % 2 = 0 THEN 'earlier' ELSE 'letters' END AS label_model FROM scored"""))
def resume_scoring(spark, d):
    posts = docs(spark, d)
    done = posts.filter("post_id % 2 = 0").withColumns({e: F.lit(0.0) for e in EMOTIONS}).withColumns(
        {"label_status": F.lit("ok"), "label_model": F.lit("earlier"), "prompt_version": F.lit("v1")}
    )
    full = scoring.resume_scoring(
        posts, done, lambda rows: scoring.score_posts(rows, make_letter_scorer, model="letters")
    )
    return v.rounded(full.select("post_id", "joy", "label_status", "label_model"))


def failing(spark, d):
    # Batches of one, so that a batch fails exactly when its text does.
    return scoring.score_posts(docs(spark, d), make_failing_scorer, batch_size=1, tries=2)


@query("""
SELECT doc_id AS post_id, left(text, 200) AS content FROM documents WHERE length(text) % 2 = 1""")
def failed_rows(spark, d):
    return scoring.failed_rows(failing(spark, d))


@query("""
SELECT 'score_out_of_range:joy=1.5' AS error, (2 * count(*))::BIGINT AS count FROM documents WHERE length(text) % 2 = 1
HAVING count(*) > 0""")
def scoring_log(spark, d):
    return scoring.scoring_log(failing(spark, d))


def make_counting_scorer():
    """As the failing one, telling the tokens of each try."""
    inner = make_failing_scorer()

    def score(texts):
        return scoring.Reply(inner(texts), sum(len(t) // 4 + 20 for t in texts), 40 * len(texts))

    return score


@query("""
WITH t AS (SELECT CASE WHEN length(text) % 2 = 1 THEN 2 ELSE 1 END AS tries, length(text) // 4 + 20 AS prompt, length(text) % 2 AS odd FROM documents)
SELECT count(*)::BIGINT AS batches, count(*) FILTER (odd = 1)::BIGINT AS failed_batches, sum(tries)::BIGINT AS tries, sum(tries * prompt)::BIGINT AS prompt_tokens,
       sum(tries * 40)::BIGINT AS completion_tokens, sum(tries * (prompt + 40))::BIGINT AS total_tokens FROM t""")
def scoring_usage(spark, d):
    """Batches of one: a text that fails is sent twice, and both tries are paid for."""
    return scoring.scoring_usage(scoring.score_posts(docs(spark, d), make_counting_scorer, batch_size=1, tries=2, accounting=True))


@query("""
SELECT count(*)::BIGINT AS total_rows, count(*) FILTER (length(text) % 2 = 0)::BIGINT AS total_labeled,
       count(*) FILTER (length(text) % 2 = 1)::BIGINT AS total_failed, ceil(count(*) / 30.0)::BIGINT AS total_batches FROM documents""")
def scoring_totals(spark, d):
    return scoring.scoring_totals(failing(spark, d))


@query("""
WITH p AS (SELECT count(*)::BIGINT AS n FROM documents)
SELECT n AS new_samples, ceil(n / 30.0)::BIGINT AS total_batches, n * 600 AS prompt_tokens_est, n * 100 AS completion_tokens_est,
       round(n * 600 / 1000000.0 * 0.5, 2)::DOUBLE AS input_cost, round(n * 100 / 1000000.0 * 2.0, 2)::DOUBLE AS output_cost,
       round(n * 600 / 1000000.0 * 0.5 + n * 100 / 1000000.0 * 2.0, 2)::DOUBLE AS total_cost_est,
       round(ceil(n / 30.0) * 15 / 3600.0, 1)::DOUBLE AS time_est_hours FROM p""")
def cost_estimate(spark, d):
    return scoring.cost_estimate(v.table(spark, d, "documents"))


@query("""
WITH s AS (SELECT ceil(n_chars / 4.0) + 20 AS prompt, 40 AS completion FROM documents ORDER BY doc_id LIMIT 60),
m AS (SELECT avg(prompt) AS p, avg(completion) AS c FROM s), t AS (SELECT count(*)::BIGINT AS n FROM documents)
SELECT round(p, 1) AS avg_prompt_per_item, round(c, 1) AS avg_completion_per_item, floor(p * n)::BIGINT AS est_total_prompt,
       floor(c * n)::BIGINT AS est_total_completion, n AS total_items FROM m, t""")
def usage_estimate(spark, d):
    # The trial run of the estimate: sixty posts, with tokens guessed from the text length.
    table = v.table(spark, d, "documents")
    trial = table.orderBy("doc_id").limit(60).select(
        (F.ceil(F.col("n_chars") / 4) + 20).alias("prompt_tokens"), F.lit(40).alias("completion_tokens")
    )
    return scoring.usage_estimate(trial, table)


POSITIVE, NEGATIVE = ["a", "u"], ["e", "i"]


@query(v.with_(SCORED, select=f"""
SELECT post_id, round((joy + 0.5 * surprise) / (1 - neutral + 0.01), 6) AS positive_idx,
       round(coalesce(({_letters("a")} + {_letters("u")})::DOUBLE /
                      nullif({_letters("a")} + {_letters("u")} + {_letters("e")} + {_letters("i")}, 0), 0.5), 6) AS second_score
FROM scored ORDER BY post_id LIMIT 500"""))
def scorer_compare(spark, d):
    scored = scoring.score_with_lexicon(docs(spark, d), LEXICON)
    second = scoring.positive_sentiment("content_clean", POSITIVE, NEGATIVE)
    return v.rounded(validate.comparison_sample(scored, second).select("post_id", "positive_idx", "second_score"))


@query(v.with_(SCORED, select="""
SELECT count(*)::BIGINT AS rows, '' AS issues, true AS passed FROM scored UNION ALL
SELECT count(*)::BIGINT, 'outside_joy=' || count(*) FILTER (post_id % 3 = 0) || '; outside_fear=' || count(*) FILTER (post_id % 5 = 0), false FROM scored"""))
def score_gate(spark, d):
    """A run that passes, and one with scores out of range."""
    scored = scoring.score_with_lexicon(docs(spark, d), LEXICON)
    bad = scored.withColumns({
        "joy": F.when(F.col("post_id") % 3 == 0, 1.5).otherwise(F.col("joy")), "fear": F.when(F.col("post_id") % 5 == 0, -0.5).otherwise(F.col("fear")),
    })
    return scoring.score_gate(scored).unionByName(scoring.score_gate(bad))


@query(v.with_(SCORED, select="""
SELECT post_id, round((joy + 0.5 * surprise) / (1 - neutral + 0.01), 6) AS positive_share,
       round(joy + surprise * 0.5 - sadness - anger - fear, 6) AS positive_score FROM scored"""))
def post_measures(spark, d):
    scored = scoring.score_with_lexicon(docs(spark, d), LEXICON)
    return v.rounded(scored.select(
        "post_id",
        metrics.positive_share("joy", "surprise", "neutral").alias("positive_share"),
        metrics.positive_score("joy", "sadness", "anger", "fear", "surprise").alias("positive_score"),
    ))
