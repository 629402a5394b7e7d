"""Keywords of weeks and emotions: token counts, TF-IDF, surges and the global vocabulary.

The document of the TF-IDF is a whole week. Terms are lower-cased once, when they are tokenised,
so counts and scores always refer to the same term.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid import domain
from feltgrid.functions import text
from feltgrid.functions.metrics import stable_round
from feltgrid.operators import dashboard, segment
from feltgrid.operators.rows import beside
from feltgrid.operators.stage import stage

TEXT_COLUMNS = ["content_clean", "content_raw", "content"]
CJK_RUN = r"[一-鿿]+"
WORDS = r"[一-鿿]+|[\p{L}\p{M}\p{N}_.]+"


def text_column(df: DataFrame) -> str:
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no text column, expected one of {TEXT_COLUMNS}")


def _ngrams(run: Column, sizes: Sequence[int]) -> Column:
    """All character n-grams of a CJK run, in text order per size."""
    parts = [
        F.when(
            F.length(run) >= n,
            F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))
        for n in sizes
    ]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def tokenise(
    posts: DataFrame,
    pattern: str | None = None,
    dictionary: DataFrame | None = None,
    keep: tuple[str, ...] = ("date_week",),
    filtered: bool = True,
    stop_words: list[str] | None = None,
    best_path: bool = False,
    together: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per token, ``(*keep, word, pos)``, in lower case.

    ``together`` has aggregates over posts: equal matches of equal ``keep`` become one row with these columns before
    they are split and looked up, and each of their tokens has them. Counts are to be summed, least values compared.

    With ``pattern`` the tokens are its matches. Otherwise letters and digits form words, and runs
    of Chinese characters give character pairs (a single one stays as it is), or, with a ``(word, pos)``
    dictionary, every dictionary word they contain, however long, or with ``best_path`` only those on the
    likeliest path, which do not overlap (``segment.best_paths``; the dictionary may have a ``freq``).
    ``filtered`` applies the token rules and the stop and noise lists.
    """
    source, columns = F.lower(F.col(text_column(posts))), (*keep, "word", "pos", *(together or ()))
    matches = F.regexp_extract_all(source, F.lit(pattern or WORDS), F.lit(0))
    if together is None:
        tokens = posts.select(*keep, F.explode(matches).alias("word"))
    else:
        tokens = posts.select("*", F.explode(matches).alias("_match")).groupBy(*keep, F.col("_match").alias("word")).agg(
            *[e.alias(n) for n, e in together.items()]
        )
        keep = (*keep, *together)
        if best_path:
            tokens = stage(tokens)  # read for the runs' paths, the runs and the other words
    if pattern is None and dictionary is not None and best_path:
        is_run = F.col("word").rlike(f"^{CJK_RUN}$")
        runs = tokens.filter(is_run).withColumn("_id", F.md5("word"))
        paths = segment.best_paths(runs.select(F.col("_id").alias("id"), F.col("word").alias("run")).distinct(), dictionary)
        run = F.col("word")
        words = F.transform("words", lambda w: F.substring(run, w["at"], w["size"]))
        chosen = runs.join(paths.withColumnRenamed("id", "_id"), "_id").select(*keep, F.lit(True).alias("_run"), F.explode(words).alias("word"))
        tokens = tokens.filter(~is_run).select(*keep, F.lit(False).alias("_run"), "word").unionByName(chosen)
    elif pattern is None:
        sizes: Sequence[int] = [2]
        if dictionary is not None:
            # One row per length that occurs, however long the longest entry.
            sizes = sorted(r.n for r in dictionary.select(F.length("word").alias("n")).distinct().collect() if r.n)
        is_run = F.col("word").rlike(f"^{CJK_RUN}$")
        whole = ~is_run if dictionary is not None else ~is_run | (F.length("word") == 1)
        parts = F.when(whole, F.array("word")).otherwise(_ngrams(F.col("word"), sizes))
        tokens = tokens.select(*keep, is_run.alias("_run"), F.explode(parts).alias("word"))
    if dictionary is None:
        tokens = tokens.withColumn("pos", F.lit(""))
    else:
        entries = dictionary.groupBy("word").agg(F.min("pos").alias("pos"))
        tokens = tokens.join(entries, "word", "left")
        if pattern is None:
            tokens = tokens.filter(~F.col("_run") | F.col("pos").isNotNull())
        tokens = tokens.withColumn("pos", F.coalesce("pos", F.lit("")))
    if filtered:
        excluded = (domain.STOP_WORDS if stop_words is None else list(stop_words)) + domain.NOISE_WORDS
        tokens = tokens.filter(text.is_valid_token("word", "pos") & ~F.col("word").isin(excluded))
    return tokens.select(*columns)


def week_term_counts(tokens: DataFrame, week: str = "date_week") -> DataFrame:
    """Count of each term per week with its part of speech; tokens may have been counted ``together`` as ``tf``.

    A term has one part of speech, so it can be a grouping key. A text aggregate such as ``min``
    instead would make Spark sort every token where it now hashes them.
    """
    tf = F.sum("tf") if "tf" in tokens.columns else F.count(F.lit(1))
    return tokens.groupBy(week, "word", "pos").agg(tf.alias("tf"))


def first_pos(tokens: DataFrame, position: str, week: str = "date_week") -> DataFrame:
    """Part of speech at the first place a term occurs in its week.

    The first places of each part of speech come from a hash aggregate; only they are compared.
    """
    firsts = tokens.groupBy(week, "word", "pos").agg(F.min(position).alias(position))
    return firsts.groupBy(week, "word").agg(F.min_by("pos", position).alias("pos"))


def vocabulary(counts: DataFrame, max_terms: int = domain.MAX_TERMS, max_df: float = domain.MAX_DF,
               week: str = "date_week") -> DataFrame:
    """Terms kept for TF-IDF with their idf: document-frequency limits, then the most frequent.

    At most ``max_terms`` rows.
    """
    n_weeks = counts.agg(F.countDistinct(week).alias("n_weeks"))
    terms = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    n = F.col("n_weeks")
    min_df = F.when(n < 20, 1).otherwise(2)
    return (
        beside(terms, n_weeks)
        .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
        .orderBy(F.col("total_tf").desc(), "word")
        .limit(max_terms)
        .withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
        .select("word", "df", "total_tf", "n_weeks", "idf")
    )


def tfidf(counts: DataFrame, max_terms: int = domain.MAX_TERMS, max_df: float = domain.MAX_DF,
          week: str = "date_week") -> DataFrame:
    """L2-normalised TF-IDF per week over the kept vocabulary.

    ``counts`` is read three times, so pass it staged or from a table.

    Each week has at most ``max_terms`` terms here, so the norm's window is bounded.
    """
    terms = vocabulary(counts, max_terms, max_df, week)
    weight = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(weight * weight).over(W.partitionBy(week)))
    return counts.join(terms, "word").withColumn("tfidf", weight / norm).select(
        week, "word", "pos", "tf", "tfidf", "total_tf", "n_weeks"
    )


def global_tfidf(weights: DataFrame) -> DataFrame:
    """Mean TF-IDF of a term over all weeks, absent weeks counting as 0."""
    return weights.groupBy("word").agg(
        (F.sum("tfidf") / F.max("n_weeks")).alias("global_tfidf"), F.max("total_tf").alias("total_tf")
    )


def week_status(posts: DataFrame, min_posts: int = domain.MIN_POSTS_PER_KEYWORD_WEEK,
                week: str = "date_week") -> DataFrame:
    """Posts per week and whether they suffice for keywords."""
    return posts.groupBy(week).agg(F.count(F.lit(1)).alias("total_posts")).withColumn(
        "status", F.when(F.col("total_posts") < min_posts, "insufficient_data").otherwise("ok")
    )


def week_keywords(
    weights: DataFrame,
    status: DataFrame,
    top: int = domain.KEYWORDS_PER_WEEK,
    surge_ratio: float = domain.SURGE_RATIO,
    week: str = "date_week",
) -> DataFrame:
    """The ``top`` terms of each week with enough posts, ranked by TF-IDF, and their surge."""
    overall = global_tfidf(weights).select("word", "global_tfidf")
    ratio = F.col("tfidf") / F.greatest(F.col("global_tfidf"), F.lit(1e-6))
    order = W.partitionBy(week).orderBy(F.round("tfidf", 10).desc(), "word")
    ok = status.filter("status = 'ok'").select(week)
    ranked = (
        weights.filter("tfidf > 0")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .join(ok, week, "left_semi")
    )
    return ranked.join(overall, "word").select(
        week,
        "rank",
        "word",
        "pos",
        "tf",
        F.round("tfidf", 4).alias("tfidf"),
        F.round("global_tfidf", 4).alias("global_tfidf"),
        (F.round(ratio, 9) >= surge_ratio).alias("surge"),
        F.round(ratio, 2).alias("surge_ratio"),
    )


def keyword_lists(keywords: DataFrame, size: int = domain.KEYWORDS_PER_LIST, week: str = "date_week") -> DataFrame:
    """Top, frequent and surge lists of each week in long form.

    Each keyword row is offered to the lists it may enter; one window then ranks all lists.
    """
    entry = F.array_compact(F.array(
        F.struct(F.lit("top").alias("list_kind"), F.col("tfidf").alias("_key")),
        F.struct(F.lit("frequent").alias("list_kind"), F.col("tf").cast("double").alias("_key")),
        F.when(F.col("surge"), F.struct(F.lit("surge").alias("list_kind"), F.col("surge_ratio").alias("_key"))),
    ))
    columns = [c for c in keywords.columns if c != "rank"]
    long = keywords.withColumnRenamed("rank", "_week_rank").select(
        *columns, "_week_rank", F.inline(entry)
    )
    order = W.partitionBy(week, "list_kind").orderBy(F.col("_key").desc(), "_week_rank")
    return (
        long.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= size)
        .drop("_key", "_week_rank")
    )


def relative_bars(lists: DataFrame, size: int = 20, week: str = "date_week") -> DataFrame:
    """First ``size`` rows of each list with their TF-IDF relative to the list's first row."""
    first = F.first("tfidf").over(W.partitionBy(week, "list_kind").orderBy("rank"))
    return lists.filter(F.col("rank") <= size).withColumn(
        "relative", F.col("tfidf") / F.when(first == 0, 1.0).otherwise(first)
    )


def week_emotions(posts: DataFrame, week: str = "date_week") -> DataFrame:
    """Mean of each emotion per week with its rank (emotion order on ties)."""
    means = posts.groupBy(week).agg(*[F.avg(e).alias(e) for e in domain.EMOTIONS])
    order = F.array_position(F.array(*map(F.lit, domain.EMOTIONS)), F.col("emotion"))
    rank = F.row_number().over(W.partitionBy(week).orderBy(F.round("mean", 12).desc(), order))
    return means.unpivot([week], domain.EMOTIONS, "emotion", "mean").withColumn("rank", rank)


def week_top_emotions(emotions: DataFrame, week: str = "date_week") -> DataFrame:
    """Dominant emotion and the three strongest, as an ordered array."""
    top = F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "emotion")))
    return emotions.groupBy(week).agg(
        F.max(F.when(F.col("rank") == 1, F.col("emotion"))).alias("dominant_emotion"),
        F.transform(F.array_sort(top), lambda s: s.emotion).alias("top_emotions"),
    )


def emotion_keywords(
    keywords: DataFrame,
    emotions: DataFrame,
    min_mean: float = domain.EMOTION_ATTRIBUTION_MEAN,
    top: int = domain.KEYWORDS_PER_LIST,
    week: str = "date_week",
) -> DataFrame:
    """Terms of each emotion: a week's keywords go to all its active emotions.

    Active are the emotions with a mean of at least ``min_mean``, or only the dominant one when
    none reaches it. Averages use the rounded weekly values; the peak is the earliest maximum.
    """
    any_active = F.max(F.col("mean") >= min_mean).over(W.partitionBy(week))
    active = (
        emotions.withColumn("_any", any_active)
        .filter((F.col("mean") >= min_mean) | (~F.col("_any") & (F.col("rank") == 1)))
        .select(week, "emotion")
    )
    stats = (
        keywords.select(week, "word", "tfidf")
        .join(active, week)
        .groupBy("emotion", "word")
        .agg(
            stable_round(F.avg("tfidf"), 4).alias("avg_tfidf"),
            F.max("tfidf").alias("peak_tfidf"),
            F.min_by(week, F.struct(-F.col("tfidf"), F.col(week))).alias("peak_week"),
        )
    )
    rank = F.row_number().over(W.partitionBy("emotion").orderBy(F.col("avg_tfidf").desc(), "word"))
    return stats.withColumn("rank", rank).filter(F.col("rank") <= top).select(
        "emotion", "rank", "word", "avg_tfidf", "peak_week", "peak_tfidf"
    )


def global_vocabulary(weights: DataFrame, size: int = 5000, week: str = "date_week") -> DataFrame:
    """Terms by mean TF-IDF with their total count and the position of their peak week."""
    weeks = weights.select(week).distinct()
    # One row per week reaches this window.
    index = weeks.withColumn("_idx", F.row_number().over(W.orderBy(week)) - 1)
    stats = weights.groupBy("word").agg(
        F.max("total_tf").alias("total_tf"),
        F.round(F.sum("tfidf") / F.max("n_weeks"), 4).alias("avg_tfidf"),
        F.round(F.max("tfidf"), 4).alias("peak_tfidf"),
        F.min_by(week, F.struct(-F.round("tfidf", 12), F.col(week))).alias(week),
    )
    return (
        stats.join(index, week)
        .select("word", "total_tf", "avg_tfidf", F.col("_idx").alias("peak_week_idx"), "peak_tfidf")
        .orderBy(F.col("avg_tfidf").desc(), "word")
        .limit(size)
    )


def keyword_review(keywords: DataFrame, size: int = 50) -> DataFrame:
    return keywords.filter(F.col("rank") <= size)


def noise_check(counts: DataFrame, words: DataFrame, size: int = 20) -> DataFrame:
    """Stop and noise words among the most frequent terms."""
    frequent = (
        counts.groupBy("word").agg(F.sum("tf").alias("count"))
        .orderBy(F.col("count").desc(), "word").limit(size)
    )
    # The right side of a semi join of at most ``size`` rows.
    return frequent.join(words.select("word"), "word", "left_semi")


def keyword_run_summary(counts: DataFrame, weights: DataFrame, status: DataFrame) -> DataFrame:
    """One row: weeks with text, usable and too small weeks, vocabulary size."""
    row = status.agg(
        F.count(F.when(F.col("status") == "ok", 1)).alias("ok_weeks"),
        F.count(F.when(F.col("status") != "ok", 1)).alias("insufficient_weeks"),
    )
    return beside(
        row,
        counts.agg(F.countDistinct("date_week").alias("weeks_with_text")),
        weights.agg(F.countDistinct("word").alias("vocabulary_size")),
    )


def term_frequencies(tokens: DataFrame, key: str, size: int = 50) -> DataFrame:
    """The ``size`` most frequent raw tokens of each key, then only those of two or more characters."""
    counts = tokens.groupBy(key, "word").agg(F.count(F.lit(1)).alias("freq"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col("freq").desc(), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size).filter(F.length("word") >= 2)


def peak_week_terms(posts: DataFrame, national: DataFrame, size: int = 50, pattern: str | None = None) -> DataFrame:
    """Most frequent raw terms of the weeks with the highest fear and joy."""
    weeks = dashboard.peak_weeks(national).select("date_week").distinct()
    # Two weeks at most; only their posts are tokenised.
    chosen = posts.join(F.broadcast(weeks), "date_week", "left_semi")
    return term_frequencies(tokenise(chosen, pattern, filtered=False), "date_week", size)


def province_terms(posts: DataFrame, top: int = 6, size: int = 80, pattern: str | None = None) -> DataFrame:
    """Most frequent raw terms of the provinces with the most posts."""
    largest = dashboard.largest_provinces(posts, top).select("province")
    chosen = posts.join(F.broadcast(largest), "province", "left_semi")
    return term_frequencies(tokenise(chosen, pattern, keep=("province",), filtered=False), "province", size)


def text_volume(posts: DataFrame, key: str, pattern: str | None = None) -> DataFrame:
    """Posts, characters and raw tokens of all texts of each key.

    The texts of a key are never put together into one value: a key may hold a third of all texts,
    and its tokens can be counted where they are.
    """
    sizes = posts.groupBy(key).agg(
        F.count(F.lit(1)).alias("posts"), F.sum(F.length(text_column(posts))).alias("characters")
    )
    tokens = tokenise(posts, pattern, keep=(key,), filtered=False).groupBy(key).agg(
        F.count(F.lit(1)).alias("tokens")
    )
    return sizes.join(tokens, key, "left").na.fill(0, ["characters", "tokens"])


def nested_week_keywords(status: DataFrame, keywords: DataFrame, lists: DataFrame, top_emotions: DataFrame,
                         week: str = "date_week") -> DataFrame:
    """One row per week for export: status, emotions and the keyword arrays of a usable week."""
    fields = ["rank", "word", "tf", "tfidf", "global_tfidf", "surge", "surge_ratio", "pos"]
    entry = F.struct(*fields)

    def in_order(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, entry)))

    # At most 80 and 3 x 30 entries per week.
    full = keywords.groupBy(week).agg(in_order(F.lit(True)).alias("keywords"))
    kinds = ["top", "frequent", "surge"]
    by_kind = lists.groupBy(week).agg(
        *[in_order(F.col("list_kind") == k).alias(f"{k}_keywords") for k in kinds]
    )
    return (
        status.join(top_emotions, week, "left").join(full, week, "left").join(by_kind, week, "left")
    )


def event_keywords(events: DataFrame, keywords: DataFrame, size: int = 3, week: str = "date_week") -> DataFrame:
    """Events with up to ``size`` surging terms of their week."""
    surging = keywords.filter("surge")
    rank = F.row_number().over(W.partitionBy(week).orderBy("rank"))
    lists = (
        surging.withColumn("_row", rank).filter(F.col("_row") <= size)
        .groupBy(week)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_row", "word"))), lambda s: s.word).alias("keywords"))
    )
    return events.join(lists, week, "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>"))
    )


def emotion_week_keywords(
    by_emotion: DataFrame, keywords: DataFrame, weeks: DataFrame, size: int = 30, week: str = "date_week"
) -> DataFrame:
    """Per week and emotion: the emotion's terms that peak in the week or occur in its list.

    Terms without a row in the week's list get count 0, their peak value and ratio 1.
    """
    terms = by_emotion.select("emotion", F.col("rank").alias("_rank"), "word", "peak_week", "peak_tfidf")
    listed = keywords.select(week, "word", "tf", "tfidf", "global_tfidf", "surge", "surge_ratio", "pos")
    present = terms.drop("peak_week", "peak_tfidf").join(listed, "word")
    # Terms whose peak week does not list them; a join on the week instead of a disjunction.
    peaks = (
        terms.withColumnRenamed("peak_week", week)
        .join(weeks.select(week), week, "left_semi")
        .join(listed.select(week, "word"), [week, "word"], "left_anti")
        .select("emotion", "_rank", "word", week, F.lit(0).cast("bigint").alias("tf"),
                F.col("peak_tfidf").alias("tfidf"), F.lit(0.0).alias("global_tfidf"),
                F.lit(False).alias("surge"), F.lit(1.0).alias("surge_ratio"), F.lit("").alias("pos"))
    )
    both = present.unionByName(peaks)
    rank = F.row_number().over(W.partitionBy(week, "emotion").orderBy("_rank"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= size).drop("_rank")
