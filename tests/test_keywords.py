import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feltgrid.operators import keywords, segment


def posts(spark, rows):
    return spark.createDataFrame(rows, "date_week string, content_clean string")


def test_tokenise_words_and_pairs(spark):
    df = posts(spark, [("w1", "我爱北京 Hello ok 12.5 武汉加油!")])
    words = [r.word for r in keywords.tokenise(df).collect()]
    assert sorted(words) == sorted(["我爱", "爱北", "北京", "hello", "武汉", "汉加", "加油"])
    raw = [r.word for r in keywords.tokenise(df, filtered=False).collect()]
    assert "ok" in raw and "12.5" in raw


def test_tokenise_with_dictionary(spark):
    dictionary = spark.createDataFrame([("北京", "ns"), ("武汉加油", "l"), ("我", "r"), ("加油", "uj")], "word string, pos string")
    out = keywords.tokenise(posts(spark, [("w1", "我爱北京武汉加油 hello")]), dictionary=dictionary).collect()
    assert {(r.word, r.pos) for r in out} == {("北京", "ns"), ("武汉加油", "l"), ("hello", "")}


def test_tokenise_along_the_best_path(spark):
    entries = [("北京", "ns", 50), ("京大", "x", 1), ("大学", "n", 40), ("北京大学", "nt", 20), ("学生", "n", 60), ("生", "n", 5)]
    dictionary = spark.createDataFrame(entries, "word string, pos string, freq long")
    rows = [("w1", "北京大学生 hello"), ("w1", "北京大学"), ("w2", "京大呀大学学生"), ("w2", ""), ("w3", None), ("w3", "呀呀"), ("w3", "北京大学")]
    out = keywords.tokenise(posts(spark, rows), dictionary=dictionary, filtered=False, best_path=True).collect()
    assert Counter((r.date_week, r.word, r.pos) for r in out) == Counter([
        ("w1", "北京大学", "nt"), ("w1", "生", "n"), ("w1", "hello", ""), ("w1", "北京大学", "nt"),
        ("w2", "京大", "x"), ("w2", "大学", "n"), ("w2", "学生", "n"), ("w3", "北京大学", "nt"),
    ])


def test_best_paths_match_python(spark):
    rng = random.Random(3)
    letters = "甲乙丙丁"
    entries = {"".join(rng.choices(letters, k=rng.choice([1, 2, 2, 3, 5]))): rng.choice([1, 3, 20, 400]) for _ in range(25)}
    runs = list({"".join(rng.choices(letters + "戊", k=rng.randrange(1, 40))) for _ in range(60)}) + ["甲乙" * 300]
    total = sum(entries.values())
    cost = {w: math.floor(1000 * math.log(total / n) + 0.5) for w, n in entries.items()}
    unknown = math.floor(1000 * math.log(total) + 0.5)

    def path(run):
        best, first = {len(run): 0}, {}
        for i in range(len(run) - 1, -1, -1):
            ways = [(cost[run[i:j]] + best[j], i - j, j) for j in range(i + 1, len(run) + 1) if run[i:j] in cost]
            best[i], _, j = min([*ways, (unknown + best[i + 1], 0, i + 1)])
            first[i] = (j, run[i:j] in cost and (best[i], i - j, j) in ways)
        i, out = 0, []
        while i < len(run):
            j, known = first[i]
            if known:
                out.append((i + 1, j - i))
            i = j
        return out

    dictionary = spark.createDataFrame([(w, "n", n) for w, n in entries.items()], "word string, pos string, freq long")
    found = segment.best_paths(spark.createDataFrame([(r, r) for r in runs], "id string, run string"), dictionary).collect()
    assert {r.id: [(w["at"], w["size"]) for w in r.words] for r in found} == {r: path(r) for r in runs if path(r)}


def test_best_paths_of_an_empty_dictionary(spark):
    none = spark.createDataFrame([], "word string, pos string")
    assert segment.best_paths(spark.createDataFrame([("a", "甲乙")], "id string, run string"), none).count() == 0


def test_stop_and_noise_words_are_dropped(spark):
    out = keywords.tokenise(posts(spark, [("w1", "微博 超话 视频 天空")])).collect()
    assert [r.word for r in out] == ["天空"]


def by_hand(counts):
    """TF-IDF of ``{week: Counter}`` in plain Python."""
    n = len(counts)
    df = Counter(w for c in counts.values() for w in c)
    min_df = 1 if n < 20 else 2
    kept = {w for w, d in df.items() if min_df <= d <= 0.85 * n}
    out = {}
    for week, c in counts.items():
        raw = {w: tf * (math.log((1 + n) / (1 + df[w])) + 1) for w, tf in c.items() if w in kept}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.update({(week, w): x / norm for w, x in raw.items()})
    return out


@pytest.mark.parametrize("weeks", [5, 24])
def test_tfidf_matches_python(spark, weeks):
    docs = {f"w{i:02d}": Counter({"every": 3, f"only{i}": 1, f"some{i % 3}": i + 1, f"pair{i // 2}": 2}) for i in range(weeks)}
    counts = spark.createDataFrame([(w, t, n, "") for w, c in docs.items() for t, n in c.items()], "date_week string, word string, tf bigint, pos string")
    got = {(r.date_week, r.word): r.tfidf for r in keywords.tfidf(counts).collect()}
    expected = by_hand(docs)
    assert set(got) == set(expected)
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    norms = Counter()
    for (week, _), x in got.items():
        norms[week] += x * x
    assert all(v == pytest.approx(1.0) for v in norms.values())
    assert not any(w == "every" for _, w in got)
    assert any(w.startswith("only") for _, w in got) == (weeks < 20)


def test_vocabulary_cut_keeps_most_frequent(spark):
    counts = spark.createDataFrame([("w1", "aa", 5, ""), ("w2", "bb", 3, ""), ("w3", "cc", 3, ""), ("w2", "dd", 1, "")], "date_week string, word string, tf bigint, pos string")
    assert {r.word for r in keywords.vocabulary(counts, 2).collect()} == {"aa", "bb"}


def test_surge_lists_and_status(spark):
    weights = spark.createDataFrame(
        [("w1", "up", "", 1, 0.9, 1, 4), ("w1", "flat", "", 9, 0.4, 20, 4), ("w2", "flat", "", 9, 0.4, 20, 4), ("w3", "flat", "", 2, 0.5, 20, 4)],
        "date_week string, word string, pos string, tf bigint, tfidf double, total_tf bigint, n_weeks bigint")
    status = spark.createDataFrame([("w1", "ok"), ("w2", "insufficient_data"), ("w3", "ok")], "date_week string, status string")
    words = keywords.week_keywords(weights, status)
    rows = {(r.date_week, r.word): r for r in words.collect()}
    assert set(rows) == {("w1", "up"), ("w1", "flat"), ("w3", "flat")}
    assert rows["w1", "up"].surge and rows["w1", "up"].surge_ratio == 4.0 and not rows["w1", "flat"].surge
    lists = keywords.keyword_lists(words).collect()
    assert [(r["rank"], r.word) for r in lists if r.list_kind == "frequent" and r.date_week == "w1"] == [(1, "flat"), (2, "up")] or sorted(
        (r["rank"], r.word) for r in lists if r.list_kind == "frequent" and r.date_week == "w1") == [(1, "flat"), (2, "up")]
    assert {r.word for r in lists if r.list_kind == "surge"} == {"up"}


def test_emotion_keywords_fall_back_to_dominant(spark):
    words = spark.createDataFrame([("w1", "aa", 0.5), ("w2", "aa", 0.5), ("w2", "bb", 0.2)], "date_week string, word string, tfidf double")
    emotions = spark.createDataFrame(
        [("w1", "joy", 0.04, 1), ("w1", "fear", 0.01, 2), ("w2", "joy", 0.5, 1), ("w2", "fear", 0.06, 2)],
        "date_week string, emotion string, mean double, rank int")
    out = {(r.emotion, r.word): r for r in keywords.emotion_keywords(words, emotions).collect()}
    assert set(out) == {("joy", "aa"), ("joy", "bb"), ("fear", "aa"), ("fear", "bb")}
    assert out["joy", "aa"].peak_week == "w1" and out["fear", "aa"].peak_week == "w2" and out["joy", "aa"].avg_tfidf == 0.5


def test_first_pos_and_text_volume(spark):
    tokens = spark.createDataFrame([("w1", "aa", "v", 2), ("w1", "aa", "n", 1)], "date_week string, word string, pos string, at int")
    assert keywords.first_pos(tokens, "at").first().pos == "n"
    df = spark.createDataFrame([("w1", "天空 x"), ("w1", "yes"), ("w2", None)], "date_week string, content_clean string")
    assert {tuple(r) for r in keywords.text_volume(df, "date_week").collect()} == {("w1", 2, 7, 3), ("w2", 1, 0, 0)}


def test_hot_week_is_combined_before_the_shuffle(spark):
    tokens = keywords.tokenise(posts(spark, [("w1", "天空 " * 5000)] * 20).repartition(4))
    counts = keywords.week_term_counts(tokens)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_count" in plan
    assert {r.word: r.tf for r in counts.collect()} == {"天空": 100000}


def test_term_frequencies_cut_before_length_rule(spark):
    tokens = spark.createDataFrame([("w1", "x")] * 5 + [("w1", "yy")] * 3 + [("w1", "zz")], "date_week string, word string")
    out = keywords.term_frequencies(tokens, "date_week", 2).collect()
    assert [(r.word, r.freq, r["rank"]) for r in out] == [("yy", 3, 2)]


def test_text_column(spark):
    df = spark.createDataFrame([("a", "b")], "content string, content_raw string")
    assert keywords.text_column(df) == "content_raw"
    with pytest.raises(ValueError):
        keywords.text_column(df.select(F.lit(1)))


@pytest.mark.parametrize("best_path", [False, True])
def test_equal_matches_may_be_counted_together(spark, best_path):
    dictionary = spark.createDataFrame([("北京", "ns"), ("京北", "x"), ("加油", "uj"), ("油", "n")], "word string, pos string")
    rows = [("w1", "北京北京 hello 加油", 3), ("w1", "北京北京 北京北京", 2), ("w2", "加油 hello", None), ("w2", None, 9), (None, "北京", 1)]
    df = spark.createDataFrame(rows, "date_week string, content_clean string, at int")

    def rows_of(found):
        return Counter(tuple(r) for r in found.collect())

    def tokens(**more):
        return keywords.tokenise(df, dictionary=dictionary, filtered=False, best_path=best_path, **more)

    counted = tokens(together={"tf": F.count(F.lit(1))})
    assert counted.columns == ["date_week", "word", "pos", "tf"] and counted.count() < tokens().count()
    assert rows_of(keywords.week_term_counts(counted)) == rows_of(keywords.week_term_counts(tokens()))
    first, plain = (keywords.first_pos(t, "at") for t in (tokens(together={"at": F.min("at")}), tokens(keep=("date_week", "at"))))
    assert rows_of(first) == rows_of(plain)


def test_first_pos_compares_only_first_places(spark):
    """Tokens are hashed, not sorted, and one row per part of speech is left to compare."""
    rows = [("w1", "aa", "v", 2), ("w1", "aa", "n", 1), ("w1", "bb", None, 1), ("w1", "bb", "v", 4), ("w2", "aa", "v", None), ("w2", "cc", "n", None), ("w2", "cc", "v", 7)]
    out = keywords.first_pos(spark.createDataFrame(rows, "date_week string, word string, pos string, at int"), "at")
    assert {tuple(r) for r in out.collect()} == {("w1", "aa", "n"), ("w1", "bb", None), ("w2", "aa", None), ("w2", "cc", "v")}
    assert "HashAggregate" in out._jdf.queryExecution().executedPlan().toString()
