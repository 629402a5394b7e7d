"""Words of Chinese text that do not overlap: the likeliest path of a run through the dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid.operators.rows import beside

COST = 1_000  # cost of a word: so many times the natural logarithm of its rarity, in whole numbers


def word_costs(dictionary: DataFrame) -> DataFrame:
    """(word, pos, cost, unknown, longest) of a ``(word, pos)`` dictionary with, if known, each word's ``freq``.

    ``unknown`` is the cost of a character that no chosen word covers, that of a word of frequency 1;
    ``longest`` is the length of the longest entry. Words listed twice keep the smaller part of speech and the
    larger frequency; empty and null words are left out.
    """
    freq = F.col("freq") if "freq" in dictionary.columns else F.lit(1)
    entries = dictionary.filter(F.length("word") > 0).groupBy("word").agg(
        F.min("pos").alias("pos"), F.greatest(F.max(freq), F.lit(1)).cast("long").alias("freq")
    )
    totals = entries.agg(F.sum("freq").alias("total"), F.max(F.length("word")).alias("longest"))

    def cost(n: Column) -> Column:
        return F.round(COST * F.ln(F.col("total") / n)).cast("long")

    return beside(entries, totals).select(
        "word", F.coalesce("pos", F.lit("")).alias("pos"), cost(F.col("freq")).alias("cost"), cost(F.lit(1)).alias("unknown"), "longest"
    )


def spans(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """(id, at, words, end): the dictionary words that start at each place of each run ``(id, run)``.

    Places meet the dictionary by their next two characters, so a run gives two rows for each character,
    however many lengths the dictionary has; each carries as many characters as the longest entry.
    """
    longest = costs.agg(F.coalesce(F.max("longest"), F.lit(1)).alias("longest"))
    places = F.transform(
        F.sequence(F.lit(1), F.length("run")), lambda i: F.struct(i.alias("at"), F.substring(F.col("run"), i, F.col("longest")).alias("piece"))
    )
    at = beside(runs, longest).select("id", F.explode(places).alias("p")).select("id", "p.*")
    keys = F.array_distinct(F.array(F.substring("piece", 1, 2), F.substring("piece", 1, 1)))
    entries = costs.withColumn("key", F.substring("word", 1, 2))
    found = at.withColumn("key", F.explode(keys)).join(entries, "key").filter(F.col("piece").startswith(F.col("word")))
    size = F.length("word")
    return found.groupBy("id", "at").agg(
        F.collect_list(F.struct(size.alias("size"), "cost", "pos", "unknown")).alias("words"), F.max(F.col("at") + size).alias("end")
    )


def _cheapest(island_spans: Column, last: Column, unknown: Column) -> Column:
    """From each place of an island on, the first step (size, pos) of the cheapest way to its end; pos null for no word.

    The fold goes from the last place back to the first; ties go to the longer word.
    """
    step = "array<struct<size:int,pos:string>>"

    def gap(state: Column, span: Column) -> Column:
        """The places between this span and the one before it start no word."""
        n = state["front"] - span["at"] - 1
        costs = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: state["best"][0] + k * unknown)
        alone = F.array_repeat(F.struct(F.lit(1).alias("size"), F.lit(None).cast("string").alias("pos")), n)
        return F.when(n > 0, F.struct(F.concat(costs, state["best"]).alias("best"), F.concat(alone, state["path"]).alias("path"))).otherwise(
            F.struct(state["best"].alias("best"), state["path"].alias("path")))

    def choose(before: Column, span: Column) -> Column:
        ways = F.transform(span["words"], lambda w: F.struct(
            (w["cost"] + before["best"][w["size"] - 1]).alias("total"), (-w["size"]).alias("less"), w["pos"].alias("pos")))
        none = F.struct((unknown + before["best"][0]).alias("total"), F.lit(0).alias("less"), F.lit(None).cast("string").alias("pos"))
        return F.array_min(F.concat(ways, F.array(none)))

    def back(state: Column, span: Column) -> Column:
        # One-element arrays bind a value to a name, so that it is computed once.
        return F.transform(F.array(gap(state, span)), lambda before: F.transform(F.array(choose(before, span)), lambda top: F.struct(
            span["at"].alias("front"),
            F.concat(F.array(top["total"]), before["best"]).alias("best"),
            F.concat(F.array(F.struct(F.greatest(F.lit(1), -top["less"]).alias("size"), top["pos"].alias("pos"))), before["path"]).cast(step).alias("path"),
        ))[0])[0]

    start = F.struct(last.alias("front"), F.array(F.lit(0).cast("long")).alias("best"), F.array().cast(step).alias("path"))
    return F.aggregate(F.reverse(F.array_sort(island_spans)), start, back, lambda state: state["path"])


def _words(path: Column, first: Column) -> Column:
    """The dictionary words (at, size, pos) on a path that starts at ``first``."""
    word = "array<struct<at:int,size:int,pos:string>>"
    start = F.struct(first.alias("at"), F.lit(0).alias("skip"), F.array().cast(word).alias("out"))

    def walk(state: Column, step: Column) -> Column:
        here = (state["skip"] == 0) & step["pos"].isNotNull()
        found = F.array(F.struct(state["at"].alias("at"), step["size"].alias("size"), step["pos"].alias("pos")))
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(state["skip"] > 0, state["skip"] - 1).otherwise(step["size"] - 1).alias("skip"),
            F.when(here, F.concat(state["out"], found)).otherwise(state["out"]).cast(word).alias("out"),
        )

    return F.aggregate(path, start, walk, lambda state: state["out"])


def best_paths(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, words) for the runs ``(id, run)`` with at least one word; words are (at, size, pos) in text order.

    A path covers a run with dictionary words and single characters; the cheapest one counts, ties going to the
    longer word at the first place where paths differ. Words that overlap, directly or through others, form
    islands; a path can be chosen for each of them alone, since no word crosses its ends. An empty dictionary
    gives no row, and so does a run without any of its words.
    """
    order = W.partitionBy("id").orderBy("at")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = spans(runs, word_costs(dictionary)).withColumn("_starts", F.coalesce(before <= F.col("at"), F.lit(True)).cast("int"))
    islands = starts.withColumn("island", F.sum("_starts").over(order)).groupBy("id", "island").agg(
        F.min("at").alias("first"), F.max("end").alias("last"), F.max(F.col("words")[0]["unknown"]).alias("unknown"),
        F.collect_list(F.struct("at", "words")).alias("spans"),
    )
    paths = islands.withColumn("path", _cheapest(F.col("spans"), F.col("last"), F.col("unknown")))
    words = paths.select("id", _words(F.col("path"), F.col("first")).alias("words"))
    return words.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words")).filter(F.size("words") > 0)
