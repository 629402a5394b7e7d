"""How far the sources of a language differ in their terms, computed over a cube of blocks.

Terms are counted per (lang, source) group inside the tasks that read the documents. Groups of a language are
cut into blocks of ``GROUPS``, kept terms by hash into blocks of about ``CELL_COUNTS`` counts. A task owns cells (group block,
group block, term block): slices of counts are replicated to the cells that need them, a cell adds up the
divergences of its pairs over its terms, and the sums are reduced along the term axis. Slices are packed
numbers, so what is replicated is small, and no task ever holds all groups or all terms.

Everything is integer arithmetic: shares are parts of 10^9 with two added counts per term, and a term's
divergence of shares p and q is floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts
from feltgrid.operators.stage import stage

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
GROUPS = 64
CELL_COUNTS = 1 << 18
HELD_TERMS = 250_000  # of all groups together, counted in a task before it passes them on
PART_BYTES = 1 << 20
TERM_COLUMNS = 4096

#: ASCII letters in lower case and all bytes of other characters stay, all else parts terms.
FOLD = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def parts(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, about a megabyte of it at a time."""
    data = text.encode("utf-8", "replace").translate(FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PART_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a null term says that the group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in slices(batches, "text", 4 << 20):
            for lang, source, t in zip(*(texts(batch, c) for c in ("lang", "source", "text"))):
                times, documents = groups.setdefault((lang, source), (Counter(), Counter()))
                met: set[bytes] = set()
                for words in parts(t):
                    times.update(words)
                    met.update(words)
                documents.update(met)
            if sum(len(times) for times, _ in groups.values()) > HELD_TERMS:
                yield from listed(groups)
                groups = {}
        yield from listed(groups)

    def listed(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, documents) in groups.items():
            n = len(times) + 1
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * n, pa.string()), "source": pa.array([source] * n, pa.string()),
                "term": pa.array([None, *times], pa.binary()).cast(pa.string()), "n": pa.array([0, *times.values()], pa.int64()),
                "docs": pa.array([0, *(documents[w] for w in times)], pa.int64()),
            })

    counted = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact for any counts."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")) + 1


def term_divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` of ``n + 2`` in ``total + 2 terms``: three decimal places at a time, so that nothing overflows below 9 * 10^15."""
    quotient, rest = np.divmod(n, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + more
    return quotient + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


# --- The cube -------------------------------------------------------------------------------


def group_table(counts: DataFrame, kept: DataFrame, groups: int, cell_counts: int) -> DataFrame:
    """(lang, source, g, total, terms, lang_total, blocks, term_blocks) of every group, numbered in its language.

    Windows run over groups, not over documents or counts.
    """
    sums = counts.groupBy("lang", "source").agg(
        F.sum(F.when(F.col("lang_n").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.count("lang_n").alias("listed")
    )
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    lang = Window.partitionBy("lang")
    zero = F.lit(0).cast("long")
    return sums.join(langs, "lang", "left").select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("g"), "total",
        F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_total", zero).alias("lang_total"),
        F.ceil(F.count(F.lit(1)).over(lang) / groups).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum("listed").over(lang) / cell_counts)).cast("int").alias("term_blocks"),
    )


def term_slices(counts: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """(lang, t, block, members, terms, counts): the counts of a block of groups in a block of terms, packed.

    Terms are numbered in their block, in order, so cells compare numbers. A block of terms holds about
    ``CELL_COUNTS`` counts of its language, whatever the corpus.
    """
    named = counts.filter(F.col("lang_n").isNotNull()).join(table.select("lang", "source", "g", "term_blocks"), ["lang", "source"])
    rows = named.select("lang", F.pmod(F.xxhash64("term"), "term_blocks").cast("int").alias("t"), "term", "g", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, last, number = None, [], None, -1
        for batch in batches:
            for lang, t, term, g, n in zip(*(column(batch, c) for c in ("lang", "t", "term", "g", "n"))):
                if (lang, t) != current:
                    if held:
                        yield packed(current, held)
                    current, held, last, number = (lang, t), [], None, -1
                number += term != last
                last = term
                held.append((g, number, n))
        if held:
            yield packed(current, held)

    def packed(key: tuple, held: list) -> pa.RecordBatch:
        g, terms, n = np.array(held, np.int64).T
        blocks = np.unique(g // groups)
        here = [np.flatnonzero(g // groups == b) for b in blocks]
        k = len(blocks)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([key[0]] * k, pa.string()), "t": pa.array([key[1]] * k, pa.int32()), "block": pa.array(blocks.astype(np.int32)),
            "members": pa.array([(g[i] % groups).astype(np.int32).tobytes() for i in here], pa.binary()),
            "terms": pa.array([terms[i].astype(np.int32).tobytes() for i in here], pa.binary()),
            "counts": pa.array([n[i].tobytes() for i in here], pa.binary()),
        })

    dealt = rows.repartition("lang", "t").sortWithinPartitions("lang", "t", "term", "g")
    return dealt.mapInArrow(run, "lang string, t int, block int, members binary, terms binary, counts binary")


class Slice:
    """The counts of a block of groups in a block of terms."""

    def __init__(self, block: int, totals: list[int], terms_of_lang: int, members: bytes | None, terms: bytes | None, counts: bytes | None):
        self.block = block
        self.size = np.array(totals, np.int64) + 2 * terms_of_lang
        self.members, self.terms = np.frombuffer(members or b"", np.int32), np.frombuffer(terms or b"", np.int32)
        self.counts = np.frombuffer(counts or b"", np.int64)
        self.none = shares(np.full(len(self.size), 2, np.int64), np.maximum(self.size, 1))

    def dense(self, terms: np.ndarray) -> np.ndarray:
        """Shares of all groups (rows) in sorted ``terms`` (columns)."""
        out = np.repeat(self.none[:, None], len(terms), axis=1)
        lo, hi = np.searchsorted(self.terms, [terms[0], terms[-1] + 1])
        members = self.members[lo:hi]
        out[members, np.searchsorted(terms, self.terms[lo:hi])] = shares(self.counts[lo:hi] + 2, self.size[members])
        return out


def cell_sums(left: Slice, right: Slice, terms_once: int) -> np.ndarray:
    """Sums over the cell's terms of how much each pair's divergence exceeds that of a term neither group has.

    ``terms_once`` such divergences are added, the language's number of terms in its first term block.
    """
    none = divergences(left.none[:, None], right.none[None, :])
    out = none * terms_once
    met = np.union1d(left.terms, right.terms)
    for at in range(0, len(met), TERM_COLUMNS):
        some = met[at : at + TERM_COLUMNS]
        p, q = left.dense(some), right.dense(some)
        for a in range(len(p)):
            lo = a + 1 if left is right else 0
            out[a, lo:] += divergences(p[a], q[lo:]).sum(axis=1) - none[a, lo:] * len(some)
    return out


def pair_sums(slices_: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """(lang, a, b, value) of every pair of groups a < b of a language."""
    blocks = table.groupBy("lang", F.floor(F.col("g") / groups).cast("int").alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("g", "total"))), lambda x: x["total"]).alias("totals"),
        F.first("terms").alias("lang_terms"), F.first("blocks").alias("blocks"), F.first("term_blocks").alias("term_blocks"),
    )
    skeleton = blocks.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)))
    whole = skeleton.join(slices_, ["lang", "block", "t"], "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = whole.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks", "term_blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for lang, i, j, t, block, totals, n, *packed in zip(*(column(batch, c) for c in names)):
                if (lang, i, j, t) != current:
                    if held:
                        yield summed(*current, held)
                    current, held = (lang, i, j, t), []
                held.append((Slice(block, totals, n, *packed), n))
        if held:
            yield summed(*current, held)

    def summed(lang: str, i: int, j: int, t: int, held: list) -> pa.RecordBatch:
        left, right = held[0][0], held[-1][0]
        sums = cell_sums(left, right, held[0][1] if t == 0 else 0)
        a, b = np.triu_indices(len(sums), 1) if i == j else (x.ravel() for x in np.indices(sums.shape))
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(i * groups + a, pa.int32()), "b": pa.array(j * groups + b, pa.int32()), "value": pa.array(sums[a, b]),
        })

    names = ["lang", "i", "j", "t", "block", "totals", "lang_terms", "members", "terms", "counts"]
    # Cells cost far more than their bytes tell, so their number decides the tasks.
    n = table.groupBy("lang").agg((F.first("blocks") * (F.first("blocks") + 1) / 2 * F.first("term_blocks")).alias("n")).agg(F.sum("n")).first()[0] or 1
    most = 4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select(*names).repartition(max(1, min(int(n), most)), "lang", "i", "j", "t").sortWithinPartitions("lang", "i", "j", "t", "block")
    return dealt.mapInArrow(run, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS,
    groups: int = GROUPS, cell_counts: int = CELL_COUNTS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group that occurs.

    Part ``pair`` ranks the other sources of the language by divergence over all its kept terms, part ``term`` the terms that
    the group uses more than its language, the first ``top_terms`` only. Terms in fewer than ``min_documents`` documents
    of a language are not kept. Null text, lang and source count as empty; a group without kept terms is compared like
    any other, and a language without kept terms has pairs of divergence 0; repeated rows are documents of their own. Ties go by item.
    Other columns are not read. An empty table gives no rows.
    """
    empty = F.lit("")
    source_rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    counted = stage(term_counts(source_rows))
    kept = stage(
        counted.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_documents).drop("docs")
    )
    present = counted.filter(F.col("term").isNull()).select("lang", "source", "term", "n", F.lit(None).cast("long").alias("lang_n"))
    counts = stage(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n").unionByName(present))
    table = stage(group_table(counts, kept, groups, cell_counts))

    sums = pair_sums(term_slices(counts, table, groups), table, groups)
    ends = F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("o")), F.struct(F.col("b").alias("g"), F.col("a").alias("o")))).alias("e")
    name = table.select("lang", "source", "g")
    pairs = (
        sums.select("lang", "value", ends).select("lang", "value", "e.g", "e.o").join(name, ["lang", "g"])
        .join(name.select("lang", F.col("g").alias("o"), F.col("source").alias("item")), ["lang", "o"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    over = counts.filter(F.col("lang_n").isNotNull() & (F.col("n") > 0)).join(table, ["lang", "source"]).withColumns({"_p": p, "_q": q}).filter("_p > _q")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), term_divergence(F.col("_p"), F.col("_q")).alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))

    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top_terms))
