"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Candidate strings are found per document. Their hashes are then aggregated over the corpus: a candidate
that occurs at many owners is a copied example, one that stays with its owner looks live. Only spans and
hashes are shuffled, never texts, and the aggregation counts distinct owners and repositories with
partial sums, so a string that a third of all documents quote is a few rows for each task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltgrid.llm.frames import fresh
from feltgrid.operators.stage import stage

MAX_OWNERS = 3
PLACEHOLDER = "[secret]"
CHUNK = 512


@dataclass(frozen=True)
class Kind:
    """A kind of candidate. ``group`` is the secret itself and must have ``least`` characters."""

    name: str
    pattern: str
    least: int
    group: int = 0


#: The base kinds, in the order in which spans of one start are listed.
BASE_KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Kind("access", r"AKIA[A-Z0-9]+", 18),
    # A run of 16 is found only where the whole run is at least as long, so this drops the same runs.
    Kind("hex", r"[0-9a-f]{16,}", 16),
)

#: Further well-known shapes of credentials.
MORE_KINDS = (
    Kind("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", 15),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    Kind("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 27),
)

SPANS = "array<struct<start:long,rank:int,kind:string,end:long,value:string>>"


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda Spark would compute it for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(numbers: Column) -> Column:
    """The sums of all beginnings of an array. Sums are taken in chunks, as appending to one array copies it each time."""
    zero = F.struct(_long(0).alias("sum"), F.array().cast("array<long>").alias("sums"))

    def fold(values: Column) -> Column:
        return F.aggregate(values, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["sums"], F.array(acc["sum"] + x)).alias("sums")))

    def joined(parts: Column) -> Column:
        offsets = F.concat(F.array(_long(0)), fold(F.transform(parts, lambda p: p["sum"]))["sums"])
        pairs = F.arrays_zip(parts.alias("p"), offsets.alias("o"))
        return F.flatten(F.transform(F.filter(pairs, lambda z: z["p"].isNotNull()), lambda z: F.transform(z["p"]["sums"], lambda x: x + z["o"])))

    def chunks(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
        return let(F.transform(starts, lambda at: fold(F.slice(values, at, CHUNK))), joined)

    return let(numbers, chunks)


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Leftmost non-overlapping matches of one kind as spans of code points, failing ones dropped.

    A text is cut at its matches; the lengths of pieces and matches in turn give the positions. The work
    grows with the matches, not with their square.
    """
    pattern = F.lit(kind.pattern)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g).cast("long"))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group))

    def listed(steps: Column) -> Column:
        ends = running_sums(F.transform(steps, lambda s: s["gap"] + s["size"]))
        spans = F.transform(F.arrays_zip(steps.alias("s"), ends.alias("e")), lambda z: F.struct(
            (z["e"] - z["s"]["size"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), z["e"].alias("end"), z["s"]["value"].alias("value"),
        ))
        return F.filter(spans, lambda s: F.length(s["value"]) >= kind.least)

    # The last piece of the text follows no match.
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value")), lambda s: s["size"].isNotNull())
    return F.when(text.rlike(kind.pattern), let(steps, listed)).otherwise(F.array().cast(SPANS))


def candidate_spans(text: Column, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS) -> Column:
    return F.array_sort(F.concat(*[spans_of(text, kind, rank) for rank, kind in enumerate(kinds)]))


def _digest(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def scan(docs: DataFrame, doc_id: str, text: str, repository: str, owner: str) -> DataFrame:
    """Staged rows (_row, doc_id, repository, owner, spans) for all rows of ``docs``; no texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    return stage(docs.select(
        row_key(doc_id, text, repository, owner).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"), candidate_spans(body).alias("spans"),
    ))


def row_key(*columns: str) -> Column:
    """Rows equal in these columns have equal spans, so their content is their key."""
    return F.xxhash64(*[F.col(c) for c in columns])


def ownership(scanned: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Every distinct candidate occurrence with the corpus-wide counts of its secret.

    Columns _row, kind, start, end, secret_hash, n_repositories, n_owners, n_occurrences, verdict
    ('copied' for more than ``max_owners`` owners, else 'live'). Null repositories and owners are not
    counted as such. The secret itself is not returned.
    """
    found = scanned.filter(F.size("spans") > 0).dropDuplicates(["_row"]).select("_row", "repository", "owner", F.explode("spans").alias("s"))
    found = found.select(
        "_row", "repository", "owner", F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.sha2("s.value", 256).alias("secret_hash"),
    )
    counts = found.groupBy("secret_hash").agg(
        F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.count(F.lit(1)).alias("n_occurrences"),
    )
    verdict = F.when(F.col("n_owners") > max_owners, "copied").otherwise("live")
    return found.drop("repository", "owner").join(counts, "secret_hash").withColumn("verdict", verdict)


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS
) -> DataFrame:
    """One row per row of ``docs``: its spans, counts by base kind, and how many look live or copied.

    Columns doc_id, spans (array of start, rank, kind, end), n_assign, n_access, n_hex, base_spans and
    all_spans (kind:start:end, by start, then kind as listed), n_live, n_copied. A null text is empty and
    has no spans. Repeated rows get equal results; null ids are kept. Other columns are not read.
    """
    scanned = scan(docs, doc_id, text, repository, owner)
    counts = ownership(scanned, max_owners).groupBy("_row").agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "copied").alias("n_copied")
    )
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    rows = scanned.select(
        "_row", "doc_id", F.transform("spans", lambda s: s.dropFields("value")).alias("spans"), number("assign").alias("n_assign"),
        number("access").alias("n_access"), number("hex").alias("n_hex"), _digest(base).alias("base_spans"), _digest(F.col("spans")).alias("all_spans"),
    )
    zero = {c: F.coalesce(c, _long(0)) for c in ("n_live", "n_copied")}
    return rows.join(counts, "_row", "left").withColumns(zero).drop("_row")


def redact(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source",
    max_owners: int = MAX_OWNERS, placeholder: str = PLACEHOLDER,
) -> DataFrame:
    """``docs`` with every live-looking span of ``text`` replaced; copied examples and all else stay.

    Overlapping spans are replaced as one. Texts without live spans, and null texts, are unchanged. Rows are staged
    with their spans, so patterns run once; only rows with candidates are joined with the verdicts, all others
    pass without a shuffle.
    """
    row, name = fresh(docs, "_row"), fresh(docs, "_spans")
    own = {"_row": F.col(row), "doc_id": F.col(doc_id), "repository": F.col(repository).cast("string"), "owner": F.col(owner).cast("string"), "spans": F.col(name)}
    rows = stage(docs.withColumns({row: row_key(doc_id, text, repository, owner), name: candidate_spans(F.coalesce(F.col(text), F.lit("")))}))
    scanned = rows.select(*[c.alias(n) for n, c in own.items()])
    live = ownership(scanned, max_owners).filter(F.col("verdict") == "live")
    # Where the text before a span begins: after all spans before it.
    before = W.partitionBy("_row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    live = live.withColumn("from", F.coalesce(F.max("end").over(before), _long(0))).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "from"))).alias("_live"), F.max("end").alias("_last")
    )
    column = F.col(text)
    live_name, last_name = fresh(rows, "_live"), fresh(rows, "_last")
    live = live.select(F.col("_row").alias(row), F.col("_live").alias(live_name), F.col("_last").alias(last_name))

    def piece(s: Column) -> Column:
        gap = F.substring(column, (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int"))
        return F.when(s["start"] >= s["from"], F.concat(gap, F.lit(placeholder))).otherwise(F.lit(""))

    tail = F.substring(column, (F.col(last_name) + 1).cast("int"), F.length(column))
    cleaned = F.concat(F.array_join(F.transform(live_name, piece), ""), tail)
    marked = rows.filter(F.size(name) > 0).join(live, row, "left")
    marked = marked.withColumn(text, F.when(F.col(live_name).isNull(), column).otherwise(cleaned)).select(*docs.columns)
    return rows.filter(F.size(name) == 0).select(*docs.columns).unionByName(marked)
