"""Text cleaning, dates, names, rejection and score checks."""

from pyspark.sql import functions as F

from catalog import query
from catalog import views as v
from feltgrid.domain import EMOTIONS, PROVINCE_SUFFIXES
from feltgrid.functions import dates, metrics, parsing, text

LETTERS = r"\p{L}"
# White space as a RE2 class, which knows only ASCII blanks by name.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def clean_sql(column: str) -> str:
    out = column
    for pattern in (f"http[^{WS}]+", f"回复@[^{WS}]+:", f"//@[^{WS}]+:", r"\[[^\]]+\]"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"regexp_replace({out}, '#([^#]+)#', '\\1', 'g')"
    out = f"regexp_replace({out}, '[{WS}]+', ' ', 'g')"
    return f"regexp_replace({out}, '^ | $', '', 'g')"


def letters_sql(column: str) -> str:
    return f"length(regexp_replace({column}, '[^\\p{{L}}]', '', 'g'))::INT"


# Texts with post mark-up put around and into them.
MARKED = "'回复@' || source || ': http://t.cn/' || doc_id || ' #' || lang || '# [' || source || '] ' || text || ' //@' || lang || ': http://t.cn/x　'"


def marked(docs):
    c = F.col
    return F.concat(
        F.lit("回复@"), c("source"), F.lit(": http://t.cn/"), c("doc_id").cast("string"), F.lit(" #"), c("lang"),
        F.lit("# ["), c("source"), F.lit("] "), c("text"), F.lit(" //@"), c("lang"), F.lit(": http://t.cn/x　"),
    )


@query(f"""
SELECT doc_id, md5(cleaned) AS digest, length(cleaned)::INT AS length
FROM (SELECT doc_id, {clean_sql(MARKED)} AS cleaned FROM documents)""")
def clean_text(spark, d):
    docs = v.table(spark, d, "documents")
    cleaned = docs.select("doc_id", text.clean_text(marked(docs)).alias("cleaned"))
    return cleaned.select("doc_id", F.md5("cleaned").alias("digest"), F.length("cleaned").alias("length"))


@query(f"""SELECT page_id, {clean_sql("url || ' ' || html")} AS cleaned FROM pages""")
def clean_pages(spark, d):
    pages = v.table(spark, d, "pages")
    return pages.select("page_id", text.clean_text(F.concat("url", F.lit(" "), "html")).alias("cleaned"))


@query(f"SELECT doc_id, {letters_sql('text')} AS letters FROM documents")
def letter_count(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.count_chars("text", LETTERS).alias("letters"))


@query(f"""
SELECT reason, count(*)::BIGINT AS count FROM (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 'bad_date' WHEN {letters_sql("cleaned")} < 300 THEN 'too_short'
              WHEN length(cleaned) = 0 THEN 'empty_content' WHEN doc_id % 7 = 0 THEN 'unknown_province'
              ELSE 'kept' END AS reason
  FROM (SELECT doc_id, {clean_sql("text")} AS cleaned FROM documents)) GROUP BY reason""")
def reject_reasons(spark, d):
    posts = v.table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 11 != 0, F.lit("2020-03-01 10:00:00").try_cast("timestamp_ntz")).alias("stamp"),
        text.clean_text("text").alias("cleaned"),
        F.when(F.col("doc_id") % 7 == 0, "未知").otherwise(F.col("source")).alias("province"),
    )
    reason = text.reject_reason("stamp", "cleaned", "province", LETTERS, 300)
    return posts.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%G-W%V') END AS date_week,
       CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m') END AS date_month FROM orders""")
def parse_dates(spark, d):
    orders = v.table(spark, d, "orders")
    kind = F.col("o_orderkey") % 5
    raw = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.concat(F.lit("　"), F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" ")))
        .when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 3, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-01")))
        .otherwise("nan")
    )
    stamp = dates.parse_created_at(raw)
    return orders.select(
        "o_orderkey", dates.iso_week(stamp).alias("date_week"), dates.month_key(stamp).alias("date_month")
    )


def suffix_sql(column: str) -> str:
    out = column
    for suffix in PROVINCE_SUFFIXES:
        out = f"regexp_replace({out}, '{suffix}$', '')"
    return out


SUFFIXES = [*PROVINCE_SUFFIXES, "", "市省"]


@query(f"""
SELECT c_custkey, {suffix_sql("n_name || list_extract([" + ", ".join(f"'{s}'" for s in SUFFIXES) + "], (c_custkey % 9 + 1)::INT)")} AS province
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def normalise_names(spark, d):
    users = v.table(spark, d, "customer").join(v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("c_custkey") % 9 + 1).cast("int"))
    return users.select("c_custkey", text.normalise_province(F.concat("n_name", suffix)).alias("province"))


PERTURBED = f"""
perturbed AS (SELECT post_id, CASE WHEN post_id % 50 = 0 THEN joy + 0.1 WHEN post_id % 70 = 0 THEN -joy ELSE joy END AS joy,
                     {", ".join(EMOTIONS[1:])} FROM posts)"""
TOTAL = "(" + " + ".join(EMOTIONS) + ")"


def perturbed(spark, d):
    joy = F.when(F.col("post_id") % 50 == 0, F.col("joy") + 0.1).when(F.col("post_id") % 70 == 0, -F.col("joy"))
    return v.posts(spark, d).withColumn("joy", joy.otherwise(F.col("joy")))


@query(v.with_(v.POSTS, PERTURBED, select=f"""
SELECT post_id, CASE WHEN joy < 0 OR joy > 1 THEN 'score_out_of_range:joy' WHEN abs({TOTAL} - 1.0) > 0.03
       THEN 'sum_error:' || printf('%.3f', {TOTAL}) END AS error FROM perturbed"""))
def score_validation(spark, d):
    error = F.regexp_replace(metrics.score_error(), "(score_out_of_range:[a-z]+)=.*", "$1")
    return perturbed(spark, d).select("post_id", error.alias("error"))


@query(v.with_(v.POSTS, PERTURBED, select=f"""
SELECT round(avg((abs({TOTAL} - 1.0) < 0.05)::INT), 4) AS valid_rate,
       count(*) FILTER (joy < 0 OR joy > 1)::BIGINT AS out_of_range_rows FROM perturbed"""))
def sum_validity(spark, d):
    return perturbed(spark, d).agg(
        metrics.sum_valid_rate().alias("valid_rate"),
        F.count(F.when(metrics.out_of_range(), 1)).alias("out_of_range_rows"),
    )


@query(v.with_(v.POSTS, select="""
SELECT post_id, CASE WHEN post_id % 4 = 3 THEN NULL ELSE 2 END AS items,
       CASE WHEN post_id % 4 = 3 THEN NULL ELSE word_count / 1000.0 END AS first_joy FROM posts"""))
def score_replies(spark, d):
    posts = v.posts(spark, d)
    joy = (F.col("word_count") / 1000.0).cast("string")
    rest = '"sadness":0,"anger":0,"fear":0,"surprise":0,"neutral":0}'
    items = F.concat(F.lit('[{"id":1,"joy":'), joy, F.lit("," + rest + ',{"id":2,"joy":0,' + rest + "]"))
    kind = F.col("post_id") % 4
    raw = (
        F.when(kind == 0, items)
        .when(kind == 1, F.concat(F.lit("```json\n"), items, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Scores:\n"), items))
        .otherwise(F.concat(F.lit('[{"id":1,"joy":'), joy, F.lit("," + rest + "]")))
    )
    parsed = posts.select("post_id", parsing.parse_score_reply(raw, 2).alias("parsed"))
    return parsed.select(
        "post_id", F.nullif(F.size("parsed"), F.lit(-1)).alias("items"), F.col("parsed")[0]["joy"].alias("first_joy")
    )
