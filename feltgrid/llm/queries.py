"""Queries over the driver's tables, one for each corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltgrid.llm import bestfit, decontaminate, dialogue, divergence, fingerprint, html, jaccard, lm, packing, quality, secrets, toxicity, warc
from feltgrid.llm.frames import joined_ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), jaccard.Link(words=3, part=90, whole=100)).drop("first", "_row")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(joined_ids(F.col("items")), 256).alias("items_sha256"),
        "contaminated", F.size("near_items").cast("long").alias("n_near"), F.sha2(joined_ids(F.col("near_items")), 256).alias("near_sha256"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM b, LATERAL unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM d, sizes, LATERAL unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM found, LATERAL unnest(generate_series(i, i + n - 1)) AS t(p) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
         FROM found GROUP BY doc_id),
spots AS (SELECT doc_id, i, w[i] AS term FROM d, LATERAL unnest(generate_series(1, len(w))) AS t(i)),
vocabulary AS (SELECT DISTINCT item_id, unnest(w) AS term FROM b),
frequency AS (SELECT term, count(*) AS n FROM spots SEMI JOIN vocabulary USING (term) GROUP BY term),
probes AS (
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY n, term) AS rank, least(4, count(*) OVER (PARTITION BY item_id)) AS terms
  FROM vocabulary JOIN frequency USING (term) QUALIFY rank <= 4),
near AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT p.item_id, a.doc_id, a.i
    FROM probes p JOIN spots a ON a.term = p.term
    JOIN probes q ON q.item_id = p.item_id AND q.rank > 1
    JOIN spots o ON o.term = q.term AND o.doc_id = a.doc_id AND o.i BETWEEN a.i - 30 AND a.i + 30
    WHERE p.rank = 1 GROUP BY p.item_id, a.doc_id, a.i, p.terms HAVING count(DISTINCT q.rank) = p.terms - 1)),
beside AS (SELECT doc_id, count(*) AS n_near, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS near_ids
           FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN beside USING (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    id_type = pages.schema["page_id"].dataType
    found = warc.records(warc.read_archives(warc.write_archives(pages), payloads=False))
    return found.select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT html, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY html)
SELECT page_id, payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN r ON p.html = r.html
"""


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def crc_remainder(key, folds: int):
    """CRC-32 of an id written as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), held_out=lambda key: crc_remainder(key, 7) == 2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=lambda key: crc_remainder(key, 3) != 1
    )
    return scored.select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality", "keep")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
        F.col("all_spans").alias("spans"), "n_live", "n_copied",
    )


def _matches_sql(rank: int, kind: secrets.Kind) -> str:
    """SQL for one kind's spans: a list of (start, rank, kind, end, value)."""
    p = kind.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(text, '{p}', 0)) + 1), lambda i: struct_pack(
        s := list_sum(list_transform(regexp_split_to_array(text, '{p}')[1:i], lambda x: length(x)))::BIGINT
             + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}', 0)[1:i - 1], lambda x: length(x))), 0)::BIGINT,
        r := {rank}, k := '{kind.name}', n := length(regexp_extract_all(text, '{p}', 0)[i])::BIGINT,
        v := regexp_extract_all(text, '{p}', {kind.group})[i])), lambda m: length(m.v) >= {kind.least})"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, source, list_sort(list_concat(list_concat({_matches_sql(0, secrets.BASE_KINDS[0])}, {_matches_sql(1, secrets.BASE_KINDS[1])}),
        list_concat(list_concat({_matches_sql(2, secrets.BASE_KINDS[2])}, {_matches_sql(3, secrets.MORE_KINDS[0])}),
        list_concat({_matches_sql(4, secrets.MORE_KINDS[1])}, {_matches_sql(5, secrets.MORE_KINDS[2])})))) AS spans FROM d),
occurrence AS (SELECT doc_id, source, unnest(spans) AS m FROM f),
owners AS (SELECT m.v AS v, count(DISTINCT source) AS n FROM occurrence GROUP BY m.v),
verdict AS (SELECT doc_id, count(*) FILTER (WHERE n <= {secrets.MAX_OWNERS}) AS n_live, count(*) FILTER (WHERE n > {secrets.MAX_OWNERS}) AS n_copied
            FROM occurrence JOIN owners ON m.v = owners.v GROUP BY doc_id)
SELECT f.doc_id, len(list_filter(spans, lambda m: m.r = 0)) AS n_assign, len(list_filter(spans, lambda m: m.r = 1)) AS n_access,
       len(list_filter(spans, lambda m: m.r = 2)) AS n_hex,
       sha256(array_to_string(list_transform(list_filter(spans, lambda m: m.r < 3), lambda m: m.k || ':' || m.s || ':' || (m.s + m.n)), ',')) AS base_sha256,
       array_to_string(list_transform(spans, lambda m: m.k || ':' || m.s || ':' || (m.s + m.n)), ',') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM f LEFT JOIN verdict USING (doc_id)
"""


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS m FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.MIN_DOCUMENTS}),
size AS (SELECT lang, count(*) AS v, sum(m)::HUGEINT AS m FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM n GROUP BY lang, source),
g AS (SELECT a.lang, a.source, coalesce(v, 0) AS v, coalesce(t.n, 0) AS n, coalesce(s.m, 0) AS m
      FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN total t USING (lang, source) LEFT JOIN size s ON s.lang = a.lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS c,
             1 + {divergence.SCALE}::HUGEINT * (coalesce(n.n, 0) + 2) // (g.n + 2 * g.v) AS p, 1 + {divergence.SCALE}::HUGEINT * (kept.m + 2) // (g.m + 2 * g.v) AS q
      FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
         FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    damaged = dialogue.damage(dialogue.read_rows(conversations))
    return dialogue.Repair(damaged, ids=conversations.select("conv_id")).digests()


def _turn_sql(role: str, text: str, after: str, cost: str, letter: str) -> str:
    """The repair that puts a turn before the one of state ``after``."""
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': chr(10) || {role} || ':' || {text} || {after}.t}}"


def _row_sql(state: int) -> str:
    """The best repair from row x on in a state of the grammar, its first edit no insertion."""
    after = dialogue.NEXT[state]
    role = dialogue.ROLE[after]
    options = [f"{{'c': s{state}.c + 2, 'a': 'D' || s{state}.a, 't': s{state}.t}}",
               f"CASE WHEN NOT gone THEN {_turn_sql(repr(role), 'x.text', f's{after}', '1 + extra', 'R')} END",
               f"CASE WHEN NOT gone AND initial = '{role[0]}' THEN {_turn_sql('x.role', 'x.text', f's{after}', 'extra', 'K')} END"]
    if state == dialogue.START:
        options.append(f"CASE WHEN NOT gone AND initial = 's' THEN {_turn_sql('x.role', 'x.text', 's1', 'extra', 'K')} END")
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL)) AS n{state}"


def _insert_sql(state: int, after: str) -> str:
    role = dialogue.ROLE[dialogue.NEXT[state]]
    return f"list_min([n{state}, {_turn_sql(repr(role), repr(''), after, '5', 'I')}]) AS s{state}"


_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda k: ord(k)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""

OP13_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT *, {_CRC_SQL} % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM hit, LATERAL unnest(generate_series(1, CASE h WHEN 3 THEN 2 ELSE 1 END)) WHERE h <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
f AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), again) AS i,
             regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM e),
x AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS odd FROM f),
dp AS (
  SELECT conv_id, count(*) + 1 AS pos, {{'c': 0, 'a': '', 't': ''}} AS s0, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1,
         {{'c': 5, 'a': 'I', 't': chr(10) || 'assistant:'}} AS s2, {{'c': 0, 'a': '', 't': ''}} AS s3 FROM x GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, {_insert_sql(0, "s2")}, {_insert_sql(1, "s2")}, s2, s3
  FROM (SELECT *, {_insert_sql(2, "n3")}, {_insert_sql(3, "n2")}
        FROM (SELECT x.conv_id, x.i AS pos, {", ".join(map(_row_sql, range(4)))}
              FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.i = dp.pos - 1))),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
                  count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT gone) AS truncated,
                  count(*) FILTER (WHERE odd) AS illegal FROM x GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM o.conv_id AND dp.pos = 1
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_jaccard_join, op2_secrets, op3_packing, op4_html, op5_decontaminate, op6_lm_score, op7_toxicity, op8_quality, op9_warc, op10_fingerprint,
        op11_best_fit, op12_divergence, op13_conversations,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": OP2_SQL, "op5_decontaminate": OP5_SQL, "op9_warc": OP9_SQL, "op12_divergence": OP12_SQL, "op13_conversations": OP13_SQL}
