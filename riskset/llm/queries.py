"""The text operators as queries over the driver's tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskset.llm import (ce_score, chat, html_main, lexical, license_scan, line_dedup, line_quality, mixing, near_dup, packing,
                         periods, url_filter, vptree)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_minhash_near_dup")
def op1(spark, sf_dir):
    """Every document with the smallest id of its class of near duplicates."""
    return near_dup.duplicate_classes(table(spark, sf_dir, "documents"))


@query("op2_html_templates")
def op2(spark, sf_dir):
    """Main text of every page, with the boxes that its host repeats removed."""
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


@query("op3_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM turns),
sized AS (
  SELECT *,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|sep\|>)', '\1\\\2\3', 'g')) AS text_chars,
    length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|\|sep\|>)', '\1\\\2\3', 'g')) AS role_chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN 7 ELSE role_chars + 20 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op3(spark, sf_dir):
    """Digests of what is read back from every formatted conversation, and from one full of control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(more)))


@query("op4_cross_entropy")
def op4(spark, sf_dir):
    """Every document's loss under a model of the good documents minus that under a model of all."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return ce_score.score(table(spark, sf_dir, "documents"), good)


@query("op5_binary_packing")
def op5(spark, sf_dir):
    """The pieces of every document with their sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


@query("op6_vp_tree")
def op6(spark, sf_dir):
    """The five nearest vectors to every fiftieth."""
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_quality_rules", r"""
WITH docs AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
windows AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS three
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (SELECT doc_id, three FROM windows WHERE three IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows JOIN repeated USING (doc_id, three), range(3) AS r(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line FROM docs)),
keyed AS (
  SELECT doc_id, host, text, line, len(ws) AS n,
         translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines WHERE len(ws) > 0),
totals AS (SELECT host, count(DISTINCT text) AS docs FROM docs GROUP BY host),
boilerplate AS (
  SELECT k.host, key FROM keyed k JOIN totals t ON k.host IS NOT DISTINCT FROM t.host
  GROUP BY k.host, key, t.docs HAVING count(DISTINCT text) > 20 AND (count(DISTINCT text) > 0.05 * t.docs OR count(DISTINCT text) > 200)),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         CAST(coalesce(sum(n) FILTER (b.key IS NOT NULL), 0) AS BIGINT) AS boilerplate_words
  FROM keyed k LEFT JOIN boilerplate b ON k.key = b.key AND k.host IS NOT DISTINCT FROM b.host GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM words GROUP BY doc_id),
base AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(boilerplate_words, 0) AS boilerplate_words
  FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN by_doc USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - boilerplate_words >= 0.5 * n_words AS kept
FROM base
""")
def op7(spark, sf_dir):
    """Base counts of every document and whether the quality rules keep it."""
    return line_quality.judge(table(spark, sf_dir, "documents"))


@query("op8_mixing", r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
placed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS position FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM placed WINDOW before AS (ORDER BY source_size / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (
  SELECT first(level ORDER BY source_size / weight, position) AS share FROM levels WHERE NOT level * weight > 3.0::DOUBLE * source_size),
rates AS (
  SELECT source, source_size, CASE WHEN share IS NULL OR share * weight > 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size
                                   ELSE share * weight END AS target
  FROM levels LEFT JOIN share ON true),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size = 0 THEN 1.0::DOUBLE ELSE least(target / source_size, 3.0::DOUBLE) END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM docs JOIN rates ON docs.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
""")
def op8(spark, sf_dir):
    """What a mix of the sources at weights 1, 2, 3 takes of every document."""
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op9_line_dedup", r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keys AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM keys WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keys LEFT JOIN repeated USING (key) GROUP BY doc_id
""")
def op9(spark, sf_dir):
    """Every document without the lines that an earlier document holds."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10(spark, sf_dir):
    """Licence phrases and templates in every document."""
    return license_scan.scan_licences(table(spark, sf_dir, "documents")).drop("spans")


@query("op11_url_filter")
def op11(spark, sf_dir):
    """Every page's verdict: a rule's, else that of trees trained on the labelled URLs.

    A URL's number is the id of its page's document, so the documents' labels are labels of URLs: low quality or toxic is to be blocked.
    """
    pages = table(spark, sf_dir, "pages")
    numbered = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)").alias("doc_id"))
    blocked = ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    return url_filter.judge(pages, numbered.join(table(spark, sf_dir, "labels"), "doc_id").select("url", blocked))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """Counts and digests of every document's periodic runs, after about one in ten has been made to repeat itself."""
    return periods.report(periods.periodic_runs(periods.with_repeats(table(spark, sf_dir, "documents"))))


@query("op13_lexical_search", r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY item_id, term),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM docs WHERE len(ts) > 0),
found AS (
  SELECT doc_id, d, n, term, count(*) AS tf
  FROM (SELECT doc_id, d, len(ts) AS n, unnest(ts) AS term FROM docs) JOIN (SELECT DISTINCT term FROM items) USING (term)
  GROUP BY doc_id, d, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM found, whole GROUP BY term),
worth AS (
  SELECT doc_id, d, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS value
  FROM found JOIN weights USING (term), whole),
scores AS (
  SELECT item_id, doc_id, d, CAST(sum(times * value) AS BIGINT) AS score
  FROM worth JOIN wanted USING (term) GROUP BY item_id, doc_id, d)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
""")
def op13(spark, sf_dir):
    """The twenty best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
