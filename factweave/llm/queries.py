"""Queries of the text problems, pN_..., and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.codedoc import documented_fields, documented_functions
from factweave.llm.credentials import detect
from factweave.llm.leakage import leaked_items
from factweave.llm.quality import quality_statistics
from factweave.llm.survivorship import slot_survivors, slot_survivors_sql
from factweave.llm.tokenize import token_ids
from factweave.plans.registry import Registry
from factweave.tables import table

LLM = Registry()


def source_texts(spark: SparkSession, d: str) -> DataFrame:
    """``origin, row_id, code, file`` of all source and configuration text."""
    parts = [("source_snippets", "snippet_id", "code", "file"), ("cache_entries", "entry_id", "text", None), ("site_contexts", "site_id", "code", "file")]
    frames = [table(spark, d, t).select(F.struct(F.lit(t).alias("origin"), F.col(key).alias("row_id")).alias("place"), F.col(text).alias("code"), (F.col(file) if file else F.lit(None).cast("string")).alias("file")) for t, key, text, file in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@LLM.add()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a credential begins."""
    return detect(source_texts(spark, d), "place").select("place.origin", "place.row_id", "line_no")


@LLM.add()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and struct fields whose documentation says something."""
    functions = documented_functions(table(spark, d, "source_files")).select(F.lit("function").alias("owner_kind"), "owner_id")
    fields = documented_fields(table(spark, d, "type_fields")).select(F.lit("field").alias("owner_kind"), F.col("field_id").alias("owner_id"))
    return functions.unionByName(fields).distinct()


@LLM.add(slot_survivors_sql())
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Which candidate supplies each field of each slot's surviving value."""
    return slot_survivors(table(spark, d, "candidates")).select("repo", "op_key", "slot_kind", "slot_key", "field_name", "cand_id")


@LLM.add()
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return token_ids(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "ids")


@LLM.add()
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """How many texts were stitched of how many pieces, and the number of their ids."""
    done = token_ids(table(spark, d, "documents", "doc_id", "text"))
    return done.groupBy("pieces").agg(F.count("*").alias("texts"), F.sum(F.size("ids")).alias("ids"))


@LLM.add()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat a passage of a test item, with that item."""
    return leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


@LLM.add()
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Quality statistics of every document."""
    return quality_statistics(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words"))


_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HAN = r"\x{3005}\x{3007}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"


@LLM.add(
    rf"""WITH cw AS (SELECT DISTINCT lower(word) AS w FROM common_words WHERE word IS NOT NULL),
h AS (SELECT '(' || string_agg(w, '|' ORDER BY length(w) DESC, w) || '|[{_HAN}])' AS p FROM cw WHERE length(w) > 1 AND regexp_full_match(w, '[{_HAN}]+')),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, n, regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS s FROM l),
g AS (SELECT *, count(*) FILTER (WHERE s = '') OVER (PARTITION BY doc_id ORDER BY n) AS block FROM s),
ne AS (SELECT * FROM g WHERE s <> ''),
t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(s), '[{_SPACE}]+')) AS t FROM ne),
piece AS (SELECT doc_id, t AS x, false AS cut FROM t WHERE NOT regexp_matches(t, '[{_HAN}]') UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '[{_HAN}]+|[^{_HAN}]+')), true FROM t WHERE regexp_matches(t, '[{_HAN}]')),
word AS (SELECT doc_id, x AS w FROM piece WHERE NOT cut UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, p)) FROM piece, h WHERE cut AND regexp_matches(x, '[{_HAN}]')
 UNION ALL SELECT doc_id, regexp_extract(x, '[\p{{L}}\p{{N}}](?:.*[\p{{L}}\p{{N}}])?') FROM piece WHERE cut AND NOT regexp_matches(x, '[{_HAN}]') AND regexp_matches(x, '[\p{{L}}\p{{N}}]')),
a AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars, count(*) FILTER (WHERE w IN (SELECT w FROM cw)) AS common FROM word GROUP BY 1),
v AS (SELECT doc_id, sum(length(t)) AS visible FROM t GROUP BY 1),
b AS (SELECT doc_id, count(*) AS lines, count(DISTINCT s) AS different, count(*) FILTER (WHERE right(s, 1) IN ('.', '!', '?', ':', ';', '。', '！', '？', '：', '；', '…')) AS ended FROM ne GROUP BY 1),
p AS (SELECT doc_id, count(*) AS blocks, count(DISTINCT x) AS different FROM (SELECT doc_id, block, string_agg(s, chr(10) ORDER BY n) AS x FROM ne GROUP BY ALL) GROUP BY 1),
y AS (SELECT doc_id, length(regexp_replace(text, '[A-Za-z0-9_{_SPACE}]|[\p{{L}}\p{{N}}]', '', 'g')) AS symbols FROM documents)
SELECT d.doc_id, coalesce(a.n, 0) AS word_count, coalesce(a.chars / a.n, 0) AS mean_word_length, coalesce(symbols / visible, 0) AS symbol_ratio, coalesce(ended / lines, 0) AS punctuated_line_share, coalesce(common / a.n, 0) AS common_word_share,
 coalesce((lines - b.different) / lines, 0) AS duplicate_line_share, coalesce((blocks - p.different) / blocks, 0) AS duplicate_paragraph_share
FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN y USING (doc_id)"""
)
def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The statistics that SQL can express: words, their length, symbols, line ends, common words, repetition."""
    return p8_statistics(spark, d).select("doc_id", "word_count", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share", "duplicate_line_share", "duplicate_paragraph_share")


@LLM.add()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are a list, a table, code or junk for more than half of their text."""
    return p8_statistics(spark, d).where("form IS NOT NULL").select("doc_id", "form")
