"""The registered queries of this subpackage, each a thin application of its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import chat, html_text, mixing, nearest, packing, simhash, token_counts, top_k, toxicity, url_filter
from timberline.sources.tables import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each encoded length of documents: counts, suffix sums, truncated totals and quantile."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, weights=(1, 2, 3), share=1.0, limit=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the 5 nearest found for each vec_id divisible by 50."""
    return nearest.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of conversations as canonical JSON, with its order and errors."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_chats() over all conversations with derived tool calls: most messages are linked."""
    return chat.format_chats(chat.with_tools(table(spark, sf_dir, "conversations")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document."""
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=2048, end_id=1))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict (and template, purity) for every page."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 highest integer inner products for each vec_id divisible by 20."""
    return top_k.search(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": op2_mixing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_chat_formatting": op5_chat_formatting,
    "chat_tool_calls": chat_tool_calls,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_url_filters": op8_url_filters,
    "op9_top_k": op9_top_k,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * z AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(z) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap / weight <= g THEN cap ELSE g * weight END AS target
    FROM (SELECT *, (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight >= level) AS g FROM l)),
k AS (SELECT doc_id, size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS times,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat(coalesce(doc_id::VARCHAR, ''), '|', size::VARCHAR)) ROWS UNBOUNDED PRECEDING) - size AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(size * (times + CASE WHEN size > 0 AND target > times * source_size AND (target - times * source_size - before) * 2 >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""

OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Queries that SQL can express over whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op5_chat_formatting": chat.ORACLE_SQL, "chat_tool_calls": chat.TOOLS_SQL, "op8_url_filters": url_filter.oracle(), "op9_top_k": OP9_SQL}
