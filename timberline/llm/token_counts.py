"""Exact length histogram of encoded documents.

Documents are counted by their encoded length; the histogram has at most as many rows as there are lengths, whatever
the number of documents. Suffix sums over it answer, for every context limit, how many documents and tokens reach it,
what a truncation to it keeps, and which quantile it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.encoding import encoder
from timberline.sources.shared import materialise

#: Lengths in a block of the two-level suffix sums.
BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and length (number of ids of the whole text; null texts: 0) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([code.count(t.as_py()) for t in b.column(1)], pa.int64())], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """length, docs: the number of rows of each length."""
    return lengths.groupBy("length").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram:

    docs, tokens (of that length), docs_at_least, tokens_at_least (of lengths L and more), docs_at_most, truncated (the
    tokens that stay if every document is cut to L ids), total_docs, total_tokens, quantile (docs_at_most / total_docs).

    An empty histogram gives no rows. Sums run in blocks of lengths and over the blocks' sums, so no task orders the
    whole histogram.
    """
    h = hist.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    every, after = W.partitionBy(), W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    b = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    b = b.select("block", *[F.coalesce(F.sum(c).over(after), zero).alias(f"{c}_after") for c in "dt"], F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    here = W.partitionBy("block").orderBy(F.col("length").desc())
    s = h.join(b, "block").withColumn("docs_at_least", F.sum("docs").over(here) + F.col("d_after")).withColumn("tokens_at_least", F.sum("tokens").over(here) + F.col("t_after"))
    at_most = F.col("total_docs") - F.col("docs_at_least") + F.col("docs")
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return s.select("length", "docs", "tokens", "docs_at_least", "tokens_at_least", at_most.alias("docs_at_most"), truncated.alias("truncated"), "total_docs", "total_tokens", (at_most / F.col("total_docs")).alias("quantile"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit (context): docs_over, the docs that exceed it, and truncated, the tokens that stay if
    every document is cut to it. Both follow from the suffix sums of the least length above the limit. Null limits and
    an empty table give no rows; a repeated limit gives one."""
    asked = sorted({int(x) for x in limits if x is not None})
    zero, kind = F.lit(0).cast("long"), "struct<length:bigint,docs_at_least:bigint,tokens_at_least:bigint>"
    next_ = [F.min(F.when(F.col("length") > c, F.struct("length", "docs_at_least", "tokens_at_least"))).cast(kind) for c in asked]
    one = sums.agg(F.max("total_tokens").alias("total"), F.array(*next_).cast(f"array<{kind}>").alias("next")).where("total IS NOT NULL")
    each = one.select("total", F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in asked]).cast("array<bigint>").alias("context"), "next")).alias("x"))
    over, tokens = F.coalesce("x.next.docs_at_least", zero), F.coalesce("x.next.tokens_at_least", zero)
    return each.select("x.context", over.alias("docs_over"), (F.col("total") - tokens + F.col("x.context") * over).alias("truncated"))


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """For each q: the least length that at least the share q of the documents doesn't exceed."""
    return sums.agg(*[F.min(F.when(F.col("docs_at_most") >= F.lit(float(q)) * F.col("total_docs"), F.col("length"))).alias(f"q{q:g}") for q in at])


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """suffix_sums() of the exact lengths of all documents.

    Null and empty texts have length 0; repeated rows, and null ids, count as often as they occur; texts are whole. An
    empty table gives no rows. Other columns aren't read. The histogram is written, as the sums read it twice and
    encoding is by far the dearest step.
    """
    return suffix_sums(materialise(histogram(lengths(docs, tokenizer)), "histogram"))
