"""Corpus pipeline: documents that are toxic go, one of each group of near copies stays, sources are mixed to their
target weights, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import mixing, packing, simhash, toxicity
from timberline.llm.queries import tokenizer_path
from timberline.sources.shared import release, settled
from timberline.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows outside the held-out fifth, doesn't reject.

    Null and empty texts have the score of no words and stay; repeated rows are judged alike; an empty table gives
    none; rows whose id or label is null are scored, never learnt from. Extra columns are kept, whatever their names.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least doc_id (3-word shingles, 3 bits).

    Null and empty texts are one component. Of repeated rows, and of several rows of that id, one stays; null ids come
    last. An empty table gives none. Extra columns are kept, whatever their names.
    """
    return simhash.one_of_each(docs, width=3, distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources to weights 1, 2, 3 takes it: not at all, up to three times.

    A null source is one of its own; texts without words have size 0; ties and repeated rows: see mixing.repeated(). An
    empty table gives none. Extra columns are kept, whatever their names.
    """
    return mixing.repeated(docs, weights=(1, 2, 3), share=1.0, limit=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids along the curve, with a digest of their ids.

    Null and empty texts are the end id alone; a repeated row is packed as often as it stands there, a null doc_id is
    kept; texts are whole. An empty table gives none. Extra columns are not in the pieces.
    """
    return packing.digests(packing.pack(docs, tokenizer_path(), length=2048, end_id=1))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: a trained classifier, Hamming components and a tokenizer are in it. Tests hold it against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it. What a stage has written on its
    way, and its input, are deleted once its result is."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = settled(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if i:
            release(docs)
        docs = done
    return docs
