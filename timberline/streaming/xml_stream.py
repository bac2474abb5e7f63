"""Streams of XML documents: shredding and row-local validation as they arrive.

Both are stateless for a document, so they run on a stream as on a table. Checks that group by document (order of
children, identifiers) run in foreach_batch, where a micro-batch holds whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.operators.bind import resolve
from timberline.operators.validate import attribute_errors, element_errors, validate
from timberline.sources.shared import materialise, release
from timberline.sources.xml import shred
from timberline.sources.xsd import Catalog


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole XML files that arrive in a folder: doc_id and text."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    return files.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def row_errors(docs: DataFrame, catalog: Catalog) -> DataFrame:
    """Attribute and element errors of a stream of documents."""
    nodes = resolve(shred(docs).where("error IS NULL"), catalog)
    return attribute_errors(nodes, catalog).unionByName(element_errors(nodes, catalog))


def write_errors(docs: DataFrame, catalog: Catalog, path: str, checkpoint: str) -> StreamingQuery:
    """All errors of each micro-batch appended to a Parquet folder, in a subfolder of the batch's number, which a
    repeated batch replaces."""

    def batch(df: DataFrame, number: int) -> None:
        nodes = materialise(shred(df), "nodes")  # the checks read it several times
        validate(nodes, catalog).write.mode("overwrite").parquet(f"{path}/batch={number}")
        release(nodes)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
