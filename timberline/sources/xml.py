"""XML sources: typed rows by Spark's XML reader, and node tables by a shredder.

A node table has one row for each element: doc_id, node_id (in preorder), parent_id, ord (place below its parent),
depth (root: 0), path (zero-padded places, so that string order is preorder), names (the element names from the root
down), name, attribs, value (text lines) and error (malformed_xml on a row without a node).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.sources.xsd import Catalog

NODE_SCHEMA = "doc_id long, node_id long, parent_id long, ord int, depth int, path string, names array<string>, name string, attribs map<string,string>, value array<string>, error string"
#: Digits of a place in a path.
WIDTH = 10
COMMENT = "_comment_"


def scan(spark: SparkSession, path: str, row_tag: str, catalog: Catalog | None = None, type_name: str | None = None) -> DataFrame:
    """Typed rows of an XML file or folder, with the schema of a catalog's type where one is given. Malformed rows stay,
    in _corrupt_record."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
    if catalog is not None and type_name is not None:
        reader = reader.schema(with_corrupt(catalog.struct(type_name)))
    return reader.load(path)


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def bind_text(text: Column, catalog: Catalog, type_name: str) -> Column:
    """A column of XML documents bound to a type of the catalog, in the JVM."""
    return F.from_xml(text, with_corrupt(catalog.struct(type_name)).simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the file's path), path and text of whole XML files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def _lines(text: str | None) -> list[str] | None:
    found = [x.strip() for x in (text or "").splitlines()]
    return [x for x in found if x] or None


def shred_text(doc_id: int | None, text: str | None) -> list[tuple]:
    """Node rows of one document; one row with the error malformed_xml, or no_root for an empty one."""
    empty = (doc_id, None, None, None, None, None, None, None, None, None)
    if text is None or not text.strip():
        return [(*empty, "no_root")]
    try:
        root = ET.fromstring(text, parser=ET.XMLParser(target=ET.TreeBuilder(insert_comments=True)))
    except ET.ParseError as e:
        return [(*empty, "multiple_roots" if "junk after document element" in str(e) else "malformed_xml")]
    out: list[tuple] = []
    todo = [(root, None, 0, 0, "", [])]
    while todo:  # depth first without recursion: documents may be deep
        node, parent, place, depth, above, names = todo.pop()
        here = len(out)
        path = f"{above}/{place:0{WIDTH}d}"
        comment = node.tag is ET.Comment
        name = COMMENT if comment else node.tag.split("}")[-1]
        value = [node.text or ""] if comment else _lines(node.text)
        own = [*names, name]
        out.append((doc_id, here, parent, place, depth, path, own, name, [] if comment else list(node.attrib.items()), value, None))
        todo += [(c, here, i, depth + 1, path, own) for i, c in reversed(list(enumerate(node)))]
    return out


def shred(docs: DataFrame, text: str = "text") -> DataFrame:
    """The node table of a column of XML documents with doc_id. Row-local; a malformed document is an error row."""
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += shred_text(doc, page)
                if len(rows) > 5000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, NODE_SCHEMA)
