"""Queries on node tables: walks, finds and collectors.

All of them are row-local or grouped by document; order is a column (preorder, rank), never the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.shared import materialise
from timberline.sources.xml import COMMENT, WIDTH


def place(ord_: Column) -> Column:
    """A place as it stands in a path."""
    return F.lpad(ord_.cast("string"), WIDTH, "0")


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def numbered(nodes: DataFrame, column: str, *order: str) -> DataFrame:
    """nodes with their number, from 1, in each document by `order`, however many of them a document holds.

    Rows are dealt out by ranges of (doc_id, order) and written, so a range stays what it is; each is numbered by
    itself. Only documents that reach over several ranges need an offset: at most two a range, so the offsets are
    broadcast.
    """
    ranged = nodes.repartitionByRange("doc_id", *order).withColumn("_range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    sizes = ranged.groupBy("doc_id", "_range").agg(F.count("*").alias("_size"))
    wide = sizes.groupBy("doc_id").agg(F.count("*").alias("_ranges")).where("_ranges > 1").select("doc_id")
    before = F.coalesce(F.sum("_size").over(W.partitionBy("doc_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.join(wide, "doc_id", "left_semi").select(F.col("doc_id").alias("_doc"), F.col("_range").alias("_part"), before.alias("_before"))
    here = F.row_number().over(W.partitionBy("doc_id", "_range").orderBy(*order))
    out = ranged.withColumn(column, here).join(F.broadcast(offsets), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_range") == F.col("_part")), "left")
    return out.withColumn(column, (F.col(column) + F.coalesce("_before", F.lit(0))).cast("int")).drop("_range", "_doc", "_part", "_before")


def walk(nodes: DataFrame, visitor: Callable[..., Column] | None = None, *args, **kwargs) -> DataFrame:
    """nodes with preorder, from 1 in each document; and, where a visitor is given, with visited: what it makes of each
    node. A visitor takes (attribute names, child names, *args) as columns and gives a column over the node's own."""
    out = numbered(nodes, "preorder", "path")
    if visitor is None:
        return out
    shapes = shape(nodes).select("doc_id", "node_id", F.col("attributes").alias("_attributes"), F.col("children").alias("_children"))
    both = out.join(shapes, ["doc_id", "node_id"])
    return both.withColumn("visited", visitor(F.col("_attributes"), F.col("_children"), *args, **kwargs)).drop("_attributes", "_children")


def visit_rows(nodes: DataFrame, visitor: Callable, schema: str) -> DataFrame:
    """What a Python visitor makes of the nodes: it takes and gives iterators of Arrow batches, in no stated order. For
    what column expressions can't say."""
    return nodes.mapInArrow(visitor, schema)


def with_paths(nodes: DataFrame, limit: int = 100) -> DataFrame:
    """doc_id, node_id, depth and path of nodes that have only doc_id, node_id, parent_id and ord, by a recursive query
    (one join for each level; a deeper tree than `limit` is an error). Shredded nodes have their path already."""
    return nodes.sparkSession.sql(
        f"""
        WITH RECURSIVE w(doc_id, node_id, depth, path) MAX RECURSION LEVEL {limit} AS (
            SELECT doc_id, node_id, 0, concat('/', lpad(CAST(ord AS STRING), {WIDTH}, '0')) FROM {{nodes}} WHERE parent_id IS NULL
            UNION ALL
            SELECT n.doc_id, n.node_id, w.depth + 1, concat(w.path, '/', lpad(CAST(n.ord AS STRING), {WIDTH}, '0'))
            FROM {{nodes}} n JOIN w ON n.doc_id = w.doc_id AND n.parent_id = w.node_id)
        SELECT * FROM w""",
        nodes=nodes,
    )


def layer(nodes: DataFrame) -> DataFrame:
    """nodes with layer, the depth counted from 1."""
    return nodes.withColumn("layer", F.col("depth") + 1)


def elements_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """Descendants of that name with rank: by the preorder of their parent, then by their place. The root isn't one."""
    found = nodes.where((F.col("name") == name) & (F.col("depth") > 0)).withColumn("_parent", parent_path(F.col("path")))
    return numbered(found, "rank", "_parent", "ord").drop("_parent")


def all_sub_elements(nodes: DataFrame) -> DataFrame:
    """doc_id, name, ids: the descendants of each document by name, in preorder."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("path", "node_id"))), lambda x: x["node_id"])
    return nodes.where("depth > 0").groupBy("doc_id", "name").agg(ids.alias("ids"))


def instances_by_type(nodes: DataFrame, type_name: Column) -> DataFrame:
    """doc_id, type_name, ids: all nodes by their type, the root too, in preorder."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("path", "node_id"))), lambda x: x["node_id"])
    return nodes.withColumn("type_name", type_name).groupBy("doc_id", "type_name").agg(ids.alias("ids"))


def find_first(nodes: DataFrame, name: str) -> DataFrame:
    """doc_id, node_id of the first node of that name in preorder, the root included; no row without one."""
    return nodes.where(F.col("name") == name).groupBy("doc_id").agg(F.min_by("node_id", "path").alias("node_id"))


def find_all(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of that name with rank in preorder, the root included."""
    return numbered(nodes.where(F.col("name") == name), "rank", "path")


def below(nodes: DataFrame, base: DataFrame) -> DataFrame:
    """Nodes of base's nodes (doc_id, path) and below, with base_path."""
    b = base.select(F.col("doc_id").alias("_doc"), F.col("path").alias("base_path"))
    inside = (F.col("path") == F.col("base_path")) | F.col("path").startswith(F.concat("base_path", F.lit("/")))
    return nodes.join(b, (F.col("doc_id") == F.col("_doc")) & inside).drop("_doc")


def shape(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, attributes (sorted names) and children (names in order) of each node."""
    children = nodes.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("children"))
    none = F.array().cast("array<string>")
    return nodes.select("doc_id", "node_id", F.array_sort(F.map_keys("attribs")).alias("attributes")).join(children, ["doc_id", "node_id"], "left").withColumn("children", F.coalesce("children", none))


def make_elem(name: Column | str) -> Column:
    """A new node without attributes, children or value."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), F.create_map().cast("map<string,string>").alias("attribs"), F.array().cast("array<string>").alias("children"), F.lit(None).cast("array<string>").alias("value"))


def make_comment(text: Column) -> Column:
    """A new comment node."""
    return make_elem(COMMENT).withField("value", F.array(text))
