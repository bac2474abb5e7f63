"""XML output: tags, and whole documents from node tables."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import text as X
from timberline.sources.xml import COMMENT

#: Fixed value: the namespace of the prefix xml.
XML = "http://www.w3.org/XML/1998/namespace"
#: Blanks before a line: INDENT for each level, ATTRIBUTE more before an attribute, VALUE more before a value line.
INDENT, ATTRIBUTE, VALUE = 4, 7, 3


def escape(text: Column, quotes: bool = False) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def indent(depth: Column, more: int = 0) -> Column:
    return F.concat(F.repeat(F.lit(" " * INDENT), depth), F.lit(" " * more))


def attributes(attribs: Column, depth: Column) -> Column:
    """Attributes sorted by name, one on a line, names padded to the longest (and once more by the element's own
    indentation), then = "value"."""
    names = F.array_sort(F.map_keys(attribs))
    longest = F.coalesce(F.array_max(F.transform(names, lambda k: F.length(k))), F.lit(0))
    line = lambda k: F.concat(
        F.lit("\n"), indent(depth, ATTRIBUTE), k, F.repeat(F.lit(" "), depth * INDENT + longest + 1 - F.length(k)), F.lit('= "'), escape(F.coalesce(F.element_at(attribs, k), F.lit("")), True), F.lit('"')
    )
    return F.array_join(F.transform(names, line), "")


def writable(attribs: Column, depth: Column) -> Column:
    """Attributes under names that XML allows: a root's schema location under its xsi: name with the declarations it
    needs, xml: names with their prefix, others without their namespace. Where another attribute has that name already,
    one of a namespace keeps it behind a prefix ns1, ns2, ... that is declared beside it; what still is no name is left
    out (invalid_attributes() lists it)."""
    located = (depth == 0) & F.exists(F.map_keys(attribs), lambda k: k.startswith(f"{{{X.XSI}}}"))
    all_ = F.when(located, X.root_attributes(attribs)).otherwise(attribs)
    good = F.map_filter(all_, lambda k, v: _valid(_written(k)))
    names = F.array_sort(F.map_keys(good))
    written = F.transform(names, _written)
    spaced = lambda k: k.startswith("{") & ~k.startswith(f"{{{XML}}}")
    # the first of a name has it: a name without namespace sorts before {
    taken = lambda i: F.array_contains(F.slice(written, 1, i), F.element_at(written, i + 1)) & spaced(F.element_at(names, i + 1))
    entry = lambda i: F.when(
        taken(i),
        F.array(
            F.struct(F.concat(F.lit("ns"), (i + 1).cast("string"), F.lit(":"), F.element_at(written, i + 1)).alias("k"), F.element_at(good, F.element_at(names, i + 1)).alias("v")),
            F.struct(F.concat(F.lit("xmlns:ns"), (i + 1).cast("string")).alias("k"), F.regexp_extract(F.element_at(names, i + 1), r"^\{([^}]*)\}", 1).alias("v")),
        ),
    ).otherwise(F.array(F.struct(F.element_at(written, i + 1).alias("k"), F.element_at(good, F.element_at(names, i + 1)).alias("v"))))
    places = F.when(F.size(names) > 0, F.sequence(F.lit(0), F.size(names) - 1)).otherwise(F.array().cast("array<int>"))
    clash = F.size(F.array_distinct(written)) < F.size(written)
    return F.when(clash, F.map_from_entries(F.flatten(F.transform(places, entry)))).otherwise(F.transform_keys(good, lambda k, v: _written(k)))


def _written(k: Column) -> Column:
    return F.when(k.startswith(f"{{{XML}}}"), F.concat(F.lit("xml:"), X.local_name(k))).otherwise(X.local_name(k))


def _valid(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}_.-]*(:[\p{L}_][\p{L}\p{N}_.-]*)?$")


def invalid_attributes(nodes: DataFrame) -> DataFrame:
    """Error rows for the attributes that can't be written: their names are none in XML."""
    bad = F.filter(F.map_keys("attribs"), lambda k: ~_valid(_written(k)))
    return nodes.select("doc_id", "node_id", F.explode(bad).alias("name")).select("doc_id", "node_id", F.lit("attribute_unwritable").alias("code"), "name", F.lit("").alias("type"), F.lit("").alias("detail"))


def comment(text: Column) -> Column:
    return F.concat(F.lit("<!--"), text, F.lit("-->"))


def header(program: str = "timberline") -> Column:
    """The comment at the top of a file; without the time, so that output is reproducible."""
    return F.lit(f"<!--File created by {program}-->")


def open_tag(name: Column, attribs: Column, value: Column, has_children: Column, depth: Column) -> Column:
    """The start of an element with its value lines; closed at once if there is nothing in it."""
    lines = F.array_join(F.transform(value, lambda x: F.concat(indent(depth, VALUE), escape(x), F.lit("\n"))), "")
    end = F.concat(indent(depth), F.lit("</"), name, F.lit(">\n"))
    start = F.concat(indent(depth), F.lit("<"), name, attributes(attribs, depth))
    written = F.when(~has_children & value.isNull(), F.concat(start, F.lit("/>\n"))).otherwise(F.concat(start, F.lit(">\n"), F.coalesce(lines, F.lit("")), F.when(has_children, "").otherwise(end)))
    return F.when(name == COMMENT, F.concat(indent(depth), comment(F.array_join(value, "\n")), F.lit("\n"))).otherwise(written)


def close_tag(name: Column, depth: Column) -> Column:
    return F.concat(indent(depth), F.lit("</"), name, F.lit(">\n"))


def events(nodes: DataFrame) -> DataFrame:
    """doc_id, key, text: the start of each node and, for those with children, its end; key orders them in a document
    (an end sorts after everything below its node)."""
    parents = nodes.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    rows = nodes.join(parents, ["doc_id", "node_id"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    rows = rows.withColumn("attribs", writable(F.col("attribs"), F.col("depth")))  # a column of its own: the tag reads it several times
    start = F.struct(F.col("path").alias("key"), open_tag(F.col("name"), F.col("attribs"), F.col("value"), F.col("has_children"), F.col("depth")).alias("text"))
    end = F.struct(F.concat("path", F.lit("/~")).alias("key"), close_tag(F.col("name"), F.col("depth")).alias("text"))
    both = F.when(F.col("has_children"), F.array(start, end)).otherwise(F.array(start))
    return rows.where("node_id IS NOT NULL").select("doc_id", F.explode(both).alias("e")).select("doc_id", "e.key", "e.text")


def write_tree(nodes: DataFrame, head: Column | None = None) -> DataFrame:
    """doc_id and xml: each document as one text."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda e: e["text"]), "")
    out = events(nodes).groupBy("doc_id").agg(whole.alias("xml"))
    return out if head is None else out.withColumn("xml", F.concat(head, F.lit("\n"), "xml"))


def write_parts(nodes: DataFrame, path: str, head: Column | None = None, mode: str = "errorifexists") -> None:
    """Each document as a folder doc_id=... of text files that make it up in the order of their names: for documents that
    are too large for one string. Lines are dealt out by ranges of (document, place), so no task holds a document."""
    lines = events(nodes)
    if head is not None:
        roots = nodes.where("depth = 0").select("doc_id", F.lit("").alias("key"), F.concat(head, F.lit("\n")).alias("text"))
        lines = lines.unionByName(roots)
    lines = lines.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    lines.select("doc_id", F.regexp_replace("text", "\n$", "").alias("value")).write.mode(mode).partitionBy("doc_id").text(path)


def show_tree(nodes: DataFrame, out: TextIO | None = None) -> None:
    """Prints documents, to stdout unless told otherwise; the driver holds one partition of lines at a time."""
    for line in events(nodes).orderBy("doc_id", "key").select("text").toLocalIterator():
        (out or sys.stdout).write(line.text)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str = "ROWS", mode: str = "errorifexists") -> None:
    """Typed rows as XML files by Spark's writer."""
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).mode(mode).save(path)


def write_text(df: DataFrame, path: str, column: str = "xml", mode: str = "errorifexists") -> None:
    """One text column as text files: documents, or the lines of an export sorted by its other columns."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)
