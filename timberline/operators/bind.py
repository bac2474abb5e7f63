"""Binding nodes to a schema: types, attributes, elements, values.

The catalog meets the rows as map and array literals, so binding a node is row-local: its type follows from the names
on its way from the root, which the node carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions import xsdtypes
from timberline.sources.xsd import Catalog


def literal_map(pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v) for v in pairs.values()]))


def literal_lists(pairs: dict[str, list[str]]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in pairs.values()])) if pairs else F.create_map().cast("map<string,array<string>>")


def child_types(catalog: Catalog) -> dict[str, str]:
    """'parent type/element name' -> type, the roots below 'schema'."""
    out = {f"schema/{e.name}": e.type or "xs:string" for e in catalog.roots}
    for t in catalog.types:
        out |= {f"{t}/{e.name}": e.type or "xs:string" for e in catalog.elements(t)}
    return out


def type_of(names: Column, catalog: Catalog) -> Column:
    """The schema type of the element reached by these names from the root; null where it isn't declared."""
    table = literal_map(child_types(catalog))
    return F.aggregate(names, F.lit("schema"), lambda t, n: F.try_element_at(table, F.concat(t, F.lit("/"), n)))


def resolve(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """nodes with type_name."""
    return nodes.withColumn("type_name", type_of(F.col("names"), catalog))


def resolve_types(catalog: Catalog, spark) -> DataFrame:
    """parent, name, type, resolved (builtin, schema or null) and code (unknown_type or unsupported_type) of every
    declared element: a left join of elements and types."""
    f = catalog.frames(spark)
    builtins = spark.createDataFrame([(f"xs:{b}", "builtin") for b in xsdtypes.BUILTINS], "type string, resolved string")
    known = f["xsd_types"].select(F.col("name").alias("type"), F.lit("schema").alias("resolved")).unionByName(builtins)
    code = F.when(F.col("resolved").isNull(), F.when(F.col("type").startswith("xs:"), "unsupported_type").otherwise("unknown_type"))
    return f["xsd_elements"].select("parent", "name", "type").join(known, "type", "left").withColumn("code", code)


def bind_root(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """doc_id, node_id, name, type_name and code (null, root_mismatch, multiple_roots) of each document's root: the one
    top-level element that the schema declares first."""
    first = catalog.roots[0]
    roots = nodes.where("depth = 0").withColumn("roots", F.count("*").over(W.partitionBy("doc_id"))).where("ord = 0 OR roots = 1")
    good = F.col("name") == first.name
    return roots.select("doc_id", "node_id", "name", F.when(good, F.lit(first.type)).alias("type_name"), F.when(F.col("roots") > 1, "multiple_roots").when(~good, "root_mismatch").alias("code"))


def declared(type_name: Column, catalog: Catalog) -> Column:
    """Names of a type's attributes, inherited ones too; empty for unknown types."""
    return F.coalesce(F.try_element_at(literal_lists({t: list(catalog.attributes(t)) for t in catalog.types}), type_name), F.array().cast("array<string>"))


def is_passed(name: Column) -> Column:
    """Namespace declarations and xsi: attributes go through undeclared."""
    return F.contains(name, F.lit("xmlns")) | F.contains(name, F.lit("xsi:")) | F.contains(name, F.lit("XMLSchema-instance"))


def bind_attributes(attribs: Column, type_name: Column, catalog: Catalog) -> Column:
    """The declared attributes, and namespace ones."""
    names = declared(type_name, catalog)
    return F.map_filter(attribs, lambda k, v: F.array_contains(names, k) | is_passed(k))


def attribute_or_default(attribs: Column, type_name: str, name: str, catalog: Catalog) -> Column:
    """A typed attribute: its value, else its default."""
    a = catalog.attributes(type_name)[name]
    raw = F.coalesce(F.try_element_at(attribs, F.lit(name)), F.lit(a.default))
    return xsdtypes.typed(raw, catalog.builtin(a.type) or "string")


def inherited_attributes(catalog: Catalog, spark) -> DataFrame:
    """type_name, name, type, use, default, from_type and distance of all attributes of every type; the nearest
    definition wins (row_number over the closure of bases)."""
    closure = [(t, b.name, i) for t in catalog.types for i, b in enumerate(catalog.lineage(t))]
    up = spark.createDataFrame(closure, "type_name string, from_type string, distance int")
    own = catalog.frames(spark)["xsd_attributes"].withColumnRenamed("type_name", "from_type")
    nearest = F.row_number().over(W.partitionBy("type_name", "name").orderBy("distance"))
    return up.join(own, "from_type").withColumn("n", nearest).where("n = 1").select("type_name", "name", "type", "use", "default", "from_type", "distance")


def bind_elements(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """Declared children of each parent with decl_ord and bound_ord: in the order of the schema, then of the document.
    Undeclared ones aren't in it. nodes: resolved."""
    order = {f"{t}/{e.name}": str(i) for t in catalog.types for i, e in reversed(list(enumerate(catalog.elements(t))))}
    parent = type_of(F.slice("names", 1, F.size("names") - 1), catalog)
    rows = nodes.where("depth > 0").withColumn("decl_ord", F.try_element_at(literal_map(order), F.concat(parent, F.lit("/"), F.col("name"))).cast("int")).where("decl_ord IS NOT NULL")
    return rows.withColumn("bound_ord", F.row_number().over(W.partitionBy("doc_id", "parent_id").orderBy("decl_ord", "ord")))


def primitive(value: Column, attribs: Column, builtin: str, child: Column | None = None) -> Column:
    """The value of an element of built-in type: its text, else its single attribute, else the text of its single child
    (`child`: the texts of its children, one for each), else true for nothing at all; null where none of these is told."""
    values = F.map_values(attribs)
    children = F.array().cast("array<string>") if child is None else child
    text = (
        F.when(F.size(value) > 0, F.array_join(value, " ")).when(F.size(values) == 1, F.element_at(values, 1))
        .when(F.size(children) == 1, F.element_at(children, 1)).when((F.size(values) == 0) & (F.size(children) == 0), F.lit("true"))
    )
    return xsdtypes.typed(text, builtin)


def bind_primitives(nodes: DataFrame, builtin: str) -> DataFrame:
    """nodes with typed: each one's value as a built-in type, by primitive(); its children are looked up."""
    texts = nodes.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id"))
    # what counts is whether there is one child: a parent's children aren't gathered
    one = texts.agg(F.count("*").alias("_n"), F.max(F.array_join("value", " ")).alias("_text"))
    both = nodes.join(one, ["doc_id", "node_id"], "left")
    child = F.when(F.col("_n") == 1, F.array("_text")).when(F.col("_n") > 1, F.array(F.lit(None), F.lit(None))).otherwise(F.array()).cast("array<string>")
    return both.withColumn("typed", primitive(F.col("value"), F.col("attribs"), builtin, child)).drop("_n", "_text")
