"""Validation: every violation is a row (doc_id, node_id, code, name, type, detail); nothing is fatal."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import xsdtypes
from timberline.operators.bind import declared, is_passed, literal_lists, literal_map, resolve, type_of
from timberline.sources.xml import COMMENT
from timberline.sources.xsd import UNBOUNDED, Catalog, Element

ERROR_COLUMNS = ["doc_id", "node_id", "code", "name", "type", "detail"]


# ---- order and number of children


def names_of_children(nodes: DataFrame) -> DataFrame:
    """doc_id, parent_id and ks, the names of a parent's children in order, each with a semicolon behind it."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: F.concat(x["name"], F.lit(";")))
    return nodes.where((F.col("name") != COMMENT) & F.col("parent_id").isNotNull()).groupBy("doc_id", "parent_id").agg(F.array_join(ordered, "").alias("ks"))


def runs_pattern(names: list[str]) -> str:
    return "^" + "".join(f"((?:{re.escape(n)};)*)" for n in names)


def run_counts(ks: Column, names: list[str]) -> Column:
    """How many children each declared name takes from the front of what the names before it left. The groups are stars
    over fixed delimited names, so one regular expression gives them all."""
    p = runs_pattern(names)
    return F.array(*[(F.length(F.regexp_extract(ks, p, i + 1)) / (len(n) + 1)).cast("int") for i, n in enumerate(names)])


def sequence_errors(ks: Column, elements: list[Element]) -> Column:
    """array<struct<code,name,detail>>: a name that takes no child is an order error, unless it may be absent and
    doesn't come later; else fewer than minOccurs and more than maxOccurs are errors."""
    names = [e.name for e in elements]
    counts = run_counts(ks, names)
    out = []
    for i, e in enumerate(elements):
        n = F.element_at(counts, i + 1)
        rest = F.concat(F.lit(";"), F.regexp_replace(ks, runs_pattern(names[: i + 1]), ""))
        later = F.contains(rest, F.lit(f";{e.name};"))
        order = (n == 0) & (later if e.min_occurs == 0 else F.lit(True))
        code = F.when(order, "order_error").when((n > 0) & (n < e.min_occurs), "min_occurs").when((n > e.max_occurs) & (n > 0), "max_occurs")
        out.append(F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(e.name).alias("name"), n.cast("string").alias("detail"))))
    return F.array_compact(F.array(*out))


def choice_error(count: Column, min_occurs: int, max_occurs: int) -> Column:
    """choice_none below, choice_too_many above the choice's own bounds; a negative bound counts as 1."""
    low, high = (1 if b < 0 else b for b in (min_occurs, max_occurs))
    return F.when(count < low, "choice_none").when(count > high, "choice_too_many")


def occurs_bounds(low: Column, high: Column) -> Column:
    """struct(min_occurs, max_occurs, is_list): 1 by default, unbounded a null maximum."""
    most = F.when(high == "unbounded", F.lit(None)).otherwise(F.coalesce(high.try_cast("int"), F.lit(1)))
    return F.struct(F.coalesce(low.try_cast("int"), F.lit(1)).alias("min_occurs"), most.alias("max_occurs"), (F.coalesce(most, F.lit(UNBOUNDED)) > 1).alias("is_list"))


def structure_errors(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """Order, occurs and choice errors of all parents; each group of a type by its own rule. nodes: resolved."""
    complex_types = [t for t in catalog.types if catalog.elements(t)]
    parents = nodes.where(F.col("type_name").isin(complex_types)).select("doc_id", "node_id", "type_name")
    kids = names_of_children(nodes)
    both = parents.join(kids.withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left").withColumn("ks", F.coalesce("ks", F.lit("")))
    found = F.array().cast("array<struct<code:string,name:string,detail:string>>")
    for t in complex_types:
        elements, groups = catalog.elements(t), catalog.group_list(t)
        kind = lambda e: groups[e.group].kind if e.group < len(groups) else "sequence"  # noqa: B023, E731
        in_sequence = [e for e in elements if kind(e) == "sequence"]
        errors = []
        if in_sequence:
            drop = [re.escape(e.name) for e in elements if kind(e) == "choice"]
            ks = F.regexp_replace("ks", "(?<=^|;)(?:" + "|".join(drop) + ");", "") if drop else F.col("ks")
            errors.append(sequence_errors(ks, in_sequence))
        for g, group in enumerate(groups):
            names = [e.name for e in elements if e.group == g]
            if group.kind == "choice" and names:
                n = F.size(F.filter(F.split("ks", ";"), lambda x: x.isin(names)))  # noqa: B023
                code = choice_error(n, group.min_occurs, group.max_occurs)
                errors.append(F.array_compact(F.array(F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit("|".join(names)).alias("name"), n.cast("string").alias("detail"))))))
                bad = [c for c, b in (("bad_min_occurs", group.min_occurs), ("bad_max_occurs", group.max_occurs)) if b < 0]
                errors += [F.array(F.struct(F.lit(c).alias("code"), F.lit("|".join(names)).alias("name"), F.lit("").alias("detail"))) for c in bad]
        if errors:
            found = F.when(F.col("type_name") == t, F.concat(*errors)).otherwise(found)
    return both.select("doc_id", "node_id", F.col("type_name").alias("type"), F.explode(found).alias("e")).select("doc_id", "node_id", "e.code", "e.name", "type", "e.detail")


# ---- attributes


def undeclared_attributes(attribs: Column, names: Column) -> Column:
    return F.filter(F.array_except(F.map_keys(attribs), names), lambda k: ~is_passed(k))


def missing_attributes(attribs: Column, required: Column) -> Column:
    return F.array_except(required, F.map_keys(attribs))


def attribute_errors(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """attribute_undeclared, attribute_required, attribute_invalid and facet errors, row by row. nodes: resolved."""
    none = F.array().cast("array<struct<code:string,name:string,detail:string>>")
    item = lambda code, k, d: F.struct(F.lit(code).alias("code"), k.alias("name"), d.alias("detail"))
    typed = F.col("type_name").isNotNull()
    required = F.coalesce(F.try_element_at(literal_lists({t: [a.name for a in catalog.attributes(t).values() if a.use == "required"] for t in catalog.types}), F.col("type_name")), F.array().cast("array<string>"))
    get = lambda k: F.try_element_at(F.col("attribs"), k)
    extra = F.transform(undeclared_attributes(F.col("attribs"), declared(F.col("type_name"), catalog)), lambda k: item("attribute_undeclared", k, F.coalesce(get(k), F.lit(""))))
    missing = F.transform(missing_attributes(F.col("attribs"), required), lambda k: item("attribute_required", k, F.lit("")))
    wrong = none
    for t in catalog.types:
        checks = []
        for a in catalog.attributes(t).values():
            value = F.try_element_at(F.col("attribs"), F.lit(a.name))
            bad = value_errors(value, a.type, catalog, "attribute_invalid")
            checks.append(_named(bad, a.name, value))
        if checks:
            wrong = F.when(F.col("type_name") == t, F.concat(*checks)).otherwise(wrong)
    rows = nodes.where(typed).select("doc_id", "node_id", F.col("type_name").alias("type"), F.explode(F.concat(extra, missing, wrong)).alias("e"))
    return rows.select("doc_id", "node_id", "e.code", "e.name", "type", "e.detail")


def _named(codes: Column, name: str, value: Column) -> Column:
    return F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit(name).alias("name"), value.alias("detail")))


# ---- values


def value_errors(value: Column, type_name: str | None, catalog: Catalog, code: str) -> Column:
    """array<string> of codes that a text earns as a value of a type: `code`, facet_*; none for a null text."""
    t = catalog.types.get(type_name or "")
    builtin = catalog.builtin(type_name) or "string"
    out = [F.when(~xsdtypes.valid(value, builtin), F.lit(code))]
    if t is not None and t.item_type:
        item = catalog.builtin(t.item_type) or "string"
        out.append(F.when(~xsdtypes.list_valid(value, item), F.lit(code)))
    for f in catalog.facet_list(type_name):
        if f.enumeration:
            out.append(F.when(~xsdtypes.enumeration(value, f.enumeration), F.lit("facet_enumeration")))
        if f.pattern:
            out.append(F.when(~xsdtypes.pattern(value, f.pattern), F.lit("facet_pattern")))
        if f.length is not None:
            out.append(F.when(~xsdtypes.length(value, f.length), F.lit("facet_length")))
        limits = (f.min_inclusive, f.max_inclusive, f.min_exclusive, f.max_exclusive)
        if any(x is not None for x in limits):
            out.append(F.when(value.isNotNull() & ~xsdtypes.bounds(value, *limits), F.lit("facet_bounds")))
    return F.array_compact(F.array(*out))


def element_errors(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """element_undeclared, unreadable_data and facet errors of elements' texts. nodes: resolved."""
    parent = type_of(F.slice("names", 1, F.size("names") - 1), catalog)
    text = F.array_join("value", " ")
    codes = F.when(F.col("type_name").isNull() & (F.col("depth") > 0) & parent.isNotNull(), F.array(F.lit("element_undeclared"))).otherwise(F.array().cast("array<string>"))
    used = {e.type for _, es in catalog._owners() for e in es if e.type} | set(catalog.types)
    for t in sorted(x for x in used if catalog.is_simple(x)):
        codes = F.when(F.col("type_name") == t, value_errors(text, t, catalog, "unreadable_data")).otherwise(codes)
    rows = nodes.where((F.col("name") != COMMENT)).select("doc_id", "node_id", "name", F.coalesce("type_name", F.lit("")).alias("type"), F.coalesce(text, F.lit("")).alias("detail"), F.explode(codes).alias("code"))
    return rows.select(*ERROR_COLUMNS)


def root_errors(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """malformed_xml, no_root and multiple_roots of the shredder, and root_mismatch."""
    first = catalog.roots[0].name if catalog.roots else None
    code = F.coalesce("error", F.when((F.col("depth") == 0) & ~F.col("name").eqNullSafe(F.lit(first)), "root_mismatch"))
    return nodes.withColumn("code", code).where("code IS NOT NULL").select("doc_id", "node_id", "code", F.coalesce("name", F.lit("")).alias("name"), F.lit("").alias("type"), F.lit("").alias("detail"))


# ---- identifiers


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that stand in more than one row, with n."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(refs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of refs whose key no row of ids has; null keys aren't references."""
    return refs.where(F.col(key).isNotNull()).join(ids.select(key), key, "left_anti")


def identifier_errors(nodes: DataFrame, catalog: Catalog) -> DataFrame:
    """id_duplicate and idref_dangling within each document, for attributes of type xs:ID and xs:IDREF."""
    pick = lambda kind: literal_map({f"{t}/{a.name}": kind for t in catalog.types for a in catalog.attributes(t).values() if catalog.builtin(a.type) == kind})
    each = nodes.where("type_name IS NOT NULL").select("doc_id", "node_id", "type_name", F.explode("attribs").alias("name", "detail"))
    of = lambda kind: each.where(F.try_element_at(pick(kind), F.concat("type_name", F.lit("/"), F.col("name"))) == kind)
    again = duplicates(of("ID"), "doc_id", "detail")
    twice = of("ID").join(again.select("doc_id", "detail"), ["doc_id", "detail"], "left_semi").withColumn("code", F.lit("id_duplicate"))
    lost = of("IDREF").join(of("ID").select("doc_id", "detail"), ["doc_id", "detail"], "left_anti").withColumn("code", F.lit("idref_dangling"))
    return twice.unionByName(lost).select("doc_id", "node_id", "code", "name", F.col("type_name").alias("type"), "detail")


def catalog_errors(catalog: Catalog, spark: SparkSession) -> DataFrame:
    """The schema's own errors (unsupported_tag, unsupported_type, unknown_type, malformed_schema, schema_unreachable) as
    rows of no document."""
    rows = [(None, None, code, name or "", "", detail or "") for code, name, detail in catalog.errors]
    return spark.createDataFrame(rows, "doc_id long, node_id long, code string, name string, type string, detail string")


def validate(nodes: DataFrame, catalog: Catalog, schema_errors: bool = True) -> DataFrame:
    """All errors of a node table against a catalog, and the catalog's own. The checks read nodes several times: give
    written ones where making them is dear, as Engine.load() does."""
    typed = resolve(nodes.where("error IS NULL"), catalog)
    out = root_errors(nodes, catalog)
    for part in (structure_errors, attribute_errors, element_errors, identifier_errors):
        out = out.unionByName(part(typed, catalog))
    if schema_errors and catalog.errors:
        out = out.unionByName(catalog_errors(catalog, nodes.sparkSession))
    return out
