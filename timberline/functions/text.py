"""Text functions of the XML tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of schema instance attributes.
XSI = "http://www.w3.org/2001/XMLSchema-instance"


def value_lines(text: Column) -> Column:
    """Lines of a text, trimmed, without blank ones; null for a text without any."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines)


def qualified_name(namespace: Column | str, name: Column) -> Column:
    """{namespace}name"""
    return F.concat(F.lit("{"), F.lit(namespace) if isinstance(namespace, str) else namespace, F.lit("}"), name)


def local_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\}"), -1)


def conversion(text: Column) -> Column:
    """struct(kind, value) of a text read as int, else float, else boolean, else string; value as text."""
    whole, number = F.trim(text), F.trim(text).try_cast("double")
    kind = F.when(whole.rlike(r"^[+-]?[0-9]+$"), "int").when(number.isNotNull(), "float").when(text.isin("true", "false"), "bool").when(text.isNotNull(), "string")
    return F.struct(kind.alias("kind"), text.alias("value"))


def schema_location(attribs: Column) -> Column:
    """struct(attribute, namespace, location, code) from a root's attributes.

    A schemaLocation that isn't a pair counts as noNamespaceSchemaLocation, with the code bad_schema_location; a root
    without either has nulls and the code no_schema_location.
    """
    pair, single = F.try_element_at(attribs, F.lit(f"{{{XSI}}}schemaLocation")), F.try_element_at(attribs, F.lit(f"{{{XSI}}}noNamespaceSchemaLocation"))
    parts = F.when(F.contains(pair, F.lit("\n")), F.split(pair, "\n")).otherwise(F.split(pair, " "))
    good = pair.isNotNull() & (F.size(parts) == 2)
    location = F.when(good, F.element_at(parts, 2)).otherwise(F.coalesce(pair, single))
    name = F.when(good, "schemaLocation").when(location.isNotNull(), "noNamespaceSchemaLocation")
    code = F.when(pair.isNotNull() & ~good, "bad_schema_location").when(location.isNull(), "no_schema_location")
    return F.struct(name.alias("attribute"), F.when(good, F.element_at(parts, 1)).alias("namespace"), location.alias("location"), code.alias("code"))


def root_attributes(attribs: Column) -> Column:
    """A root's attributes as they are written: the schema location under its xsi: name, and namespace declarations."""
    at = schema_location(attribs)
    rest = F.map_filter(attribs, lambda k, v: ~k.isin(f"{{{XSI}}}schemaLocation", f"{{{XSI}}}noNamespaceSchemaLocation"))
    xsi = F.create_map(F.lit("xmlns:xsi"), F.lit(XSI))
    spaced = F.create_map(F.lit("xsi:schemaLocation"), F.concat_ws(" ", at["namespace"], at["location"]), F.lit("xmlns"), at["namespace"], F.concat(F.lit("xmlns:"), F.lower(at["namespace"])), at["namespace"])
    plain = F.create_map(F.lit("xsi:noNamespaceSchemaLocation"), at["location"])
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(rest, xsi, F.when(at["namespace"].isNotNull(), spaced).when(at["location"].isNotNull(), plain).otherwise(none))


def default_name(path: Column, suffix: str) -> Column:
    """dir/stem + suffix + .xml of an input's path: suffix Parsed or Transformed."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    parts = F.split(name, r"\.")
    stem = F.when(F.size(parts) > 1, F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(name)
    return F.concat(folder, stem, F.lit(f"{suffix}.xml"))
