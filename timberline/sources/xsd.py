"""XSD documents compiled, on the driver, into a catalog: types, elements, attributes, facets, and Spark schemas.

A schema is small and read whole; what grows with the data is the documents, and they only meet the catalog as
literals in column expressions.
"""

from __future__ import annotations

import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from timberline.functions.xsdtypes import BUILTINS, SPARK_TYPES

#: Tags that the compiler knows. Others are reported and dropped with what is in them.
TAGS = set(
    "schema element attribute attributeGroup complexType simpleType sequence choice complexContent simpleContent extension restriction list enumeration pattern length "
    "minInclusive maxInclusive minExclusive maxExclusive annotation documentation".split()
)
#: What maxOccurs="unbounded" stands for.
UNBOUNDED = 99999
#: Tags that are named by their own name attribute; others get one from their tag and place.
NAMED = {"schema", "element", "attribute", "attributeGroup", "complexType", "simpleType"}


@dataclass(frozen=True)
class Element:
    name: str
    type: str | None
    min_occurs: int = 1
    max_occurs: int = 1
    default: str | None = None
    group: int = 0

    @property
    def is_list(self) -> bool:
        return self.max_occurs > 1


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str | None
    use: str = "optional"
    default: str | None = None


@dataclass(frozen=True)
class Group:
    kind: str  # sequence or choice
    min_occurs: int = 1
    max_occurs: int = 1


@dataclass
class Facets:
    enumeration: list[str] = field(default_factory=list)
    pattern: list[str] = field(default_factory=list)
    length: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_exclusive: float | None = None
    max_exclusive: float | None = None

    def __bool__(self) -> bool:
        return self != Facets()


@dataclass
class Type:
    name: str
    kind: str  # complex or simple
    base: str | None = None
    derivation: str | None = None
    elements: list[Element] = field(default_factory=list)
    attributes: dict[str, Attribute] = field(default_factory=dict)
    groups: list[Group] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    facets: Facets = field(default_factory=Facets)
    item_type: str | None = None
    doc: str | None = None


class Catalog:
    """Compiled schema: types by name, top-level elements in order, and the errors met while compiling."""

    def __init__(self) -> None:
        self.types: dict[str, Type] = {}
        self.roots: list[Element] = []
        self.groups: dict[str, dict[str, Attribute]] = {}
        self.errors: list[tuple[str, str, str]] = []
        self.nodes: list[tuple[int, int | None, str, str | None, dict[str, str]]] = []

    # ---- inheritance

    def lineage(self, name: str | None) -> list[Type]:
        """A type and the types it derives from, nearest first; a cycle ends it."""
        out: list[Type] = []
        while name in self.types and self.types[name] not in out:
            out.append(self.types[name])
            name = out[-1].base
        return out

    def attributes(self, name: str | None) -> dict[str, Attribute]:
        """Own and inherited attributes, attribute groups expanded; the nearest definition wins."""
        out: dict[str, Attribute] = {}
        for t in self.lineage(name):
            for group in ({**t.attributes}, *(self.groups.get(r, {}) for r in t.refs)):
                out = {**group, **out}
        return out

    def elements(self, name: str | None) -> list[Element]:
        """Elements of the base first where the type extends it, then its own; groups are numbered through."""
        t = self.types.get(name)
        if t is None:
            return []
        own, base = t.elements, self.elements(t.base) if t.derivation == "extension" and t.base != name else []
        shift = len(self.group_list(t.base)) if base else 0
        return base + [replace(e, group=e.group + shift) for e in own]

    def group_list(self, name: str | None) -> list[Group]:
        t = self.types.get(name)
        if t is None:
            return []
        return (self.group_list(t.base) if t.derivation == "extension" and t.base != name and self.elements(t.base) else []) + t.groups

    def builtin(self, name: str | None) -> str | None:
        """The built-in type below a simple type, or type with simple content; None for complex and unknown types."""
        while name in self.types:
            if self.types[name].item_type:
                return "string"
            name = self.types[name].base
        return name[3:] if name and name.startswith("xs:") and name[3:] in BUILTINS else None

    def is_simple(self, name: str | None) -> bool:
        return self.builtin(name) is not None and not self.elements(name)

    def facet_list(self, name: str | None) -> list[Facets]:
        return [t.facets for t in self.lineage(name) if t.facets]

    # ---- Spark types

    def struct(self, name: str, seen: tuple[str, ...] = ()) -> T.DataType:
        """The Spark type of a schema type: attributes as _name, elements by name, the text of simple content as
        _VALUE. A type inside itself, and what isn't known, is a string."""
        if name in seen:
            return T.StringType()
        attrs, elements, plain = self.attributes(name), self.elements(name), self.builtin(name)
        if name.startswith("xs:") or (self.types.get(name) and self.types[name].kind == "simple"):
            if name in self.types and self.types[name].item_type:
                return T.StringType()
            return SPARK_TYPES.get(plain or "", T.StringType())
        if name not in self.types:
            return T.StringType()
        fields = [T.StructField(f"_{a.name}", SPARK_TYPES.get(self.builtin(a.type) or "", T.StringType()), a.use != "required") for a in attrs.values()]
        for e in elements:
            kind = self.struct(e.type or "xs:string", (*seen, name))
            fields.append(T.StructField(e.name, T.ArrayType(kind) if e.is_list else kind, True))
        if not elements and plain:
            fields.append(T.StructField("_VALUE", SPARK_TYPES[plain], True))
        return T.StructType(fields)

    # ---- navigation

    def navigation(self) -> list[tuple[int, str, str, int, bool, str | None]]:
        """(id, tag, name, layer, top_level, containing_type) of the schema's nodes: layer 1 is the schema itself, its
        children are at the top, and the containing type is the name of the nearest type or attribute group, which are
        their own."""
        layer: dict[int | None, int] = {None: 0}
        inside: dict[int | None, str | None] = {None: None}
        out = []
        for i, parent, tag, name, _ in self.nodes:  # a parent comes before its children
            layer[i] = layer[parent] + 1
            inside[i] = name if tag in ("complexType", "simpleType", "attributeGroup") else inside[parent]
            out.append((i, tag, name, layer[i], layer[i] == 2, inside[i]))
        return out

    def describe(self) -> str:
        """The catalog for a reader: a line for each node of the schema, indented by its layer, then its errors."""
        attrs = {i: a for i, _, _, _, a in self.nodes}
        lines = []
        for i, tag, name, layer, _, _ in self.navigation():
            rest = "".join(f" {k}={v}" for k, v in attrs[i].items() if k != "name")
            lines.append("  " * (layer - 1) + f"{tag}[{name}]{rest}")
        return "\n".join(lines + [f"{code}: {name}: {detail}" for code, name, detail in self.errors])

    # ---- tables

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The catalog as tables: xsd_nodes, xsd_navigation, xsd_types, xsd_elements, xsd_attributes, xsd_facets."""
        types = [(t.name, t.kind, t.base, t.derivation, t.item_type, t.doc) for t in self.types.values()]
        elements = [(o, i, e.name, e.type, e.min_occurs, None if e.max_occurs >= UNBOUNDED else e.max_occurs, e.default, e.group) for o, es in self._owners() for i, e in enumerate(es)]
        attrs = [(t, a.name, a.type, a.use, a.default) for t in self.types for a in self.types[t].attributes.values()]
        facets = []
        for t in self.types.values():
            f = t.facets
            facets += [(t.name, "enumeration", v) for v in f.enumeration] + [(t.name, "pattern", v) for v in f.pattern]
            facets += [(t.name, k, str(getattr(f, a))) for k, a in BOUNDS.items() if getattr(f, a) is not None]
        make = spark.createDataFrame
        return {
            "xsd_nodes": make(self.nodes, "id int, parent_id int, tag string, name string, attrs map<string,string>"),
            "xsd_navigation": make(self.navigation(), "id int, tag string, name string, layer int, top_level boolean, containing_type string"),
            "xsd_types": make(types, "name string, kind string, base string, derivation string, item_type string, doc string"),
            "xsd_elements": make(elements, "parent string, decl_ord int, name string, type string, min_occurs int, max_occurs int, `default` string, grp int"),
            "xsd_attributes": make(attrs, "type_name string, name string, type string, `use` string, `default` string"),
            "xsd_facets": make(facets, "type_name string, facet string, value string"),
        }

    def _owners(self):
        return [("schema", self.roots), *((n, t.elements) for n, t in self.types.items())]

    # ---- overlays

    def overlaid(self, types: dict[str, Type]) -> Catalog:
        """A catalog in which these types are added or take the place of types of their name."""
        out = Catalog()
        out.roots, out.groups, out.errors, out.nodes = self.roots, self.groups, self.errors, self.nodes
        out.types = {**self.types, **types}
        return out


#: XSD name of a facet with one value, and its field.
BOUNDS = {"length": "length", "minInclusive": "min_inclusive", "maxInclusive": "max_inclusive", "minExclusive": "min_exclusive", "maxExclusive": "max_exclusive"}


def occurs(attrs: dict[str, str], key: str) -> int:
    """minOccurs or maxOccurs: 1 by default, UNBOUNDED for unbounded; text that is no number counts as the default."""
    value = attrs.get(key, "1").strip()
    if value == "unbounded":
        return UNBOUNDED
    try:
        return int(value)
    except ValueError:
        return 1


class _Compiler:
    def __init__(self) -> None:
        self.out = Catalog()
        self.count: Counter[str] = Counter()

    def record(self, node: ET.Element, parent: int | None, owner: str | None) -> int:
        tag = local(node.tag)
        self.count[f"{owner}|{tag}" if owner else tag] += 1
        name = node.get("name")
        if name is None and tag not in NAMED:
            n = self.count[f"{owner}|{tag}" if owner else tag]
            name = f"{tag}{n}" if tag in ("sequence", "choice") else f"{owner}|{tag}|{n}"
        elif name is None:
            name = f"{owner}|{tag}" if owner else tag
        self.out.nodes.append((len(self.out.nodes), parent, tag, name, dict(node.attrib)))
        return len(self.out.nodes) - 1

    def children(self, node: ET.Element):
        for child in node:
            if local(child.tag) in TAGS:
                yield local(child.tag), child
            else:
                self.out.errors.append(("unsupported_tag", local(child.tag), "the tag isn't known; it is dropped with what is in it"))

    def schema(self, root: ET.Element) -> Catalog:
        top = self.record(root, None, None)
        for tag, node in self.children(root):
            if tag == "element":
                self.out.roots.append(self.element(node, top, "schema", 0))
            elif tag in ("complexType", "simpleType"):
                self.type(node, top, node.get("name") or tag)
            elif tag == "attributeGroup":
                self.attribute_group(node, top)
            else:
                self.record(node, top, "schema")
        for owner, elements in self.out._owners():
            for e in elements:
                self.check(owner, e.name, e.type)
        for t in self.out.types.values():
            for a in t.attributes.values():
                self.check(t.name, a.name, a.type)
        return self.out

    def check(self, owner: str, name: str, kind: str | None) -> None:
        if kind is None or kind in self.out.types:
            return
        if kind.startswith("xs:"):
            if kind[3:] not in BUILTINS:
                self.out.errors.append(("unsupported_type", name, kind))
        else:
            self.out.errors.append(("unknown_type", name, kind))

    def element(self, node: ET.Element, parent: int, owner: str, group: int) -> Element:
        at = self.record(node, parent, owner)
        name, kind = node.get("name") or "", node.get("type")
        for tag, child in self.children(node):
            if tag in ("complexType", "simpleType"):  # an annotation doesn't type the element
                kind = self.type(child, at, child.get("name") or f"{name}|{tag}")
            else:
                self.record(child, at, name)
        return Element(name, kind or "xs:string", occurs(node.attrib, "minOccurs"), occurs(node.attrib, "maxOccurs"), node.get("default"), group)

    def attribute(self, node: ET.Element, parent: int, owner: str) -> Attribute:
        at = self.record(node, parent, owner)
        name, kind = node.get("name") or "", node.get("type")
        for tag, child in self.children(node):
            if tag == "simpleType":
                kind = self.type(child, at, child.get("name") or f"{name}|{tag}")
        return Attribute(name, kind or "xs:string", node.get("use", "optional"), node.get("default"))

    def attribute_group(self, node: ET.Element, parent: int) -> None:
        at = self.record(node, parent, "schema")
        self.out.groups.setdefault(node.get("name") or "", {a.name: a for tag, c in self.children(node) if tag == "attribute" for a in [self.attribute(c, at, node.get("name") or "")]})

    def type(self, node: ET.Element, parent: int, name: str) -> str:
        """Compiles a type once; of several types of one name the first stays."""
        t = Type(name, "complex" if local(node.tag) == "complexType" else "simple")
        self.body(node, self.record(node, parent, name), t)
        self.out.types.setdefault(name, t)
        return name

    def body(self, node: ET.Element, at: int, t: Type) -> None:
        for tag, child in self.children(node):
            if tag == "attribute":
                a = self.attribute(child, at, t.name)
                t.attributes.setdefault(a.name, a)
            elif tag in ("sequence", "choice"):
                self.group(child, at, t)
            elif tag == "attributeGroup":
                self.record(child, at, t.name)
                t.refs.append(child.get("ref") or child.get("name") or "")
            elif tag in ("extension", "restriction"):
                t.base, t.derivation = child.get("base"), tag
                self.body(child, self.record(child, at, t.name), t)
            elif tag == "list":
                self.record(child, at, t.name)
                t.item_type = child.get("itemType")
            elif tag in ("enumeration", "pattern"):
                self.record(child, at, t.name)
                getattr(t.facets, tag).append(child.get("value", ""))
            elif tag in BOUNDS:
                self.record(child, at, t.name)
                setattr(t.facets, BOUNDS[tag], int(child.get("value", "0")) if tag == "length" else float(child.get("value", "0")))
            elif tag == "documentation":
                self.record(child, at, t.name)
                t.doc = (child.text or "").strip() or None
            elif tag in ("annotation", "complexContent", "simpleContent", "complexType", "simpleType"):
                self.body(child, self.record(child, at, t.name), t)
            elif tag == "element":
                t.elements.append(self.element(child, at, t.name, 0))

    def group(self, node: ET.Element, parent: int, t: Type) -> None:
        """Nested groups are flattened in document order; every element keeps the number of its group."""
        at = self.record(node, parent, t.name)
        number = len(t.groups)
        t.groups.append(Group(local(node.tag), occurs(node.attrib, "minOccurs"), occurs(node.attrib, "maxOccurs")))
        for tag, child in self.children(node):
            if tag == "element":
                t.elements.append(self.element(child, at, t.name, number))
            elif tag in ("sequence", "choice"):
                self.group(child, at, t)
            else:
                self.record(child, at, t.name)


def local(tag: str) -> str:
    return tag.split("}")[-1]


def compile_xsd(text: str) -> Catalog:
    """The catalog of a schema document. Text that isn't XML gives an empty catalog with the error malformed_schema."""
    try:
        return _Compiler().schema(ET.fromstring(text))
    except ET.ParseError as e:
        return _failed("malformed_schema", "", e)


def _failed(code: str, name: str, why: Exception) -> Catalog:
    out = Catalog()
    out.errors.append((code, name, str(why).splitlines()[0]))
    return out


def read_xsd(spark: SparkSession, path: str) -> Catalog:
    """The catalog of the schema at a path that Spark can read, or at a http(s) or ftp URL, which the driver fetches.
    What can't be read gives an empty catalog with the error schema_unreachable."""
    try:
        if not path.startswith(("http://", "https://", "ftp://")):
            return compile_xsd(spark.read.text(path, wholetext=True).first()[0])
        with urllib.request.urlopen(path, timeout=60) as f:
            return compile_xsd(f.read().decode())
    except (urllib.error.URLError, OSError, AnalysisException) as e:
        return _failed("schema_unreachable", path, e)
