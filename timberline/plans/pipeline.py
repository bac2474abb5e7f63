"""Transform pipelines: parsed calls, folded over a node table."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.text import schema_location
from timberline.operators import lattice, writer
from timberline.operators.validate import root_errors, validate
from timberline.sources.shared import materialise
from timberline.sources.xml import documents, shred
from timberline.sources.xsd import Catalog, read_xsd

Transform = Callable[..., DataFrame]


@dataclass
class Call:
    name: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)


class BadCall(ValueError):
    """A text that is no call of literals: the code bad_transform_call."""


def split_chain(text: str) -> list[str]:
    """The calls of `A(..) > B(..)`, also one on a line; a > inside brackets or quotes doesn't separate."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in ">\n" and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def parse_call(text: str) -> Call:
    """Name(arguments); the arguments are literals and are never evaluated as code."""
    try:
        node = ast.parse(text.strip().rstrip(">").strip(), mode="eval").body
        if isinstance(node, ast.Name):
            return Call(node.id)
        if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
            raise BadCall(text)
        return Call(node.func.id, tuple(ast.literal_eval(a) for a in node.args), {k.arg: ast.literal_eval(k.value) for k in node.keywords if k.arg})
    except (SyntaxError, ValueError) as e:
        raise BadCall(text) from e


def parse_calls(calls: str | list[str]) -> list[Call]:
    """Calls of a chain, or of a list with one call in each entry; blank entries are skipped."""
    texts = split_chain(calls) if isinstance(calls, str) else [x for x in calls if x.strip(" \t\r\n>")]
    return [parse_call(t) for t in texts]


def read_calls(spark: SparkSession, path: str) -> list[Call]:
    """Calls of a file, one on each line."""
    return parse_calls([r.value for r in spark.read.text(path, wholetext=True).collect()][0].splitlines())


def call_errors(spark: SparkSession, calls: str | list[str], registry: dict | None = None) -> DataFrame:
    """step, code and text of the calls of a chain that can't be run: bad_transform_call (no call of literals) and
    unknown_transform."""
    texts = split_chain(calls) if isinstance(calls, str) else [x for x in calls if x.strip(" \t\r\n>")]
    rows = []
    for i, text in enumerate(texts):
        try:
            if parse_call(text).name not in (REGISTRY if registry is None else registry):
                rows.append((i, "unknown_transform", text))
        except BadCall:
            rows.append((i, "bad_transform_call", text))
    return spark.createDataFrame(rows, "step int, code string, text string")


class Registry(dict):
    """Transforms by name; each takes a node table and arguments and returns a node table."""

    def register(self, name: str, transform: Transform) -> None:
        self[name] = transform

    def run(self, nodes: DataFrame, calls: str | list[str] | list[Call]) -> DataFrame:
        """The calls in turn, the output of one being the input of the next.

        A transform reads its tree several times, so what goes from one to the next is written to the shared folder;
        else a chain of n would run its first step some power of n times.
        """
        parsed = calls if isinstance(calls, list) and all(isinstance(c, Call) for c in calls) else parse_calls(calls)
        unknown = [c.name for c in parsed if c.name not in self]
        if unknown:
            raise BadCall(f"unknown transforms: {', '.join(unknown)}")
        for i, c in enumerate(parsed):
            out = nodes.transform(self[c.name], *c.args, **c.kwargs)
            nodes = materialise(out, c.name) if out is not nodes and i < len(parsed) - 1 else out
        return nodes


def expand(nodes: DataFrame, n1: int, n2: int, n3: int) -> DataFrame:
    new, grown = lattice.expand_cell(lattice.atoms_of(nodes), lattice.lattice_of(nodes), n1, n2, n3)
    return lattice.rebuild_tree(nodes, new, grown)


def cut(nodes: DataFrame, radius: float, at: tuple | None = None) -> DataFrame:
    cell = lattice.lattice_of(nodes)
    return lattice.rebuild_tree(nodes, lattice.sphere_cutter(lattice.atoms_of(nodes), cell, radius, at), cell)


def print_data(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """A tap: writes the tree where a path is given and hands the nodes on."""
    if path is not None:
        writer.write_text(writer.write_tree(nodes), path, mode="overwrite")
    return nodes


def view_coordinates(nodes: DataFrame, path: str | None = None) -> DataFrame:
    if path is not None:
        lines = lattice.coord_viewer(lattice.atoms_of(nodes), lattice.lattice_of(nodes))
        writer.write_text(lines.orderBy("doc_id", "ord"), path, "line", mode="overwrite")
    return nodes


def visit(nodes: DataFrame, scale: float = 1, path: str | None = None) -> DataFrame:
    if path is not None:
        lines = lattice.format_for_visit(lattice.atoms_of(nodes), lattice.lattice_of(nodes), scale)
        writer.write_text(lines.orderBy("doc_id", "line_no"), path, "line", mode="overwrite")
    return nodes


def send_tree(
    nodes: DataFrame, xsd: str | None = None, parsed_output: str | None = None, transform_output: str | None = None, transforms: str | list[str] = (), transform_file: str | None = None, errors_output: str | None = None
) -> DataFrame:
    """Sends the tree through the engine again in the midst of a chain and hands it on as it was: it is bound to the
    schema (found through the documents where none is given), its errors are written to errors_output (Parquet), it and
    what `transforms` (or those of a file) make of it to the other outputs. An output that isn't given isn't written."""
    spark = nodes.sparkSession
    nodes = materialise(nodes, "sent")
    engine = Engine(spark, xsd)
    if errors_output is not None:
        engine.errors(nodes).write.mode("overwrite").parquet(errors_output)
    if parsed_output is not None:
        engine.write(nodes, parsed_output, mode="overwrite")
    calls = read_calls(spark, transform_file) if transform_file else parse_calls(transforms)
    if calls and transform_output is not None:
        engine.write(engine.transform(nodes, calls), transform_output, mode="overwrite")
    return nodes


REGISTRY = Registry(ExpandCell=expand, SphereCutter=cut, PrintData=print_data, CoordViewer=view_coordinates, FormatForVisit=visit, SendTree=send_tree)


def revalidate(nodes: DataFrame, catalog: Catalog, calls: str | list[str] = ()) -> DataFrame:
    """Errors of a node table after transforms; validation may be called at any point of a pipeline."""
    return validate(REGISTRY.run(nodes, calls) if calls else nodes, catalog)


#: Schemas that one run reads, found through its documents.
SCHEMAS = 1000


class Engine:
    """load -> (overlay) -> errors / transform -> write, over files or a table of documents.

    Without a schema, errors() finds it through the documents: each is checked against the one that its root names.
    """

    def __init__(self, spark: SparkSession, schema: Catalog | str | None = None, overlay: dict | None = None, registry: Registry | None = None):
        self.spark, self.overlay = spark, overlay
        self.registry = registry or REGISTRY
        self.catalog = None if schema is None else self._read(schema)

    def _read(self, schema: Catalog | str) -> Catalog:
        catalog = read_xsd(self.spark, schema) if isinstance(schema, str) else schema
        return catalog.overlaid(self.overlay) if self.overlay else catalog

    def load(self, source: DataFrame | str) -> DataFrame:
        """The node table of XML files at a path, or of a DataFrame with doc_id and text; written, so documents are
        shredded once however often the nodes are read."""
        return materialise(shred(documents(self.spark, source) if isinstance(source, str) else source), "nodes")

    def locations(self, nodes: DataFrame) -> DataFrame:
        """doc_id, attribute, namespace, location and code: where each document says its schema is."""
        roots = nodes.where("depth = 0").select("doc_id", schema_location(F.col("attribs")).alias("at"))
        return roots.select("doc_id", "at.*")

    def errors(self, nodes: DataFrame, base: str | None = None) -> DataFrame:
        """All errors of the nodes. Without a schema of the engine, of each document by the schema that it names, below
        the folder `base` if its name is relative; documents that name none have the error no_schema_location. The
        distinct names come to the driver: more than SCHEMAS are an error."""
        if self.catalog is not None:
            return validate(nodes, self.catalog)
        at = materialise(self.locations(nodes), "locations")
        names = [r.location for r in at.where("location IS NOT NULL").select("location").distinct().limit(SCHEMAS + 1).collect()]
        if len(names) > SCHEMAS:
            raise ValueError(f"the documents name more than {SCHEMAS} schemas")
        out = at.where("code IS NOT NULL").select("doc_id", F.lit(0).cast("long").alias("node_id"), "code", F.lit("").alias("name"), F.lit("").alias("type"), F.lit("").alias("detail"))
        unread = nodes.where("error IS NOT NULL")
        out = out.unionByName(root_errors(unread, Catalog()))
        for name in sorted(names):
            whole = name if base is None or "://" in name or name.startswith("/") else f"{base.rstrip('/')}/{name}"
            some = nodes.join(at.where(F.col("location") == name).select("doc_id"), "doc_id", "left_semi")
            out = out.unionByName(validate(some, self._read(whole)))
        return out

    def transform(self, nodes: DataFrame, calls: str | list[str] | list[Call]) -> DataFrame:
        return self.registry.run(nodes, calls)

    def write(self, nodes: DataFrame, path: str, mode: str = "errorifexists", parts: bool = False) -> None:
        """Documents as text, one in a row, or in parts if they may be too large for that: see writer.write_parts()."""
        if parts:
            return writer.write_parts(nodes, path, writer.header(), mode)
        writer.write_text(writer.write_tree(nodes, writer.header()), path, mode=mode)
