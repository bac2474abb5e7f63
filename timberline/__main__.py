"""Command line: XML files are bound to a schema, checked, transformed and written.

    spark-submit timberline/__main__.py -i docs/ -s schema.xsd -t "ExpandCell(3, 3, 3) > SphereCutter(2)" -o out/
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from timberline.operators import writer
from timberline.plans.pipeline import Engine, call_errors, split_chain
from timberline.sources.shared import materialise
from timberline.sources.xsd import read_xsd

#: Error rows that the verbose mode prints; --errors writes all.
SHOWN = 100


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="timberline", description="Binds XML documents to a schema, checks, transforms and writes them.")
    p.add_argument("-i", "--input", default="-", help="path of XML files that Spark can read; - (default): one document from stdin")
    p.add_argument("-s", "--schema", help="path or URL of the XSD; by default it is found through the documents")
    p.add_argument("-c", "--overlay", help="an XSD whose types are added to the schema's or take their place")
    p.add_argument("-p", "--parsed", help="folder for the documents as they were read")
    p.add_argument("-o", "--output", help="folder for the transformed documents; by default they are printed")
    p.add_argument("--parts", action="store_true", help="write documents in parts, as they may be too large for one string")
    p.add_argument("-e", "--errors", help="folder for all error rows, as Parquet")
    calls = p.add_mutually_exclusive_group()
    calls.add_argument("-t", "--transform", help="transform calls, separated by >")
    calls.add_argument("-T", "--transform-file", help="file with a transform call on each line")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true", help=f"print {SHOWN} error rows, not only their numbers, and the schema")
    loud.add_argument("-q", "--quiet", action="store_true", help="print no errors")
    p.add_argument("--mode", default="errorifexists", choices=("errorifexists", "overwrite"), help="what to do if an output exists")
    return p.parse_args(argv)


def report(errors: DataFrame, verbose: bool) -> None:
    """Errors on stderr: their numbers by code, and some of the rows."""
    for r in errors.groupBy("code").count().orderBy("code").collect():
        print(f"{r['code']}: {r['count']}", file=sys.stderr)
    if verbose:
        for r in errors.orderBy("doc_id", "node_id", "code", "name").limit(SHOWN).collect():
            print(*r, sep="\t", file=sys.stderr)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 2 if a transform call can't be run; errors of the documents are rows and no failure."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("timberline").getOrCreate()
    overlay = read_xsd(spark, a.overlay).types if a.overlay else None
    engine = Engine(spark, a.schema, overlay)
    if a.verbose and engine.catalog is not None:
        print(engine.catalog.describe(), file=sys.stderr)
    source = spark.createDataFrame([(0, sys.stdin.read())], "doc_id long, text string") if a.input == "-" else a.input
    nodes = engine.load(source)
    calls = spark.read.text(a.transform_file, wholetext=True).first()[0].splitlines() if a.transform_file else split_chain(a.transform or "")
    bad = call_errors(spark, calls, engine.registry).collect()
    for r in bad:
        print(f"{r.code}: {r.text}", file=sys.stderr)
    if bad:
        return 2
    if a.errors or not a.quiet:
        base = None if a.input == "-" else a.input if os.path.isdir(a.input) else os.path.dirname(a.input)
        errors = materialise(engine.errors(nodes, base or None), "errors")
        if a.errors:
            errors.write.mode(a.mode).parquet(a.errors)
        if not a.quiet:
            report(errors, a.verbose)
    if a.parsed:
        engine.write(nodes, a.parsed, a.mode, a.parts)
    out = engine.transform(nodes, calls) if calls else nodes
    if a.output:
        engine.write(out, a.output, a.mode, a.parts)
    else:
        writer.show_tree(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
