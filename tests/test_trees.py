import glob
import math

import pytest
from pyspark.sql import functions as F

from timberline.functions import text as X
from timberline.functions import vectors as V
from timberline.operators import bind, lattice, tree, writer
from timberline.plans import pipeline
from timberline.sources.xml import shred

CRYSTAL = """<crystal><bravaisLattice><bravaisVector>2
0
0</bravaisVector><bravaisVector>0 2 0</bravaisVector><bravaisVector>1 0 2</bravaisVector></bravaisLattice>
<crystalBasis><site><occupant><atom ref="atomFe"/></occupant><position>0 0 0</position></site>
<site><occupant><atom ref="atomO"/></occupant><position>0.5 0.5 0.5</position></site></crystalBasis></crystal>"""


def nodes_of(spark, *texts):
    return shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_nested_names_order_and_base(spark):
    n = nodes_of(spark, "<a><a><b/><a/></a><b><a/></b><a/></a>")
    by = lambda df: [r.node_id for r in df.orderBy("rank").collect()]
    assert by(tree.find_all(n, "a")) == [0, 1, 3, 5, 6]  # preorder, the root too
    assert by(tree.elements_by_name(n, "a")) == [1, 6, 3, 5]  # by parent, then place; not the root
    assert tree.find_first(n, "b").first().node_id == 2 and tree.find_first(n, "zz").count() == 0
    inside = tree.below(n, n.where("node_id = 1").select("doc_id", "path"))
    assert sorted(r.node_id for r in inside.collect()) == [1, 2, 3]


def test_recursive_paths_equal_shredded_ones(spark):
    n = nodes_of(spark, CRYSTAL)
    got = {(r.node_id, r.depth, r.path) for r in tree.with_paths(n.select("doc_id", "node_id", "parent_id", "ord")).collect()}
    assert got == {(r.node_id, r.depth, r.path) for r in n.collect()}


def test_write_then_shred_is_the_same_tree(spark):
    text = '<r a="&lt;&quot;&amp;"><k>one line</k><k>two\n lines &amp; &lt;more&gt;</k><!--lone--><e><!--only--></e></r>'
    n = nodes_of(spark, text)
    again = shred(writer.write_tree(n).withColumnRenamed("xml", "text"))
    cols = ["node_id", "parent_id", "path", "name", "attribs", "value"]
    assert sorted(map(str, n.select(cols).collect())) == sorted(map(str, again.select(cols).collect()))


def test_namespaced_attributes_are_written_as_xml(spark):
    at = "{http://www.w3.org/2001/XMLSchema-instance}schemaLocation"
    text = '<r xmlns="urn:a" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:p="urn:p" xsi:schemaLocation="urn:a a.xsd" xml:lang="en" p:q="1" q="2"><k p:z="3"/></r>'
    n = nodes_of(spark, text)
    again = shred(writer.write_tree(n).withColumnRenamed("xml", "text")).orderBy("node_id").collect()
    # p:q beside q keeps its namespace
    assert again[0].attribs == {at: "urn:a a.xsd", "{http://www.w3.org/XML/1998/namespace}lang": "en", "q": "2", "{urn:p}q": "1"} and again[1].attribs == {"z": "3"}
    assert pipeline.Engine(spark, None).locations(n).first()[1:] == ("schemaLocation", "urn:a", "a.xsd", None)


def test_layout(spark):
    n = nodes_of(spark, '<r><k long="1" b="2">v</k><e/></r>')
    assert writer.write_tree(n, writer.header()).first().xml == (
        "<!--File created by timberline-->\n<r>\n    <k\n           b        = \"2\"\n           long     = \"1\">\n       v\n    </k>\n    <e/>\n</r>\n"
    )


def test_cartesian_and_compat(spark):
    n = nodes_of(spark, CRYSTAL)
    a, c = lattice.atoms_of(n), lattice.lattice_of(n)
    assert [(r.ord, r.atom_type, r.x) for r in a.orderBy("ord").collect()] == [(0, "atomFe", 0.0), (1, "atomO", 0.5)]
    assert lattice.with_coordinates(a, c).where("ord = 1").select("cx", "cy", "cz").first() == (1.5, 1.0, 1.0)
    assert lattice.with_coordinates(a, c, compat=True).where("ord = 1").select("cx", "cy", "cz").first() == (1.5, 1.0, 1.0)
    assert lattice.center(c).select("x", "y", "z").first() == (1.5, 1.0, 1.0)


def test_expand_and_cut(spark):
    n = nodes_of(spark, CRYSTAL)
    a, c = lattice.atoms_of(n), lattice.lattice_of(n)
    same, cell = lattice.expand_cell(a, c, 1, 1, 1)
    assert sorted(same.collect()) == sorted(a.collect()) and cell.collect() == c.collect()
    big, cell = lattice.expand_cell(a, c, 2, 3, 1)
    assert big.count() == 12 and [r.ord for r in big.orderBy("ord").collect()] == list(range(12))
    kept = lattice.sphere_cutter(big, cell, 2)
    assert sorted(lattice.sphere_cutter(kept, cell, 2).collect()) == sorted(kept.collect())
    assert lattice.sphere_report(a, lattice.sphere_cutter(a, c, 100)).first().code == "sphere_unchanged"
    assert lattice.sphere_report(a, lattice.sphere_cutter(a, c, 0.1, (50, 0, 0))).first().code == "sphere_empty"
    edge = lattice.sphere_cutter(a, c, math.sqrt(1.5**2 + 2), (0, 0, 0))
    assert edge.count() in (1, 2) and lattice.sphere_cutter(a, c, 2.0615528128088303, (0, 0, 0)).count() == 2  # the surface is inside
    with pytest.raises(TypeError):
        lattice.sphere_cutter(a, c, 1, (1, 2))


def test_bad_vectors_are_reported(spark):
    n = nodes_of(spark, "<c><bravaisVector>1 2</bravaisVector><bravaisVector>1 2 3</bravaisVector></c>")
    assert [(r.name, r.code) for r in lattice.bravais_vectors(n).orderBy("name").collect()] == [("a1", "not_3d"), ("a2", None)]


def test_pipeline_and_exports(spark, tmp_path):
    n = nodes_of(spark, CRYSTAL)
    out = pipeline.REGISTRY.run(n, f"ExpandCell(2,1,1) > FormatForVisit(scale=2, path='{tmp_path}/v') > CoordViewer('{tmp_path}/c')\n\nSphereCutter(50)")
    got = lattice.atoms_of(out)
    assert got.count() == 4 and {r.atom_type for r in got.collect()} == {"atomFe", "atomO"}
    ids = out.groupBy("doc_id", "node_id").count().where("count > 1").count()
    assert ids == 0
    lines = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/v/part*"))).splitlines()
    assert lines[0] == "2" and lines[4] == "4" and lines[5].startswith("Fe ")
    again = shred(writer.write_tree(out).withColumnRenamed("xml", "text"))
    assert lattice.atoms_of(again).count() == 4


def test_calls_are_literals_only():
    assert pipeline.parse_call("A(1, 'x>y', k=(1, 2))") == pipeline.Call("A", (1, "x>y"), {"k": (1, 2)})
    assert [c.name for c in pipeline.parse_calls(["A(1) >", "", "B()"])] == ["A", "B"]
    for bad in ("A(__import__('os'))", "A(", "1 + 2", "a.b()"):
        with pytest.raises(pipeline.BadCall):
            pipeline.parse_call(bad)
    with pytest.raises(pipeline.BadCall):
        pipeline.Registry().run(None, "Nope()")


def test_registered_transform_and_engine(spark, tmp_path):
    from timberline.sources.xsd import compile_xsd

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.xml").write_text("<r><k>1</k></r>")
    schema = compile_xsd('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="R"/><xs:complexType name="R"><xs:sequence><xs:element name="k" type="xs:int"/></xs:sequence></xs:complexType></xs:schema>')
    own = pipeline.Registry(pipeline.REGISTRY)
    own.register("Upper", lambda df, n: df.withColumn("value", F.transform("value", lambda x: F.concat(x, F.lit(str(n))))))
    e = pipeline.Engine(spark, schema, registry=own)
    nodes = e.load(f"{tmp_path}/in")
    assert e.errors(nodes).count() == 0
    out = e.transform(nodes, "Upper(2)")
    assert out.where("name = 'k'").first().value == ["12"]
    e.write(out, f"{tmp_path}/out")
    assert "12" in "".join(open(p).read() for p in glob.glob(f"{tmp_path}/out/part*"))


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0])], "v array<double>, w array<double>")
    assert df.select(V.same_size(F.col("v"), F.col("w"))).first()[0] is False
    with pytest.raises(Exception, match="different lengths"):
        df.select(V.dot(F.col("v"), F.col("w"))).collect()
    r = spark.range(1).select(V.dot(V.vector(F.lit(1), F.lit(2)), V.vector(F.lit(3), F.lit(4))).alias("d"), V.length(V.vector(F.lit(3), F.lit(4))).alias("l")).first()
    assert (r.d, r.l) == (11.0, 5.0)


def test_text_functions(spark):
    rows = [("a\n  b \n\n",), ("one",), ("  ",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(X.value_lines(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [["a", "b"], ["one"], None, None]
    kinds = spark.createDataFrame([("1",), ("1.5",), ("true",), ("x",), (None,)], "t string").select(X.conversion(F.col("t"))["kind"].alias("k")).collect()
    assert [r.k for r in kinds] == ["int", "float", "bool", "string", None]
    names = spark.createDataFrame([("/d/in.xml",), ("plain",)], "p string").select(X.default_name(F.col("p"), "Parsed").alias("n")).collect()
    assert [r.n for r in names] == ["/d/inParsed.xml", "plainParsed.xml"]


def test_streaming_errors(spark, tmp_path):
    from timberline.sources.xsd import compile_xsd
    from timberline.streaming import xml_stream

    schema = compile_xsd('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="R"/><xs:complexType name="R"><xs:sequence><xs:element name="k" type="xs:int"/></xs:sequence></xs:complexType></xs:schema>')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<r><k>z</k></r>")
    docs = xml_stream.read_documents(spark, f"{tmp_path}/in")
    q = xml_stream.write_errors(docs, schema, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert [r.code for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["unreadable_data"]
    q = xml_stream.row_errors(docs, schema).writeStream.format("memory").queryName("row_errors").start()
    q.processAllAvailable()
    q.stop()
    assert [r.code for r in spark.table("row_errors").collect()] == ["unreadable_data"]


def test_numbers_over_several_ranges(spark):
    rows = [(i % 3 if i % 5 else None, i, f"/{(i * 7919) % 10_007:010d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, node_id long, path string").repartition(11)
    got = {(r.doc_id, r.node_id): r.n for r in tree.numbered(df, "n", "path").collect()}
    want = {}
    for d in {r[0] for r in rows}:
        want |= {(d, r[1]): k + 1 for k, r in enumerate(sorted((r for r in rows if r[0] == d), key=lambda r: r[2]))}
    assert got == want
    assert tree.numbered(df.limit(0), "n", "path").count() == 0


def test_python_visitor(spark):
    import pyarrow as pa

    def visitor(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([len(x) for x in b.column("path").to_pylist()], pa.int32())], ["name", "n"])

    got = tree.visit_rows(nodes_of(spark, "<a><b/></a>"), visitor, "name string, n int").collect()
    assert sorted((r.name, r.n) for r in got) == [("a", 11), ("b", 22)]


def test_schema_found_through_the_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "r.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="R"/><xs:complexType name="R"><xs:sequence><xs:element name="k" type="xs:int"/></xs:sequence></xs:complexType></xs:schema>')
    xsi = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:noNamespaceSchemaLocation'
    texts = [f'<r {xsi}="r.xsd"><k>z</k></r>', f'<r {xsi}="gone.xsd"><k>1</k></r>', "<r><k>1</k></r>", "<r>", f'<r {xsi}="r.xsd"><k>1</k></r>']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = pipeline.Engine(spark)
    got = sorted((str(r.doc_id), r.code) for r in e.errors(e.load(docs), base=str(tmp_path)).collect())
    assert got == [("0", "unreadable_data"), ("1", "root_mismatch"), ("2", "no_schema_location"), ("3", "malformed_xml"), ("None", "schema_unreachable")]


def test_errors_of_schemas_are_rows(spark, tmp_path):
    from timberline.operators.validate import validate
    from timberline.sources.xsd import compile_xsd

    n = nodes_of(spark, "<r/>")
    bad = compile_xsd("<xs:schema")
    assert {r.code for r in validate(n, bad).collect()} == {"malformed_schema", "root_mismatch"}
    odd = compile_xsd('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="Nope"/><xs:any/></xs:schema>')
    assert {"unsupported_tag", "unknown_type"} <= {r.code for r in validate(n, odd).collect()}


def test_unwritable_attributes_are_listed(spark):
    n = nodes_of(spark, "<r a='1'/>").withColumn("attribs", F.create_map(F.lit("1 bad"), F.lit("x"), F.lit("a"), F.lit("1")))
    assert [(r.code, r.name) for r in writer.invalid_attributes(n).collect()] == [("attribute_unwritable", "1 bad")]


def test_numbers_in_exports_have_no_exponent(spark):
    got = spark.createDataFrame([(-8.08e-4,), (-6.5e-5,), (1e40,), (float("nan"),), (None,), (-0.0,)], "x double").select(lattice.number(F.col("x"), 6).alias("n")).collect()
    assert [r.n for r in got] == ["-0.000808", "-0.000065", "1.0E40", "NaN", None, "0.000000"]


def test_single_child_of_a_primitive(spark):
    n = nodes_of(spark, "<r><a><v>5</v></a><b><v>1</v><v>2</v></b><c x='7'/><d/><e x='1' y='2'><v>9</v></e></r>")
    got = {r.name: r.typed for r in bind.bind_primitives(n, "int").where("depth = 1").collect()}
    assert got == {"a": 5, "b": None, "c": 7, "d": None, "e": 9}
    assert bind.bind_primitives(n, "boolean").where("name = 'd'").first().typed is True
