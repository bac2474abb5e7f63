import io

from pyspark.sql import functions as F

from timberline import fixtures
from timberline.__main__ import main
from timberline.operators import writer
from timberline.sources.xml import shred
from timberline.sources.xsd import compile_xsd

SCHEMA = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="R"/><xs:complexType name="R"><xs:sequence><xs:element name="k" type="xs:int"/></xs:sequence></xs:complexType></xs:schema>'


def test_files_are_checked_and_written(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "r.xsd").write_text(SCHEMA)
    (tmp_path / "in" / "a.xml").write_text("<r><k>z</k></r>")
    (tmp_path / "in" / "b.xml").write_text("<r><k>1</k></r>")
    where = lambda x: str(tmp_path / x)
    assert main(["-i", where("in"), "-s", where("r.xsd"), "-o", where("out"), "-p", where("parsed"), "-e", where("errors"), "-t", "PrintData()", "-v"], spark) == 0
    said = capsys.readouterr().err
    assert "unreadable_data: 1" in said and "schema[schema]" in said
    assert spark.read.parquet(where("errors")).count() == 1
    texts = spark.read.text(where("out"), wholetext=True)
    assert spark.read.text(where("parsed")).count() == spark.read.text(where("out")).count()
    assert texts.agg(F.sum(F.length("value"))).first()[0] > 0


def test_stdin_stdout_and_bad_calls(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "r.xsd").write_text(SCHEMA)
    (tmp_path / "more.xsd").write_text(SCHEMA.replace("xs:int", "xs:string"))
    monkeypatch.setattr("sys.stdin", io.StringIO("<r><k>z</k></r>"))
    assert main(["-s", str(tmp_path / "r.xsd"), "-c", str(tmp_path / "more.xsd")], spark) == 0
    got = capsys.readouterr()
    assert [x.strip() for x in got.out.splitlines()] == ["<r>", "<k>", "z", "</k>", "</r>"] and got.err == ""
    monkeypatch.setattr("sys.stdin", io.StringIO("<r><k>1</k></r>"))
    assert main(["-q", "-t", "Nothing() > PrintData()"], spark) == 2
    (tmp_path / "calls").write_text("PrintData()\n\nos.system('x')\n")
    monkeypatch.setattr("sys.stdin", io.StringIO("<r><k>1</k></r>"))
    assert main(["-q", "-T", str(tmp_path / "calls")], spark) == 2
    assert [x.split(":")[0] for x in capsys.readouterr().err.splitlines() if "_transform" in x] == ["unknown_transform", "bad_transform_call"]


def test_documents_in_parts(spark, tmp_path):
    texts = ["<r>" + "".join(f"<k a='{i}' b='x'>{i}</k>" for i in range(300)) + "</r>", "<r/>", "<r><k><m/></k>t</r>"]
    nodes = shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writer.write_parts(nodes, str(tmp_path / "out"), writer.header())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = {r.doc_id: r.xml for r in writer.write_tree(nodes, writer.header()).collect()}
    for i in range(3):
        files = sorted((tmp_path / "out" / f"doc_id={i}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == whole[i]
        assert len(files) > 1 or i
    out = io.StringIO()
    writer.show_tree(nodes, out)
    assert "".join(whole[i].split("\n", 1)[1] for i in range(3)) == out.getvalue()


def test_navigation_of_a_schema():
    c = compile_xsd(fixtures.GEO)
    by = {(tag, name): rest for _, tag, name, *rest in c.navigation()}
    assert by["schema", "schema"] == [1, False, None] and by["element", "region"] == [2, True, None]
    assert by["element", "nation"][1:] == [False, "Region"] and by["simpleType", "Key"] == [2, True, "Key"]
    assert c.describe().splitlines()[:2] == ["schema[schema]", "  element[region] type=Region"]
