import pytest
from pyspark.sql import functions as F

from timberline.functions import xsdtypes as D
from timberline.operators import bind, validate
from timberline.sources.xml import bind_text, shred, shred_text
from timberline.sources.xsd import UNBOUNDED, Element, compile_xsd

SCHEMA = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r" type="R"/>
<xs:complexType name="Base"><xs:attribute name="id" type="xs:ID" use="required"/><xs:attribute name="ref" type="xs:IDREF"/></xs:complexType>
<xs:complexType name="R"><xs:complexContent><xs:extension base="Base"><xs:sequence>
  <xs:element name="a" type="A"/><xs:element name="b" type="xs:int" minOccurs="0" maxOccurs="2"/><xs:element name="c" type="C" maxOccurs="unbounded"/></xs:sequence>
  <xs:attribute name="n" type="xs:positiveInteger" default="7"/></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="A"><xs:choice minOccurs="1" maxOccurs="2"><xs:element name="x" type="xs:string"/><xs:element name="y" type="Short"/></xs:choice></xs:complexType>
<xs:simpleType name="Short"><xs:restriction base="xs:string"><xs:length value="2"/><xs:pattern value="[a-z]+"/></xs:restriction></xs:simpleType>
<xs:simpleType name="C"><xs:list itemType="xs:int"/></xs:simpleType></xs:schema>"""

GOOD = '<r id="i1"><a><x>t</x></a><b>1</b><c>1 2</c></r>'


def errors(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.code, r.name) for r in validate.validate(shred(docs), compile_xsd(SCHEMA)).collect())


def test_rules(spark):
    found = errors(
        spark,
        GOOD,
        '<r id="i"><b>1</b><a><x/></a><c>1</c></r>',  # swapped
        '<r id="i"><a/><c>1 z</c></r>',  # no choice, bad list
        '<r id="i"><a><x/><y>ab</y><x/></a><b>1</b><b>2</b><b>3</b><c>1</c></r>',  # too many
        '<r n="-1" extra="1" ref="q"><a><y>ABC</y></a><c>1</c><d/></r>',
        '<q id="i"/>',
        "<r id='i'>",
        "",
        '<r id="i"><a><x/></a><c>1</c><b>z</b></r>',  # optional b after c
    )
    by = {i: [(c, n) for d, c, n in found if d == i] for i in range(9)}
    assert by[0] == []
    assert by[1] == [("order_error", "a"), ("order_error", "c")]
    assert by[2] == [("choice_none", "x|y"), ("unreadable_data", "c")]
    assert by[3] == [("choice_too_many", "x|y"), ("max_occurs", "b")]
    assert set(by[4]) == {("attribute_required", "id"), ("attribute_undeclared", "extra"), ("attribute_invalid", "n"), ("idref_dangling", "ref"), ("facet_length", "y"), ("facet_pattern", "y"), ("element_undeclared", "d")}
    assert by[5] == [("root_mismatch", "q")]
    assert by[6] == [("malformed_xml", "")]
    assert by[7] == [("no_root", "")]
    assert set(by[8]) == {("order_error", "b"), ("unreadable_data", "b")}


def test_duplicate_ids(spark):
    schema = SCHEMA.replace('name="b" type="xs:int"', 'name="b" type="Base"')
    docs = spark.createDataFrame([(1, '<r id="k"><a><x/></a><b id="k" ref="k"/><c>1</c></r>')], "doc_id long, text string")
    got = [(r.code, r.detail) for r in validate.validate(shred(docs), compile_xsd(schema)).collect()]
    assert got == [("id_duplicate", "k"), ("id_duplicate", "k")]


def test_negative_choice_bounds(spark):
    out = spark.range(3).select(validate.choice_error(F.col("id"), -2, -1).alias("e")).collect()
    assert [r.e for r in out] == ["choice_none", None, "choice_too_many"]


@pytest.mark.parametrize(("kids", "counts"), [("abc", [1, 1, 1]), ("bac", [0, 1, 0]), ("bbc", [0, 2, 1]), ("ac", [1, 0, 1]), ("acb", [1, 0, 1]), ("", [0, 0, 0])])
def test_runs(spark, kids, counts):
    ks = "".join(f"{k};" for k in kids)
    got = spark.range(1).select(validate.run_counts(F.lit(ks), ["a", "b", "c"]).alias("n")).first().n
    assert got == counts and sum(got) <= len(kids)


def test_order_of_a_name_that_begins_another(spark):
    e = [Element("a", None), Element("a.b", None, 1, UNBOUNDED)]
    got = spark.range(1).select(validate.sequence_errors(F.lit("a;a.b;"), e).alias("e")).first().e
    assert got == []


TYPES = {
    "integer": {"5": True, "-5": True, "+5": True, "1.5": False, "1e3": False, "": False, "x": False},
    "positiveInteger": {"1": True, "0": False, "-5": False},
    "nonNegativeInteger": {"0": True, "-1": False},
    "negativeInteger": {"-1": True, "0": False},
    "nonPositiveInteger": {"0": True, "1": False},
    "double": {"1e3": True, "-.5": True, "x": False},
    "boolean": {"true": True, "True": True, "1": True, "0": True, "yes": False, "": False},
    "base64Binary": {"aGk=": True, "a": False, "": True},
    "string": {"": True},
}


@pytest.mark.parametrize("name", TYPES)
def test_builtin(spark, name):
    rows = [(k,) for k in TYPES[name]] + [(None,)]
    got = spark.createDataFrame(rows, "v string").select("v", D.valid(F.col("v"), name).alias("ok")).collect()
    assert {r.v: r.ok for r in got} == {**TYPES[name], None: None}


def test_bound_attributes_defaults_and_order(spark):
    c = compile_xsd(SCHEMA)
    docs = spark.createDataFrame([(1, '<r id="i" other="1" xmlns:q="u"><c>1</c><b>2</b><a/><b>3</b></r>')], "doc_id long, text string")
    nodes = bind.resolve(shred(docs), c)
    r = nodes.where("depth = 0").select(bind.bind_attributes(F.col("attribs"), F.col("type_name"), c).alias("m"), bind.attribute_or_default(F.col("attribs"), "R", "n", c).alias("n")).first()
    assert r.m == {"id": "i"} and r.n == 7
    order = [(x.name, x.bound_ord) for x in bind.bind_elements(nodes, c).orderBy("bound_ord").collect()]
    assert order == [("a", 1), ("b", 2), ("b", 3), ("c", 4)]


def test_typed_binding_agrees_with_rules(spark):
    docs = spark.createDataFrame([(GOOD,), ('<r id="i"><a><x>t</x></a><b>z</b><c>1</c></r>',)], "t string")
    got = docs.select(bind_text(F.col("t"), compile_xsd(SCHEMA), "R").alias("b")).collect()
    assert got[0].b.b == [1] and got[0].b["_id"] == "i1" and got[0].b["_corrupt_record"] is None
    assert got[1].b["_corrupt_record"] is not None


def test_shredding_keeps_comments_namespaces_and_depth():
    rows = shred_text(1, '<n:r xmlns:n="u"><!-- c --><n:k a="1">x\n\n y </n:k></n:r>')
    assert [(r[7], r[9]) for r in rows] == [("r", None), ("_comment_", [" c "]), ("k", ["x", "y"])]
    deep = "<a>" * 3000 + "</a>" * 3000
    assert len(shred_text(1, deep)) == 3000
    assert shred_text(1, "<a/><b/>")[0][-1] == "multiple_roots"
