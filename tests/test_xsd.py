from pyspark.sql import types as T

from timberline import fixtures
from timberline.operators import bind
from timberline.sources.xsd import UNBOUNDED, Attribute, Type, compile_xsd

HEAD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">'


def test_types_elements_and_inheritance():
    c = compile_xsd(fixtures.GEO)
    assert [e.name for e in c.roots] == ["region"]
    assert list(c.attributes("Region")) == ["key", "name"]
    nation = c.elements("Region")[0]
    assert (nation.min_occurs, nation.max_occurs, nation.is_list) == (0, UNBOUNDED, True)
    assert c.builtin("Key") == "integer" and c.builtin("Customer") == "string" and not c.is_simple("Region")
    assert c.errors == []


def test_struct():
    s = compile_xsd(fixtures.CUSTOMER).struct("Customer")
    assert s == T.StructType([T.StructField("_key", T.LongType(), False), T.StructField("name", T.StringType()), T.StructField("balance", T.DoubleType())])
    region = compile_xsd(fixtures.GEO).struct("Region")
    assert isinstance(region["nation"].dataType, T.ArrayType)


def test_inline_types_are_processed_once_and_annotations_do_not_type():
    c = compile_xsd(HEAD + """<xs:element name="r"><xs:annotation><xs:documentation>text</xs:documentation></xs:annotation>
      <xs:complexType><xs:sequence><xs:element name="a"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="x"/><xs:enumeration value="y"/></xs:restriction></xs:simpleType></xs:element>
      <xs:choice minOccurs="1" maxOccurs="2"><xs:element name="b" type="xs:int"/></xs:choice><xs:element name="c" type="xs:string"/></xs:sequence></xs:complexType></xs:element></xs:schema>""")
    assert c.roots[0].type == "r|complexType"
    t = c.types["r|complexType"]
    assert [e.name for e in t.elements] == ["a", "b", "c"] and [g.kind for g in t.groups] == ["sequence", "choice"]
    assert c.types["a|simpleType"].facets.enumeration == ["x", "y"]


def test_errors_of_the_schema_itself():
    c = compile_xsd(HEAD + '<xs:element name="r" type="No"/><xs:element name="d" type="xs:date"/><xs:import/></xs:schema>')
    assert {e[0] for e in c.errors} == {"unknown_type", "unsupported_type", "unsupported_tag"}


def test_attribute_groups_lists_facets_and_names():
    c = compile_xsd(HEAD + """<xs:attributeGroup name="g"><xs:attribute name="z" type="xs:int" default="3"/></xs:attributeGroup>
      <xs:complexType name="T"><xs:attributeGroup ref="g"/></xs:complexType>
      <xs:simpleType name="L"><xs:list itemType="xs:int"/></xs:simpleType>
      <xs:simpleType name="F"><xs:restriction base="xs:int"><xs:minExclusive value="1"/><xs:maxInclusive value="9"/><xs:length value="1"/><xs:pattern value="[0-9]"/></xs:restriction></xs:simpleType></xs:schema>""")
    assert c.attributes("T") == {"z": Attribute("z", "xs:int", "optional", "3")}
    assert c.types["L"].item_type == "xs:int"
    f = c.types["F"].facets
    assert (f.min_exclusive, f.max_inclusive, f.length, f.pattern) == (1.0, 9.0, 1, ["[0-9]"])
    assert "F|pattern|1" in {n[3] for n in c.nodes}


def test_catalogs_are_apart_and_overlays_take_precedence(spark):
    a, b = compile_xsd(fixtures.GEO), compile_xsd(fixtures.ORDER)
    assert "Region" not in b.types
    over = a.overlaid({"Place": Type("Place", "complex", attributes={"only": Attribute("only", "xs:int")})})
    assert list(over.attributes("Region")) == ["only"] and list(a.attributes("Region")) == ["key", "name"]
    rows = {(r.type_name, r.name, r.distance) for r in bind.inherited_attributes(over, spark).collect()}
    assert ("Region", "only", 1) in rows


def test_a_type_inside_itself_ends():
    c = compile_xsd(HEAD + '<xs:complexType name="T"><xs:sequence><xs:element name="t" type="T"/></xs:sequence></xs:complexType></xs:schema>')
    assert c.struct("T")["t"].dataType == T.StringType()


def test_a_schema_that_cannot_be_fetched_is_an_error(spark, tmp_path):
    from timberline.sources.xsd import read_xsd

    assert read_xsd(spark, "http://localhost:9/x.xsd").errors[0][0] == "schema_unreachable"
    (tmp_path / "s.xsd").write_text(fixtures.GEO)
    assert "Region" in read_xsd(spark, f"{tmp_path}/s.xsd").types
