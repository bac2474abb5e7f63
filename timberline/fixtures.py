"""Schemas of the tree tables, written as XSD."""

GEO = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="region" type="Region"/>
  <xs:simpleType name="Key"><xs:restriction base="xs:integer"><xs:minInclusive value="0"/></xs:restriction></xs:simpleType>
  <xs:complexType name="Place"><xs:attribute name="key" type="Key" use="required"/><xs:attribute name="name" type="xs:string"/></xs:complexType>
  <xs:complexType name="Region"><xs:complexContent><xs:extension base="Place"><xs:sequence>
    <xs:element name="nation" type="Nation" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
  <xs:complexType name="Nation"><xs:complexContent><xs:extension base="Place"><xs:sequence>
    <xs:element name="customer" type="Customer" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
  <xs:complexType name="Customer"><xs:simpleContent><xs:extension base="Segment">
    <xs:attribute name="key" type="Key" use="required"/><xs:attribute name="name" type="CustomerName"/></xs:extension></xs:simpleContent></xs:complexType>
  <xs:simpleType name="Segment"><xs:restriction base="xs:string"><xs:enumeration value="BUILDING"/><xs:enumeration value="MACHINERY"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="CustomerName"><xs:restriction base="xs:string"><xs:pattern value="Customer#[0-9]+"/></xs:restriction></xs:simpleType>
</xs:schema>"""

ORDER = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="order" type="Order"/>
  <xs:complexType name="Order"><xs:sequence><xs:element name="lineitem" type="Line" minOccurs="1" maxOccurs="7"/></xs:sequence>
    <xs:attribute name="key" type="xs:integer" use="required"/><xs:attribute name="priority" type="xs:string" use="required"/>
    <xs:attribute name="status" type="xs:string" default="O"/></xs:complexType>
  <xs:complexType name="Line"><xs:attribute name="part" type="xs:positiveInteger"/><xs:attribute name="line" type="xs:int"/></xs:complexType>
</xs:schema>"""

CUSTOMER = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="customer" type="Customer"/>
  <xs:complexType name="Customer"><xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="balance" type="xs:double"/></xs:sequence>
    <xs:attribute name="key" type="xs:int" use="required"/></xs:complexType>
</xs:schema>"""

CHOICE = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="order" type="Order"/>
  <xs:complexType name="Order"><xs:choice minOccurs="2" maxOccurs="3"><xs:element name="lineitem" type="Line"/><xs:element name="note" type="xs:string"/></xs:choice></xs:complexType>
  <xs:complexType name="Line"><xs:attribute name="part" type="xs:positiveInteger"/><xs:attribute name="line" type="xs:int"/></xs:complexType>
</xs:schema>"""

IDENTIFIERS = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="order" type="Order"/>
  <xs:complexType name="Order"><xs:sequence><xs:element name="lineitem" type="Line" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:complexType>
  <xs:complexType name="Line"><xs:attribute name="part" type="xs:IDREF"/><xs:attribute name="line" type="xs:ID"/></xs:complexType>
</xs:schema>"""
