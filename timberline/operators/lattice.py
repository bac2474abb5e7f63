"""Crystal lattices: extraction from node tables, replication, selection, coordinates, and rewriting of the tree.

atoms: doc_id, ord, atom_type, x, y, z (fractions of the vectors). lattice: one row for each document with its vectors
a1, a2, a3 (ARRAY<DOUBLE> of three). Three-dimensional maths is unrolled into scalar columns, which stay in generated
code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.functions import vectors as V
from timberline.operators.tree import elements_by_name, place

AXES = ("a1", "a2", "a3")
XYZ = ("x", "y", "z")
#: Decimals of the numbers in exports.
DIGITS = 12


def numbers(value: Column) -> Column:
    """A node's value lines as doubles; items on one line are split at white space."""
    return F.transform(F.filter(F.split(F.trim(F.array_join(value, " ")), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def bravais_vectors(nodes: DataFrame) -> DataFrame:
    """doc_id, name (a1, a2, ... in order), vector and code (not_3d for a value that isn't three numbers)."""
    v = numbers(F.col("value"))
    rows = elements_by_name(nodes, "bravaisVector").withColumn("vector", v)
    good = (F.size("vector") == 3) & F.forall("vector", lambda x: x.isNotNull())
    return rows.select("doc_id", F.concat(F.lit("a"), F.col("rank").cast("string")).alias("name"), "vector", F.when(~F.coalesce(good, F.lit(False)), "not_3d").alias("code"))


def lattice_of(nodes: DataFrame) -> DataFrame:
    """The first three vectors of each document in one row."""
    v = bravais_vectors(nodes).where("code IS NULL")
    return v.groupBy("doc_id").agg(*[F.max(F.when(F.col("name") == a, F.col("vector"))).alias(a) for a in AXES])


def atoms_of(nodes: DataFrame) -> DataFrame:
    """One row for each site: the value of its first position and the ref of its first atom."""
    sites = elements_by_name(nodes, "site").select("doc_id", F.col("path").alias("site"), F.col("rank").alias("ord"))
    inside = nodes.where(F.col("name").isin("position", "atom")).select("doc_id", "path", "name", "value", "attribs")
    # the paths of a site's descendants begin with its own: joined by document and by each ancestor's path
    up = inside.withColumn("site", F.explode(F.expr("transform(sequence(1, greatest(size(split(path, '/')) - 2, 1)), k -> substring_index(path, '/', k + 1))")))
    found = up.join(sites, ["doc_id", "site"])
    first = lambda name, what: F.min_by(F.when(F.col("name") == name, what), F.when(F.col("name") == name, F.col("path")))
    one = found.groupBy("doc_id", "site", "ord").agg(first("position", F.col("value")).alias("p"), first("atom", F.try_element_at("attribs", F.lit("ref"))).alias("atom_type"))
    p = numbers(F.col("p"))
    return one.select("doc_id", (F.col("ord") - 1).alias("ord"), "atom_type", *[F.try_element_at(p, F.lit(i + 1)).alias(c) for i, c in enumerate(XYZ)])


def component(lattice_vector: str, k: int) -> Column:
    return F.element_at(F.col(lattice_vector), k + 1)


def cartesian(position: tuple[Column, Column, Column], k: int) -> Column:
    """The k-th Cartesian coordinate of a position in fractions of a1, a2, a3: sum over v of position[v] * v[k]."""
    return position[0] * component("a1", k) + position[1] * component("a2", k) + position[2] * component("a3", k)


def cartesian_compat(position: tuple[Column, Column, Column], k: int) -> Column:
    """position[k] times the sum of the k-th components; equals cartesian() for diagonal lattices only."""
    return position[k] * component("a1", k) + position[k] * component("a2", k) + position[k] * component("a3", k)


def with_coordinates(atoms: DataFrame, lattice: DataFrame, compat: bool = False) -> DataFrame:
    """atoms with cx, cy, cz and their lattice."""
    f = cartesian_compat if compat else cartesian
    p = tuple(F.col(c) for c in XYZ)
    return atoms.join(lattice, "doc_id").withColumns({f"c{c}": f(p, k) for k, c in enumerate(XYZ)})


def center(lattice: DataFrame) -> DataFrame:
    """doc_id and the coordinates of the middle of the cell."""
    half = (F.lit(0.5), F.lit(0.5), F.lit(0.5))
    return lattice.select("doc_id", *[cartesian(half, k).alias(c) for k, c in enumerate(XYZ)])


def expand_cell(atoms: DataFrame, lattice: DataFrame, n1: int, n2: int, n3: int) -> tuple[DataFrame, DataFrame]:
    """n1 * n2 * n3 copies of the cell in one: positions shrink, vectors grow. Copies are generated row by row; no
    join. The new ord runs over x, y, z and then the atoms, as nested loops would."""
    if min(n1, n2, n3) < 1:
        raise ValueError("a cell is expanded by whole numbers from 1")
    atoms = atoms.withColumn("per_doc", F.count("*").over(W.partitionBy("doc_id")))  # counted before the rows multiply
    for name, n in zip(("i", "j", "k"), (n1, n2, n3), strict=True):
        atoms = atoms.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grown = lattice.select("doc_id", *[V.scale(F.col(a), float(n)).alias(a) for a, n in zip(AXES, (n1, n2, n3), strict=True)])
    copy = (F.col("i") * n2 + F.col("j")) * n3 + F.col("k")
    new = atoms.select("doc_id", (copy * F.col("per_doc") + F.col("ord")).cast("int").alias("ord"), "atom_type", *[((F.col(c) + F.col(s)) / float(n)).alias(c) for c, s, n in zip(XYZ, ("i", "j", "k"), (n1, n2, n3), strict=True)])
    return new, grown


def sphere_cutter(atoms: DataFrame, lattice: DataFrame, radius: float, at: tuple[float, float, float] | None = None, compat: bool = False) -> DataFrame:
    """Atoms whose coordinates lie in the sphere, its surface included; around the middle of the cell by default."""
    radius = float(radius)
    if at is not None and (not isinstance(at, tuple) or len(at) not in (0, 3)):
        raise TypeError("the centre of a sphere is a tuple of three numbers")
    f = cartesian_compat if compat else cartesian
    half = (F.lit(0.5), F.lit(0.5), F.lit(0.5))
    mid = [F.lit(float(c)) for c in at] if at else [f(half, k) for k in range(3)]
    rows = with_coordinates(atoms, lattice, compat)
    off = sum(((F.col(f"c{c}") - m) * (F.col(f"c{c}") - m) for c, m in zip(XYZ, mid, strict=True)), F.lit(0.0))
    return rows.where(off <= radius * radius).select(*atoms.columns)


def sphere_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, atoms, remaining and code (sphere_empty, sphere_unchanged or null) of each document."""
    n = before.groupBy("doc_id").agg(F.count("*").alias("atoms"))
    m = after.groupBy("doc_id").agg(F.count("*").alias("remaining"))
    left = F.coalesce("remaining", F.lit(0).cast("long"))
    return n.join(m, "doc_id", "left").select("doc_id", "atoms", left.alias("remaining"), F.when(left == 0, "sphere_empty").when(left == F.col("atoms"), "sphere_unchanged").alias("code"))


def number(value: Column, digits: int = DIGITS) -> Column:
    """A number as plain decimal text, never with an exponent; null, infinite and huge ones as Spark writes them."""
    return F.coalesce(F.round(value, digits).try_cast(f"decimal(38,{digits})").cast("string"), value.cast("string"))


def format_for_visit(atoms: DataFrame, lattice: DataFrame, scale: float = 1, digits: int = DIGITS) -> DataFrame:
    """doc_id, line_no, line: the scale, three vectors, the number of atoms, and a line for each atom whose type has
    lost its first four characters."""
    head = atoms.groupBy("doc_id").agg(F.count("*").alias("n")).join(lattice, "doc_id")
    lines = [F.lit(str(scale)), *[F.concat_ws(" ", *[number(component(a, k), digits) for k in range(3)]) for a in AXES], F.col("n").cast("string")]
    head = head.select("doc_id", F.posexplode(F.array(*lines)).alias("line_no", "line"))
    place_of = F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) + (len(lines) - 1)
    body = atoms.select("doc_id", place_of.alias("line_no"), F.concat_ws(" ", F.expr("substring(atom_type, 5)"), *[number(F.col(c), digits) for c in XYZ]).alias("line"))
    return head.unionByName(body)


def coord_viewer(atoms: DataFrame, lattice: DataFrame, compat: bool = False, digits: int = DIGITS) -> DataFrame:
    """doc_id, ord, line: each atom's coordinates as a tuple."""
    rows = with_coordinates(atoms, lattice, compat)
    return rows.select("doc_id", "ord", F.concat(F.lit("("), F.concat_ws(", ", *[number(F.col(f"c{c}"), digits) for c in XYZ]), F.lit(")")).alias("line"))


NODE_COLUMNS = ["doc_id", "node_id", "parent_id", "ord", "depth", "path", "names", "name", "attribs", "value", "error"]


def rebuild_tree(nodes: DataFrame, atoms: DataFrame, lattice: DataFrame) -> DataFrame:
    """The node table with the children of the first crystalBasis and the first bravaisLattice replaced.

    New nodes get ids above all old ones of their document, in document order.
    """
    low = nodes.where(F.col("name").isin("crystalBasis", "bravaisLattice") & (F.col("depth") > 0)).groupBy("doc_id", "name").agg(F.min_by(F.struct("path", "node_id", "depth", "names"), "path").alias("at"))
    gone = low.select(F.col("doc_id").alias("_doc"), F.concat("at.path", F.lit("/")).alias("_under"))
    kept = nodes.join(gone, (F.col("doc_id") == F.col("_doc")) & F.col("path").startswith(F.col("_under")), "left_anti")
    top = nodes.groupBy("doc_id").agg((F.max("node_id") + 1).alias("next"))
    no_attribs, no_value = F.create_map().cast("map<string,string>"), F.lit(None).cast("array<string>")

    def base(name: str) -> DataFrame:
        return low.where(F.col("name") == name).select("doc_id", "at").join(top, "doc_id")

    def under(at_path: Column, *places: Column) -> Column:
        return F.concat(at_path, *[F.concat(F.lit("/"), place(p)) for p in places])

    v = lattice.select("doc_id", F.posexplode(F.array(*AXES)).alias("k", "v")).where("v IS NOT NULL").join(base("bravaisLattice"), "doc_id")
    new = v.select(
        "doc_id", (F.col("next") + F.col("k")).alias("node_id"), F.col("at.node_id").alias("parent_id"), F.col("k").alias("ord"), (F.col("at.depth") + 1).alias("depth"), under(F.col("at.path"), F.col("k")).alias("path"),
        F.array_append("at.names", F.lit("bravaisVector")).alias("names"), F.lit("bravaisVector").alias("name"), no_attribs.alias("attribs"), F.transform("v", lambda x: x.cast("string")).alias("value"), F.lit(None).cast("string").alias("error"),
    )
    a = atoms.join(base("crystalBasis"), "doc_id").withColumn("row", (F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1).cast("int"))
    first = F.col("next") + 3 + F.col("row").cast("long") * 4
    site, zero, one = under(F.col("at.path"), F.col("row")), place(F.lit(0)), place(F.lit(1))
    node = lambda k, parent, ord_, depth, path, tail, attribs, value: F.struct(
        (first + k).alias("node_id"), parent.alias("parent_id"), ord_.alias("ord"), (F.col("at.depth") + depth).alias("depth"), path.alias("path"), F.concat("at.names", F.array(*[F.lit(t) for t in tail])).alias("names"), F.lit(tail[-1]).alias("name"), attribs.alias("attribs"), value.alias("value"),
    )
    four = F.array(
        node(0, F.col("at.node_id"), F.col("row"), 1, site, ["site"], no_attribs, no_value),
        node(1, first, F.lit(0), 2, F.concat(site, F.lit("/"), zero), ["site", "occupant"], no_attribs, no_value),
        node(2, first + 1, F.lit(0), 3, F.concat(site, F.lit("/"), zero, F.lit("/"), zero), ["site", "occupant", "atom"], F.create_map(F.lit("ref"), F.col("atom_type")), no_value),
        node(3, first, F.lit(1), 2, F.concat(site, F.lit("/"), one), ["site", "position"], no_attribs, F.array(*[F.col(c).cast("string") for c in XYZ])),
    )
    sites = a.select("doc_id", F.explode(four).alias("n")).select("doc_id", "n.*", F.lit(None).cast("string").alias("error"))
    return kept.select(NODE_COLUMNS).unionByName(new.select(NODE_COLUMNS)).unionByName(sites.select(NODE_COLUMNS))
