"""Every registered query of the tree engine against its SQL twin."""

import math

import pytest
from pyspark.sql import functions as F

from timberline.functions import vectors as V
from timberline.queries import ORACLE_SQL, QUERIES

from parity import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLE_SQL:
        assert got == duck_rows(con, ORACLE_SQL[name])
    else:
        assert got[1]


@pytest.fixture(scope="module")
def near_zero(spark, tmp_path_factory):
    """A folder with vectors whose components round to zero from below, ties, and a null one."""
    import duckdb

    sf = str(tmp_path_factory.mktemp("near_zero"))
    rows = [(0, [-1e-7, 0.5, -0.25, 0.0], 0), (1, [0.0078125, -0.0078125, -0.0, 1.0], 0), (2, [1e-7, 3e-7, -4e-7, -1e-7], 1), (3, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    return sf, con


@pytest.mark.parametrize("name", ["rebuild_tree", "vec_add", "vec_scale", "vec_sub"])
def test_zeros_of_lists_have_the_sign_of_their_sql(spark, near_zero, name):
    """Compared as written: parity's norm takes -0.0 for 0.0."""
    sf, con = near_zero
    df = QUERIES[name](spark, sf)
    want = [repr(r) for r in con.sql(ORACLE_SQL[name]).select(", ".join(df.columns)).fetchall()]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(want)
    assert any("-0.0" in r for r in want)


def test_numbers_are_rounded_as_in_sql(spark):
    import duckdb

    xs = [-1e-7, 1e-7, -0.0, 0.0, 5e-7, -5e-7, 1.5e-6, 0.0078125, -0.0078125, 2.0794515, 1612288728467.2068, 1e20, 1e303, -1e303, math.inf, -math.inf, math.nan, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(V.rounded(F.col("x"), 6)).collect()
    assert [repr(r[0]) for r in got] == [repr(duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]) for x in xs]


def test_whole_trees_are_walked_and_bound(spark):
    """No level is left out of the recursive walk or of binding."""
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("region", "nation", "customer", "orders", "lineitem")}
    assert QUERIES["walk_recursive"](spark, SF).count() == rows["region"] + rows["nation"] + rows["customer"]
    for name in ("bind_attributes", "attr_defaults"):
        assert QUERIES[name](spark, SF).count() == rows["orders"] + rows["lineitem"]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["key", "code", "name", "balance"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_llm():
    """Nothing outside the subpackage imports it, and the entry guards its import."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent
    for p in root.glob("timberline/**/*.py"):
        if "llm" not in p.parts:
            assert "timberline.llm" not in p.read_text(), p
