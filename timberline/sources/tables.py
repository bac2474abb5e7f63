"""The relational test tables as trees, so that every operator meets data of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.tree import place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(doc: Column, node_id: Column, parent: Column | None, ord_: Column, depth: int, path: Column, names: list[str], attribs: Column, value: Column) -> list[Column]:
    return [
        doc.cast("long").alias("doc_id"), node_id.cast("long").alias("node_id"), (F.lit(None) if parent is None else parent).cast("long").alias("parent_id"), ord_.cast("int").alias("ord"), F.lit(depth).alias("depth"),
        path.alias("path"), F.array(*[F.lit(n) for n in names]).alias("names"), F.lit(names[-1]).alias("name"), attribs.cast("map<string,string>").alias("attribs"), value.cast("array<string>").alias("value"), F.lit(None).cast("string").alias("error"),
    ]


def slashed(*places: Column) -> Column:
    return F.concat(*[x for p in places for x in (F.lit("/"), place(p))])


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region / nation / customer: a document for each region. Attributes key and name; a customer's value is its
    market segment."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    attrs = lambda k, v: F.create_map(F.lit("key"), F.col(k).cast("string"), F.lit("name"), F.col(v))
    rk, nk, ck = F.col("r_regionkey"), F.col("n_nationkey"), F.col("c_custkey")
    top = r.select(*node(rk, rk, None, rk, 0, slashed(rk), ["region"], attrs("r_regionkey", "r_name"), F.lit(None)))
    mid = n.select(*node(F.col("n_regionkey"), nk + 1000, F.col("n_regionkey"), nk, 1, slashed(F.col("n_regionkey"), nk), ["region", "nation"], attrs("n_nationkey", "n_name"), F.lit(None)))
    both = c.join(n, F.col("c_nationkey") == nk)
    low = both.select(*node(F.col("n_regionkey"), ck + 1_000_000, nk + 1000, ck, 2, slashed(F.col("n_regionkey"), nk, ck), ["region", "nation", "customer"], attrs("c_custkey", "c_name"), F.array("c_mktsegment")))
    return top.unionByName(mid).unionByName(low)


def orders_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order / lineitem: a document for each order, attributes from its columns. Only the children's number matters,
    so they are numbered in the order of all their columns."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    attrs = F.create_map(F.lit("key"), key.cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")))
    attrs = F.map_filter(attrs, lambda k, v: v.isNotNull())
    attrs = F.when(F.col("o_orderstatus") == "P", F.map_concat(attrs, F.create_map(F.lit("note"), F.lit("open")))).otherwise(attrs)
    top = o.select(*node(key, F.lit(0), None, F.lit(0), 0, slashed(F.lit(0)), ["order"], attrs, F.lit(None)))
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*li.columns[1:]))
    low = li.withColumn("n", number)
    attrs = F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string"))
    low = low.select(*node(F.col("l_orderkey"), F.col("n"), F.lit(0), F.col("n") - 1, 1, slashed(F.lit(0), F.col("n") - 1), ["order", "lineitem"], attrs, F.lit(None)))
    return top.unionByName(low)


def conversations_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation / one element for each turn, named by its role."""
    c = table(spark, sf_dir, "conversations")
    top = c.select("conv_id").distinct().select(*node(F.col("conv_id"), F.lit(0), None, F.lit(0), 0, slashed(F.lit(0)), ["conversation"], F.create_map(), F.lit(None)))
    turn = F.col("turn")
    low = c.select(*node(F.col("conv_id"), turn + 1, F.lit(0), turn, 1, slashed(F.lit(0), turn), ["conversation", "turn"], F.create_map(), F.lit(None)), "role")
    low = low.withColumn("name", F.col("role")).withColumn("names", F.array(F.lit("conversation"), F.col("role"))).drop("role")
    return top.unionByName(low)


def crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crystal document for each label of embeddings: three vectors that depend on the label, and a site for each
    vector with its first three components as position."""
    e = table(spark, sf_dir, "embeddings")
    no, none = F.create_map(), F.lit(None)
    label = F.col("label")
    one = e.select("label").distinct()
    root = one.select(*node(label, F.lit(0), None, F.lit(0), 0, slashed(F.lit(0)), ["crystal"], no, none))
    lat = one.select(*node(label, F.lit(1), F.lit(0), F.lit(0), 1, slashed(F.lit(0), F.lit(0)), ["crystal", "bravaisLattice"], no, none))
    basis = one.select(*node(label, F.lit(2), F.lit(0), F.lit(1), 1, slashed(F.lit(0), F.lit(1)), ["crystal", "crystalBasis"], no, none))
    vectors = [[label + 1, F.lit(0.5), F.lit(0.0)], [F.lit(0.0), label + 2, F.lit(0.25)], [F.lit(0.125), F.lit(0.0), label + 3]]
    out = root.unionByName(lat).unionByName(basis)
    for k, v in enumerate(vectors):
        value = F.array(*[x.cast("double").cast("string") for x in v])
        out = out.unionByName(one.select(*node(label, F.lit(3 + k), F.lit(1), F.lit(k), 2, slashed(F.lit(0), F.lit(0), F.lit(k)), ["crystal", "bravaisLattice", "bravaisVector"], no, value)))
    first, v = F.col("vec_id") * 4 + 6, F.col("vec_id")
    names = ["crystal", "crystalBasis", "site"]
    position = F.array(*[F.col("embedding")[i].cast("double").cast("string") for i in range(3)])
    parts = (
        node(label, first, F.lit(2), v, 2, slashed(F.lit(0), F.lit(1), v), names, no, none),
        node(label, first + 1, first, F.lit(0), 3, slashed(F.lit(0), F.lit(1), v, F.lit(0)), [*names, "occupant"], no, none),
        node(label, first + 2, first + 1, F.lit(0), 4, slashed(F.lit(0), F.lit(1), v, F.lit(0), F.lit(0)), [*names, "occupant", "atom"], F.create_map(F.lit("ref"), F.concat(F.lit("atom"), label.cast("string"))), none),
        node(label, first + 3, first, F.lit(1), 3, slashed(F.lit(0), F.lit(1), v, F.lit(1)), [*names, "position"], no, position),
    )
    # one pass over embeddings: the four nodes of a site come from its row
    row = e.select(F.explode(F.array(*[F.struct(*p) for p in parts])).alias("n")).select("n.*")
    return out.unionByName(row)
