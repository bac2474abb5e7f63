"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

A source whose target is r times its size takes every document floor(r) times, and once more those whose hash lies
below a threshold. The threshold comes from histograms: tokens are summed by source and the first digits of the hash,
the bucket where the running sum passes the budget is found, and only that bucket is refined by the next digits, until
it holds one document, which is taken if that brings the sum nearer to the budget. A larger budget has a larger
threshold, so mixes are nested. No document is sorted or moved to find them; a level's histogram has at most 4096
buckets a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.rows import row_hashes
from timberline.sources.shared import materialise

#: Hex digits of the hash that each level adds; the hash has HASH of them.
DIGITS, HASH = 3, 64
#: Copies of one row that a task makes at once.
COPIES = 4096
#: Sorts after every hex digit.
ABOVE = "g"
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """source, source_size and target from sources (each once) and their sizes.

    Sources by code point, null last, take the weights in turn. Together the targets are `share` of all sizes. A target
    stops at `limit` times its source's size and the excess is shared by weight among the rest; so every target is the
    lesser of its limit and level * weight, for the one level that gives the sum.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(limit))
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy((F.col("cap") / F.col("weight")).desc(), F.col("source").desc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every) * float(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    # sources whose cap is below the level of the rest are full; the least rest's level holds for all others
    open_level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(every)
    return s.select("source", "source_size", F.when(F.col("cap") / F.col("weight") <= open_level["level"], F.col("cap")).otherwise(F.coalesce(open_level["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, times, upto, copies and some: every document is taken `times` times, and once more
    if its hash is below `upto`. Where copies > 0, so many documents with words (one, or equal rows) have a hash that
    starts with `upto`; `some` of these are taken once more. rows: source, size, hash."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    bound = goal.withColumn("times", times).withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
    zero = F.lit(0).cast("long")
    bound = bound.withColumn("upto", F.lit("")).withColumn("open", F.col("left") > 0).withColumn("copies", zero).withColumn("some", zero)
    bound = materialise(bound, "bounds")
    head = ["source", "source_size", "target", "times"]
    for digits in range(0, HASH, DIGITS):
        if bound.where("open").isEmpty():
            break
        b = bound.where("open").select(F.col("source").alias("_source"), "upto")
        inside = rows.where("size > 0").join(b, F.col("source").eqNullSafe(F.col("_source")) & (F.col("upto") == F.substring("hash", 1, digits)))
        bucket, mark = F.substring("hash", digits + 1, DIGITS), F.xxhash64("hash")
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"), (F.min(mark) == F.max(mark)).alias("one"))
        hist = hist.withColumn("before", F.sum("sum").over(W.partitionBy("source").orderBy("bucket")) - F.col("sum"))
        left = bound.where("open").select(F.col("source").alias("_source"), F.col("left"))
        at = hist.join(left, F.col("source").eqNullSafe(F.col("_source"))).where(F.col("before") + F.col("sum") > F.col("left"))
        at = at.groupBy("_source").agg(F.min(F.struct("bucket", "before", "n", "sum", "one")).alias("at"))
        found = bound.join(at, F.col("source").eqNullSafe(F.col("_source")) & F.col("open"), "left")
        rest = F.col("left") - F.col("at.before")
        here = F.col("open") & F.col("at").isNotNull()
        upto = F.when(~F.col("open"), F.col("upto")).when(F.col("at").isNull(), F.concat("upto", F.lit(ABOVE))).otherwise(F.concat("upto", F.col("at.bucket")))
        # one hash is left in the bucket: of its equal documents as many are taken as come nearest to the budget
        last = here & F.col("at.one")
        some = F.floor(rest * F.col("at.n") / F.col("at.sum") + 0.5).cast("long")
        bound = found.select(
            *head, F.when(here, rest).otherwise(F.col("left")).alias("left"), upto.alias("upto"), (here & ~F.col("at.one")).alias("open"),
            F.when(last, F.col("at.n")).otherwise(F.col("copies")).alias("copies"), F.when(last, some).otherwise(F.col("some")).alias("some"),
        )
        bound = materialise(bound, "bounds")
    return bound.select(*head, "upto", "copies", "some")


def key_hash() -> Column:
    """md5 of doc_id and size: documents are taken in its order."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string")))


def _last() -> Column:
    """Documents in the bucket where the budget ends."""
    return (F.col("copies") > 0) & (F.col("size") > 0) & F.col("hash").startswith(F.col("upto"))


def _bounded(rows: DataFrame, narrow: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """rows with the bounds of their source; narrow: their source, size and hash, written."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    bound = thresholds(narrow, targets(sizes, weights, share, limit)).withColumnRenamed("source", "_source")
    return rows.join(bound, F.col("source").eqNullSafe(F.col("_source")))


def mix(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target and times for every row of doc_id, source, size.

    times: how often the mix takes the document, from 0 to `limit` rounded up. Reruns agree: which documents are taken
    follows from doc_id and size. A null source is a source of its own, a null size counts as 0. Rows of size 0 are
    taken `times` of their source or not at all. Equal rows are told apart by their place, which is written with them;
    as they are equal, it makes no difference which of them is taken. An empty table gives no rows; sources without
    words have target 0.
    """
    rows = rows.select("doc_id", F.col("source").cast("string"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    place = F.md5(F.monotonically_increasing_id().cast("string"))
    rows = materialise(rows.withColumn("hash", F.concat(key_hash(), place)), "sizes")
    found = _bounded(rows, rows, weights, share, limit)
    more = (F.col("hash") < F.col("upto")) | (_last() & (F.col("some") > 0))
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("times") + more.cast("int")).alias("times"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, limit: float = 3.0) -> DataFrame:
    """docs as the mix takes them by their words: each row as often as it is taken, with the same columns. Only
    sources, sizes and hashes are written on the way, not the texts.

    The hash of a row ends in one of its whole content, so reruns agree whatever the partitions. Equal rows have one
    hash; where the budget ends among them, the right number of copies is made from one of them. A null source is a
    source of its own; null and empty texts have size 0 and are taken as often as their source is as a whole. An empty
    table gives no rows. Extra columns may have any name and type.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    content = F.concat(*[F.lpad(F.hex(h), 16, "0") for h in row_hashes(docs)])
    rows = docs.select(row, "doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("size"), content.alias("_content"))
    # 60 bits of the order by id and size, then the content: few levels lead to it where ids and sizes are equal
    rows = rows.select("_row", "source", "size", F.concat(F.substring(key_hash(), 1, 15), "_content").alias("hash"))
    narrow = materialise(rows.select("source", "size", "hash"), "sizes")
    found = _bounded(rows, narrow, weights, share, limit)
    split = _last() & (F.col("copies") > 1)  # equal rows of which only some are taken once more
    more = (F.col("hash") < F.col("upto")) | (_last() & (F.col("some") > 0))
    whole = found.where(~split).withColumn("n", F.col("times") + more.cast("int")).where("n > 0")
    whole = whole.select("_row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("_row.*")
    # one row for each source at most, made into blocks of copies first, so no task makes all of them
    some = found.where(split).groupBy("hash").agg(F.any_value("_row").alias("_row"), F.max(F.col("copies") * F.col("times") + F.col("some")).alias("n")).where("n > 0")
    blocks = some.select("_row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("block")).repartition("block")
    each = blocks.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES)))).select("_row.*")
    return whole.unionByName(each)
