"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample with a penalty on size, so lists are balanced. Every vector is filed in the
list of its nearest centroid, and in others whose centroid is hardly farther, so vectors on a boundary are found from
either side. A query walks an in-memory neighbourhood graph over the centroids to the nearest ones, keeps the first
lists until they hold several times as many rows as are asked for, and drops what is farther than the last of these by
more than a ratio. A list that outgrows a task is divided by centroids of its own, fitted and searched on the executors
in the same way, so lists don't grow with the table. What is still large (copies of one vector) is cut into pieces by a
hash, and so are the queries that meet in one list; a task holds one piece of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.shared import materialise

#: Rows that the centroids are fitted on, and the greatest number of centroids (which bounds what is broadcast). Both
#: hold for the first level, and for each list of it that is divided.
SAMPLE, CENTROIDS = 20_000, 2048
#: Pairs of a query and a list that one task writes when a list is divided.
PAIRS = 1 << 18
#: Vectors for each centroid; those of a piece of a list; queries of a piece.
LIST, PIECE, QUERIES = 256, 4096, 2048
#: A vector is filed in every list, of the nearest COPIES, whose centroid is at most CLOSURE times as far as its nearest.
CLOSURE, COPIES = 1.02, 3
#: Rows, for each neighbour asked for, that a query's nearest lists must hold before a list may be dropped.
ENOUGH = 8
#: Rounding that a score from a matrix product may have.
MARGIN = 1e-9
#: Edges of a centroid in the graph.
DEGREE = 24


@dataclass
class Index:
    """centroids: unit vectors; graph: for each centroid the nearest others."""

    centroids: np.ndarray
    graph: np.ndarray

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest centroids of each row (all are compared): positions and distances, nearest first."""
        return ranked(x, self.centroids, n)

    def walk(self, x: np.ndarray, n: int, start: np.ndarray = np.zeros(0, dtype=int)) -> tuple[np.ndarray, np.ndarray]:
        """As nearest() for one vector, by best-first search of the graph with a beam of n centroids, from fixed
        centroids and those of start."""
        seen = np.zeros(len(self.centroids), dtype=bool)
        entry = np.unique(np.linspace(0, len(self.centroids) - 1, 8).astype(int))
        entry = np.union1d(entry, start)
        seen[entry] = True
        beam, dist = entry, 2 - 2 * self.centroids[entry] @ x
        done = np.zeros(len(beam), dtype=bool)
        while not done.all():
            todo = np.flatnonzero(~done)[:8]
            done[todo] = True
            new = np.unique(self.graph[beam[todo]])
            new = new[~seen[new]]
            seen[new] = True
            beam, dist = np.append(beam, new), np.append(dist, 2 - 2 * self.centroids[new] @ x)
            done = np.append(done, np.zeros(len(new), dtype=bool))
            order = np.argsort(dist, kind="stable")[:n]
            beam, dist, done = beam[order], dist[order], done[order]
        return beam, np.sqrt(np.maximum(0.0, dist))

    def probe(self, x: np.ndarray, n: int, ratio: float, rows: np.ndarray, least: int) -> np.ndarray:
        """The lists to read for one vector: of the n that a walk finds, those up to ratio times as far as the list
        with which the nearest ones hold `least` rows. rows: how many vectors are nearest to each centroid, so none is
        counted twice. Where the walk's lists hold too few, all lists are ranked. The walk starts from the lists that
        x is filed in, as few edges lead to the centroid of an isolated group."""
        found, d = self.walk(x, n, self.nearest(x[None], COPIES)[0][0])
        if rows[found].sum() < least:
            found, d = (a[0] for a in self.nearest(x[None], len(self.centroids)))
        return pruned(found, d, rows, ratio, least)


def ranked(x: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centroids of each row, nearest first, and their distances; distances of 1024 rows at a time."""
    n = min(n, len(centroids))
    at, dist = np.zeros((len(x), n), dtype=np.int64), np.zeros((len(x), n))
    for i in range(0, len(x), 1024):
        d = np.sqrt(np.maximum(0.0, 2 - 2 * x[i : i + 1024] @ centroids.T))
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        at[i : i + 1024] = near = np.take_along_axis(near, order, 1)
        dist[i : i + 1024] = np.take_along_axis(d, near, 1)
    return at, dist


def pruned(found: np.ndarray, d: np.ndarray, rows: np.ndarray, ratio: float, least: int) -> np.ndarray:
    """Of lists in order of their distances those up to ratio times as far as the one with which they hold `least`."""
    base = d[min(int(np.searchsorted(np.cumsum(rows[found]), least)), len(d) - 1)]
    return found[d <= max(base * ratio, base + 1e-12)]


def close(d: np.ndarray) -> np.ndarray:
    """Which of the nearest lists of each row it is filed in."""
    return d <= np.maximum(d[:, :1] * CLOSURE, d[:, :1] + 1e-12)


def centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """So many centroids (fewer, if fewer rows differ) of unit vectors x, by k-means on the sphere whose distances grow
    with a list's size."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    weight = np.zeros(lists)
    for _ in range(rounds):
        near = np.concatenate([np.argmin(-x[i : i + 1024] @ c.T + weight, axis=1) for i in range(0, len(x), 1024)])
        size = np.bincount(near, minlength=lists)
        weight += 0.02 * (size / max(1.0, len(x) / lists) - 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        sums[size == 0] = x[rng.choice(len(x), int((size == 0).sum()))]
        c = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1))[:, None]
    return c


def fit(x: np.ndarray, lists: int) -> Index:
    """The centroids of unit vectors x, and their graph."""
    c = centres(x, lists)
    lists = len(c)
    graph = np.argsort(-(c @ c.T), axis=1, kind="stable")[:, 1 : DEGREE + 1]
    ring = np.stack([np.roll(np.arange(lists), 1), np.roll(np.arange(lists), lists // 2)], axis=1)  # keeps it connected
    return Index(c, np.concatenate([graph, ring], axis=1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: vec_id not null, the vector neither null, empty nor zero,
    all components finite. Rows that repeat a vec_id are rows like any other."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles from a list column; shorter vectors are padded with zeros."""
    out = np.zeros((len(column), dims))
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; very long and very short ones don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row. A pair's sums run over its own row in one order, so its score is the same
    whatever rows it is computed with."""
    scale = lambda a: a / np.abs(a).max(axis=-1, keepdims=True)
    q, x = scale(q[None]), np.ascontiguousarray(scale(x))
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def block_best(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of the query, positions of its k best in order and scores): a matrix product picks them with a margin
    for its rounding, cosines() decides. Ties to the smaller id."""
    near_q, near_x = unit(q), unit(x)
    for at in range(0, len(q), 256):
        s = near_q[at : at + 256] @ near_x.T
        s[q_rows[at : at + 256, None] == rows[None]] = -np.inf
        for i, row in enumerate(s):
            some = np.flatnonzero((row >= np.partition(row, -min(k, len(row)))[-min(k, len(row))] - MARGIN) & (row > -np.inf))
            score = cosines(q[at + i], x[some])
            order = np.lexsort((rows[some], ids[some], -score))[:k]
            yield at + i, some[order], score[order]


@dataclass
class Plan:
    """rows: row, vec_id, v of what takes part; postings: rows by list; probes: queries by the lists that they read; dims:
    components of the longest vector."""

    rows: DataFrame
    postings: DataFrame
    probes: DataFrame
    dims: int

    def share(self) -> float:
        """Rows that a query is compared with, as a share of all rows: copies in several lists count each."""
        sizes = self.postings.groupBy("list").agg(F.count("*").alias("n"))
        compared = self.probes.join(sizes, "list").agg(F.sum("n")).first()[0] or 0
        return compared / max(1, self.probes.select("row").distinct().count() * self.rows.count())


def plan(vectors: DataFrame, every: int, k: int, probes: float, ratio: float) -> Plan | None:
    """The index, with every row filed and every query routed; None if nothing takes part."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"), "vectors")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    # a hash threshold leaves about twice the sample, so that partitions don't each send one to the driver
    share = min(1 << 20, -(-2 * SAMPLE * (1 << 20) // n))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(1 << 20)) < share).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).toArrow()
    index = fit(unit(matrix(sample.column("v").combine_chunks(), dims)), min(CENTROIDS, max(1, n // LIST)))
    shared = spark.sparkContext.broadcast(index)  # CENTROIDS vectors at most
    beam = max(8, math.ceil(probes * len(index.centroids)))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = shared.value.nearest(unit(matrix(b.column(2), dims)), COPIES)
            row, col = np.nonzero(close(d))
            take = [c.take(pa.array(row)) for c in b.columns]
            yield pa.RecordBatch.from_arrays([*take, pa.array(at[row, col]), pa.array(col == 0)], ["row", "vec_id", "v", "list", "own"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(matrix(b.column(2), dims))
            for i in range(0, len(x), 64):  # a query may read many lists, and a row goes to each
                found = [shared.value.probe(y, beam, ratio, sizes.value, ENOUGH * k + 1) for y in x[i : i + 64]]
                row = pa.array(i + np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in b.columns], pa.array(np.concatenate(found))], ["row", "vec_id", "v", "list"])

    kind = "row long, vec_id long, v array<double>, list long"
    postings = materialise(rows.mapInArrow(filed, kind + ", own boolean"), "postings")
    held = np.zeros(len(index.centroids), dtype=np.int64)
    for r in postings.where("own").groupBy("list").count().collect():  # one row for each list
        held[r["list"]] = r["count"]
    sizes = spark.sparkContext.broadcast(held)
    queries = materialise(rows.where(F.col("vec_id") % every == 0).mapInArrow(probed, kind), "probes")
    return Plan(rows, *divided(postings, queries, held, dims, k, probes, ratio), dims)


def divided(postings: DataFrame, queries: DataFrame, held: np.ndarray, dims: int, k: int, probes: float, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Postings and probes with each list of over PIECE rows divided by centroids of its own, which are fitted on a
    bounded sample of its rows: filed and probed as on the first level, by the same rules. held: rows of each list.

    A task has one list's centroids and a bounded piece of its rows or queries, so neither a list's centroids nor its
    rows are held anywhere as a whole, and the driver sees no more than one number for each list.
    """
    large = [(int(i), int(n), min(CENTROIDS, -(-int(n) // LIST))) for i, n in enumerate(held) if n > PIECE]
    if not large:
        return postings, queries
    spark = postings.sparkSession
    asked = queries.groupBy("list").agg(F.count("*").alias("asked"))
    large = spark.createDataFrame(large, "list long, held long, fines long").join(asked, "list", "left")
    large = large.select("list", "held", "fines", F.greatest(F.lit(1), F.ceil(F.col("asked") * F.col("fines") / PAIRS)).alias("q_pieces"), F.ceil(F.col("held") / (4 * PIECE)).alias("pieces"))
    large = F.broadcast(materialise(large, "large"))  # one row for each list of the first level

    def fitted(t: pa.Table) -> pa.Table:
        c = centres(unit(matrix(t.column("v").combine_chunks(), dims)), t.column("fines")[0].as_py())
        return pa.table({"list": t.column("list").slice(0, 1).take(pa.array(np.zeros(len(c), dtype=int))), "fine": pa.array(np.arange(len(c))), "c": pa.array(list(c), pa.list_(pa.float64()))})

    part = F.pmod(F.xxhash64("row", F.lit(4)), F.lit(1 << 40))  # by the row's number, so copies are thinned too
    some = postings.where("own").join(large, "list").where(part < F.ceil(F.col("fines") * (SAMPLE // CENTROIDS + 1) * (1 << 40) / F.col("held")))
    cells = materialise(some.select("list", "v", "fines").groupBy("list").applyInArrow(fitted, "list long, fine long, c array<double>"), "centroids")

    def cell(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        t = t.sort_by("fine")
        # a list whose sample is empty has one part
        return t, matrix(t.column("c").combine_chunks(), dims) if len(t) else np.zeros((1, dims))

    def table_of(t: pa.Table, row: np.ndarray, fine: np.ndarray) -> pa.Table:
        return t.select(["row", "vec_id", "v", "list"]).take(pa.array(row)).append_column("fine", pa.array(fine))

    none = np.zeros(0, dtype=np.int64)

    def filed(t: pa.Table, c: pa.Table) -> pa.Table:
        at, d = ranked(unit(matrix(t.column("v").combine_chunks(), dims)), cell(c)[1], COPIES) if len(t) else (none[:, None], none[:, None])
        row, col = np.nonzero(close(d))
        own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)[row] & (col == 0)
        return table_of(t, row, at[row, col]).append_column("own", pa.array(own))

    def probed(t: pa.Table, c: pa.Table) -> pa.Table:
        if not len(t):
            return table_of(t, none, none)
        c, points = cell(c)
        rows = c.column("n").to_numpy() if len(c) else np.ones(1)
        beam, least, found = max(8, math.ceil(probes * len(points))), ENOUGH * k + 1, []
        for at, d in zip(*ranked(unit(matrix(t.column("v").combine_chunks(), dims)), points, len(points)), strict=True):
            n = max(beam, int(np.searchsorted(np.cumsum(rows[at]), least)) + 1)
            found.append(pruned(at[:n], d[:n], rows, ratio, least))
        return table_of(t, np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found))

    kind = "row long, vec_id long, v array<double>, list long, fine long"
    to = lambda df, n: df.join(large, "list").withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int"))))
    dealt = lambda df, n: df.join(large, "list").withColumn("piece", F.pmod(F.xxhash64("row", F.lit(5)), F.col(n)).cast("int"))
    by = ["list", "piece"]
    right = to(cells, "pieces").select(*by, "fine", "c").groupBy(*by)
    left = dealt(postings, "pieces").select("row", "vec_id", "v", "own", *by).groupBy(*by)
    fine = materialise(left.cogroup(right).applyInArrow(filed, kind + ", own boolean"), "fine_postings")
    sizes = fine.where("own").groupBy("list", "fine").agg(F.count("*").alias("n"))
    sized = materialise(cells.join(sizes, ["list", "fine"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "cells")
    right = to(sized, "q_pieces").select(*by, "fine", "c", "n").groupBy(*by)
    left = dealt(queries, "q_pieces").select("row", "vec_id", "v", *by).groupBy(*by)
    reads = materialise(left.cogroup(right).applyInArrow(probed, kind), "fine_probes")

    key = lambda fine: (F.col("list") * CENTROIDS + fine).alias("list")
    joined = lambda df, parts, *also: (
        df.join(large, "list", "left_anti").select("row", "vec_id", "v", key(F.lit(0)), *also).unionByName(parts.select("row", "vec_id", "v", key(F.col("fine")), *also))
    )
    return joined(postings, fine, "own"), joined(queries, reads)


def search(vectors: DataFrame, every: int = 50, k: int = 5, probes: float = 0.7, ratio: float = 1.35) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine) for the k nearest found of each query, ties to smaller vec_id.

    Queries: rows whose vec_id is divisible by `every`; candidates: every row but the query's own. Rows that repeat a
    vec_id are queries and candidates each, of each other too. probes: the share of the centroids that a query's walk
    keeps; ratio: lists farther than that times the nearest are dropped. Neither leaves a query with fewer than k rows
    where there are more: see Index.probe(). What takes part: see usable(). An empty table gives no rows. Other columns
    are ignored, whatever their names. All rows are filed; only the fit uses a sample.
    """
    spark = vectors.sparkSession
    made = plan(vectors, every, k, probes, ratio)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    postings, queries, dims = made.postings, made.probes, made.dims
    # one row for each list; no broadcast is asked for, as lists grow in number with the table
    pieces = postings.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")).join(queries.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_pieces")), "list")
    deal = materialise(pieces, "pieces")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    head = ("row", "vec_id", "v", "list")
    left = queries.join(deal, "list").select(*head, spread("pieces").alias("piece"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("q_pieces")).cast("int").alias("q_piece"))
    right = postings.join(deal, "list").select(*head, F.pmod(F.xxhash64("row", F.lit(2)), F.col("pieces")).cast("int").alias("piece"), spread("q_pieces").alias("q_piece"))

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if len(q) and len(c):
            of = lambda t, name: t.column(name).to_numpy()
            x, y = matrix(q.column("v").combine_chunks(), dims), matrix(c.column("v").combine_chunks(), dims)
            q_rows, q_ids, rows, ids = of(q, "row"), of(q, "vec_id"), of(c, "row"), of(c, "vec_id")
            for i, at, score in block_best(x, q_rows, y, rows, ids, k):
                out.append((int(q_rows[i]), int(q_ids[i]), rows[at].tolist(), ids[at].tolist(), score.tolist()))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("query", "query_id", "rows", "ids", "scores"), cols, kinds, strict=True)})

    cell = ["list", "piece", "q_piece"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(best, "query long, query_id long, rows array<long>, ids array<long>, scores array<double>")
    each = found.select("query", "query_id", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("x"))
    # a vector may stand in several lists, with the same score in each
    each = each.groupBy("query", "query_id", F.col("x.rows").alias("row"), F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
