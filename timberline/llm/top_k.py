"""Exact top-k by inner product with pivot-table elimination.

Components are turned into integers floor(64 x). With |q - x| >= | |q - p| - |x - p| | for every pivot p, the greatest
of these over the pivots is a lower bound on the distance, and (|q|^2 + |x|^2 - bound^2) / 2 an upper bound on the
inner product. The distances to the pivots are precomputed. A query evaluates the candidates with the best bounds
first; once the k-th best score exceeds every bound that is left, it stops, and the result is exact.

Every row belongs to the cell of its nearest pivot. A query is first answered within its own cell; its k-th score there
is where it starts from in the others, and a cell whose best possible score lies below is not visited: the least and
greatest distance of the cell's rows to each pivot bound it as a whole. Cells and the queries that meet in one are
dealt out in blocks, one task for each pair of blocks; a pair keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.sources.shared import materialise

#: Pivots, drawn by a hash of vec_id; rows of a block of candidates and of queries.
PIVOTS, CANDIDATES, QUERIES = 16, 4096, 2048
#: Candidates that a query evaluates before it uses its k-th score.
FIRST = 256
#: Error that a distance's difference may have; `upper` in block_top() is widened by more than that amounts to.
SLACK = 3e-3


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v (array of longs, floor(scale * x) in double). Rows whose vec_id is null, or whose vector is null,
    empty or holds null or non-finite components, take no part. Rows that repeat a vec_id are rows like any other.

    A vector whose squares sum to 2^53 or more is an error: its scores couldn't be given exactly."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + (F.abs(c) * scale + 1) * (F.abs(c) * scale + 1))
    v = F.when(square < 2.0**53, F.transform("x", lambda c: F.floor(c * scale)))
    too_long = F.raise_error(F.concat(F.lit("scores of this vector exceed 2^53, vec_id "), F.col("vec_id").cast("string"))).cast("array<bigint>")
    return rows.select("vec_id", F.coalesce(v, too_long).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from a list column; shorter lists are padded with zeros."""
    out = np.zeros((len(column), width))
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), size), np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows of x by pivots."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best of the block: (query id, ids, scores), best first, ties to the smaller id; rows of the
    query's id are its own."""
    none = np.full(len(q), -np.inf)
    yield from ((int(q_ids[i]), found, score) for i, found, score in block_search(q_ids, q, distances(q, pivots), none, ids, ids, x, distances(x, pivots), pivots, k))


def block_search(
    q_rows: np.ndarray, q: np.ndarray, to_q: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, to_x: np.ndarray, pivots: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position of the query, ids, scores) as block_top(), for queries whose k-th score is `least` already: what can't
    reach it is not evaluated. q_rows and rows tell a query's own row; to_q and to_x are distances to the pivots."""
    order = np.argsort(ids, kind="stable")
    ids, x, rows, to_x = ids[order], x[order], rows[order], to_x[order]
    x_sq, q_sq = (x * x).sum(1), (q * q).sum(1)
    single = len(q) > 0 and len(x) > 0 and q_sq.max() * x_sq.max() < 2.0**46
    if len(q) and len(x) and len(pivots):
        # greatest sums of a query's and a candidate's distance to each pivot: what rounding is in proportion to
        near = np.sqrt(q_sq.max()) + np.sqrt(x_sq.max())
        reach = near + 2 * np.sqrt((pivots * pivots).sum(1))
        single = single and near * 2.0**-23 <= SLACK / 2
        use = reach * (2.0**-23 if single else 2.0**-44) <= SLACK  # a pivot too far off gives no bound
        to_x, to_q = to_x[:, use], to_q[:, use]
    if single:
        # no partial sum of a product reaches 2^24, so single precision is exact for these integers
        x, q, to_x, to_q, x_sq, q_sq = (a.astype(np.float32) for a in (x, q, to_x, to_q, x_sq, q_sq))
    to_x = np.ascontiguousarray(to_x.T)
    for at in range(0, len(q), 64):  # bounds for 64 queries at once
        part = slice(at, at + 64)
        low = np.zeros((len(q[part]), len(x)), dtype=x.dtype)
        gap = np.empty_like(low)
        for p in range(len(to_x)):
            np.subtract(to_q[part, p][:, None], to_x[p][None], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        # distances are rounded: the bound is widened by more than that can amount to
        both = q_sq[part][:, None] + x_sq[None]
        upper = (both - low * low) / 2 + both * np.asarray(1e-5, dtype=x.dtype) + 1
        upper[q_rows[part][:, None] == rows[None]] = -np.inf  # not the query's own
        for i, bound in enumerate(upper):
            me, floor = q[at + i], least[at + i]
            todo = np.flatnonzero(bound >= floor) if floor > -np.inf else np.flatnonzero(bound > -np.inf)
            if not len(todo):
                continue
            # the best bounds first, in growing steps; what can't reach the k-th score any more is left out
            got, score, kth = todo[:0], x[:0] @ me, floor
            step = FIRST if floor == -np.inf else 4 * FIRST
            while len(todo):
                if len(todo) > step:
                    part = np.argpartition(-bound[todo], step)
                    now, todo = todo[part[:step]], todo[part[step:]]
                else:
                    now, todo = todo, todo[:0]
                got, score = np.concatenate([got, now]), np.concatenate([score, x[now] @ me])
                if len(todo) and len(score) >= k:
                    kth = max(kth, np.partition(score, len(score) - k)[len(score) - k])
                    todo = todo[bound[todo] >= kth]
                step *= 4
            best = np.lexsort((ids[got], -score))[:k]
            yield at + i, ids[got[best]], score[best].astype(np.int64)


@dataclass
class Cells:
    """For each cell (pivot): rows, greatest squared length, and least and greatest distance to each pivot."""

    rows: np.ndarray
    square: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def open(self, square: np.ndarray, to_q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries by cells: whether a row of the cell could score `least`."""
        gap = np.maximum(0.0, np.maximum(self.low[None] - to_q[:, None, :], to_q[:, None, :] - self.high[None])).max(2)
        gap = np.maximum(0.0, gap - SLACK - gap * 2.0**-40)
        both = square[:, None] + self.square[None]
        return ((both - gap * gap) / 2 + both * 1e-5 + 1 >= least[:, None]) & (self.rows > 0)[None]


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k highest inner products of each query (all, if fewer).

    Queries: rows whose vec_id is divisible by `every`; candidates: every row but the query's own; ties to the smaller
    vec_id. Rows that repeat a vec_id are queries and candidates each, of each other too. What takes part: see
    quantised(). Vectors of different lengths are padded with zeros, which leaves inner products as they are. An empty
    table gives no rows. Other columns are ignored, whatever their names. Scores are exact.
    """
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "quantised")
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()]  # `pivots` rows
    table = np.unique(np.array([r + [0] * (dims - len(r)) for r in chosen], dtype=np.float64), axis=0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims)
            d = distances(x, table)
            near = pa.ListArray.from_arrays(np.arange(0, d.size + 1, len(table), dtype=np.int32), d.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, near, pa.array((x * x).sum(1)), pa.array(d.argmin(1).astype(np.int32))], [*b.schema.names, "near", "square", "cell"])

    # the distances to the pivots, once for each row
    rows = materialise(rows.mapInArrow(measure, "vec_id long, v array<long>, row long, near array<double>, square double, cell int"), "measured")
    places = range(len(table))
    ends = [f(F.col("near")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in places]
    found = rows.groupBy("cell").agg(F.count("*").alias("rows"), F.max("square").alias("square"), *ends).collect()  # a row for each pivot
    cells = Cells(np.zeros(len(table), np.int64), np.zeros(len(table)), np.zeros((len(table), len(table))), np.zeros((len(table), len(table))))
    for r in found:
        cells.rows[r.cell], cells.square[r.cell] = r.rows, r.square
        cells.low[r.cell], cells.high[r.cell] = [r[f"low{j}"] for j in places], [r[f"high{j}"] for j in places]

    def meet(queries: DataFrame) -> DataFrame:
        """query row and id, vec_id and score: the k best of every pair of blocks. queries: with cell and least."""
        sizes = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
        parts = spark.createDataFrame([(c, max(1, -(-int(cells.rows[c]) // CANDIDATES)), -(-m // QUERIES)) for c, m in sorted(sizes.items())], "cell int, parts int, q_parts int")
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(c)).cast("int")
        queries = queries.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "v", "near", "least", "cell")])
        left = queries.join(F.broadcast(parts), "cell").select("row", "vec_id", "v", "near", "least", "cell", spread("parts").alias("part"), deal("q_parts", 1).alias("q_part"))
        right = rows.join(F.broadcast(parts), "cell").select("row", "vec_id", "v", "near", "cell", deal("parts", 2).alias("part"), spread("q_parts").alias("q_part"))

        def run(q: pa.Table, c: pa.Table) -> pa.Table:
            out = []
            if len(q) and len(c):
                of = lambda t, name: t.column(name).to_numpy()
                near = lambda t: matrix(t.column("near").combine_chunks(), len(table))
                x = lambda t: matrix(t.column("v").combine_chunks(), dims)
                q_rows, q_ids = of(q, "row"), of(q, "vec_id")
                hits = block_search(q_rows, x(q), near(q), of(q, "least"), of(c, "row"), of(c, "vec_id"), x(c), near(c), table, k)
                out = [(int(q_rows[i]), int(q_ids[i]), ids.tolist(), s.tolist()) for i, ids, s in hits]
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("row", "query_id", "ids", "scores"), cols, kinds, strict=True)})

        key = ["cell", "part", "q_part"]
        got = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "row long, query_id long, ids array<long>, scores array<long>")
        each = got.select("row", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
        return each.select("row", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))

    def best(each: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k)

    queries = rows.where(F.col("vec_id") % every == 0)
    own = materialise(best(meet(queries.withColumn("least", F.lit(float("-inf"))))), "own_cell")
    kth = own.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("least"))
    known = queries.withColumnRenamed("cell", "own").join(kth, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            passes = cells.open(at["square"].to_numpy(), matrix(at["near"], len(table)), at["least"].to_numpy())
            passes[np.arange(len(b)), at["own"].to_numpy()] = False
            row, cell = np.nonzero(passes)
            take = [at[c].take(pa.array(row)) for c in ("row", "vec_id", "v", "near", "least")]
            yield pa.RecordBatch.from_arrays([*take, pa.array(cell.astype(np.int32))], ["row", "vec_id", "v", "near", "least", "cell"])

    routed = known.mapInArrow(route, "row long, vec_id long, v array<long>, near array<double>, least double, cell int")
    others = meet(materialise(routed, "routed"))
    return best(own.drop("rank").unionByName(others)).select("query_id", "rank", "vec_id", "score")
