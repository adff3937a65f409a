"""Exact top-k inner products by a Voronoi join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """Rows of little-endian int64."""
    buffers = [np.frombuffer(x.as_py(), "<i8") for x in column]
    return np.array(buffers, kind).reshape(len(buffers), dim)


def inner_products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All inner products, exactly: float64 matrices are taken to stay below 2**53; int64 products are
    taken modulo 2**64, which is exact where the result is a long, and OverflowError where it isn't."""
    if queries.dtype == np.float64:
        return queries @ data.T
    rough = queries.astype(np.float64) @ data.T.astype(np.float64)
    if rough.size and np.abs(rough).max() >= 2.0**63 * (1 - 1e-9):
        raise OverflowError("an inner product doesn't fit a 64-bit integer")
    return queries @ data.T


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, x array<bigint>): floor(scale * component); vectors with null or non-finite components are left out."""
    x = F.col(f"`{vector_col}`")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & F.col(f"`{id_col}`").isNotNull()).where(fine).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x")
    )


def cell_bounds(pivots: np.ndarray, radius_q: np.ndarray, count_q: np.ndarray, radius: np.ndarray, near: list[np.ndarray], k: int) -> np.ndarray:
    """needed[g, c]: may a query of cell g have one of its k best in cell c?

    Summaries only: `radius` is the largest distance from pivot c to its vectors,
    `near[c]` the distances of its closest k + 1. For a query q of cell g and a
    vector x of cell c at distance d from its pivot, q.x differs from
    p_g.p_c by at most |p_g| d + |p_c| R + R d with R the query radius of g. The
    (k + 1)-th best lower bound (one may be the query itself) is a floor for the
    k-th best score; cells whose upper bound lies below it cannot matter.
    """
    norm = np.linalg.norm(pivots, axis=1)
    dots = pivots @ pivots.T
    needed = np.zeros(dots.shape, bool)
    for g in np.flatnonzero(count_q):
        slack = lambda c, d: norm[g] * d + norm[c] * radius_q[g] + radius_q[g] * d
        lower = np.concatenate([dots[g, c] - slack(c, near[c]) for c in range(len(pivots)) if len(near[c])])
        floor = np.sort(lower)[-(k + 1)] if len(lower) > k else -np.inf
        upper = dots[g] + norm[g] * radius + norm * radius_q[g] + radius_q[g] * radius
        rounding = 1e-6 * (1 + abs(floor)) + 1e-9 * norm[g] * (norm + np.maximum(radius, 0))
        needed[g] = (upper >= floor - rounding) & (radius >= 0)
    return needed


def solve(query_rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, data: np.ndarray, k: int):
    """(query row, id, row, score) of each query's k best among the data; ties to the smaller id, then row; the own row left out."""
    order = np.lexsort((rows, ids))
    ids, rows, data = ids[order], rows[order], data[order]
    out_q, out_i, out_r, out_s = [], [], [], []
    for a in range(0, len(queries), 256):
        scores = inner_products(queries[a : a + 256], data)
        for row, q in zip(scores, query_rows[a : a + 256].tolist()):
            if len(row) > k + 1:
                cut = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                at = np.flatnonzero(row >= cut)
            else:
                at = np.arange(len(row))
            at = at[rows[at] != q]
            at = at[np.argsort(-row[at], kind="stable")[:k]]
            out_q.append(np.full(len(at), q, np.int64))
            out_i.append(ids[at])
            out_r.append(rows[at])
            out_s.append(row[at].astype(np.int64))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return joined(out_q), joined(out_i), joined(out_r), joined(out_s)


def exact_top_k(
    vectors: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    query_modulus: int = 20,
    pivots: int = 64,
    block: int = 2048,
    data_block: int = 16384,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `k` highest integer inner products.

    Queries are the vectors whose id is divisible by `query_modulus`; candidates
    are all other rows, ties going to the smaller id. Every vector joins the Voronoi
    cell of its nearest pivot; from each cell's summary (radius, distances of the
    k + 1 vectors next to the pivot, at most `pivots` of them) come the cells that
    a query cell can need. Queries of a cell and the vectors of the cells that
    they need meet in blocks of about `block` queries and `data_block` vectors, dealt
    by a hash of the row, so neither a crowded cell nor a vector that repeats often
    fills a task; blocks are solved by matrix products and their best k merged per
    query. Where bounds prune nothing, each block of vectors gives k rows a query.

    Vectors that are null, hold null or non-finite components, or whose length
    isn't the most common one take no part; nor do null ids. Rows that repeat an id
    are queries and candidates of their own: each such query row has its own ranks
    from 1, and the other rows of its id are candidates like any others. An empty
    table gives no rows. Other columns are ignored, whatever their names. Scores are
    exact whatever the components; one that doesn't fit a long raises OverflowError.
    """
    spark = vectors.sparkSession
    base = quantised(vectors, id_col, vector_col, scale)
    schema = "query_id long, rank int, vec_id long, score long"
    largest = F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double"))))).alias("largest")
    dims = base.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("count"), largest).orderBy(F.desc("count"), "n").limit(1).collect()
    if not dims or not dims[0]["n"]:
        return spark.createDataFrame([], schema)
    dim = dims[0]["n"]
    # products of doubles are exact, and much faster, where no score can reach 2**53
    kind = np.float64 if dim * dims[0]["largest"] ** 2 < 2.0**53 else np.int64
    base = base.where(F.size("x") == dim)
    chosen = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots).collect()
    centre = np.array([r["x"] for r in chosen], np.float64)

    def assign(batches):
        squares = (centre**2).sum(1)
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            y = x.astype(np.float64)
            far = squares[None, :] - 2 * (y @ centre.T) + (y**2).sum(1)[:, None]
            cell = far.argmin(1)
            distance = np.linalg.norm(y - centre[cell], axis=1)
            raw = [r.tobytes() for r in x.astype("<i8")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(raw, pa.binary())], ["id", "cell", "distance", "raw"]
            )

    celled = base.mapInArrow(assign, "id long, cell int, distance double, raw binary")
    celled = materialise(celled.withColumn("row", F.monotonically_increasing_id()), "cells")
    is_query = F.pmod(F.col("id"), F.lit(query_modulus)) == 0
    summary = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("distance").alias("radius"),
        F.count(F.when(is_query, 1)).alias("nq"),
        F.max(F.when(is_query, F.col("distance"))).alias("radius_q"),
    )
    count, count_q = np.zeros(len(centre), np.int64), np.zeros(len(centre), np.int64)
    radius, radius_q = np.full(len(centre), -1.0), np.zeros(len(centre))
    for r in summary.collect():  # one row per pivot
        count[r["cell"]], count_q[r["cell"]], radius[r["cell"]], radius_q[r["cell"]] = r["n"], r["nq"], r["radius"] + 1e-6, (r["radius_q"] or 0.0) + 1e-6
    near: list[np.ndarray] = [np.zeros(0) for _ in centre]
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    from pyspark.sql import Window

    closest = celled.select("cell", "distance", part.alias("part")).withColumn("r", F.row_number().over(Window.partitionBy("cell", "part").orderBy("distance")))
    closest = closest.where(F.col("r") <= k + 1).groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("distance")), 1, k + 1).alias("d"))
    for r in closest.collect():  # at most k + 1 numbers per pivot
        near[r["cell"]] = np.array(r["d"]) + 1e-6
    needed = cell_bounds(centre, radius_q, count_q, radius, near, k)

    # cells with queries are gathered into groups of about `block` queries, each cell's queries split if it has more
    groups: dict[int, list[int]] = {}
    fill, g = 0, -1
    for c in sorted(np.flatnonzero(count_q), key=lambda c: tuple(needed[c])):
        if g < 0 or fill + count_q[c] > block:
            g, fill = g + 1, 0
        groups.setdefault(g, []).append(int(c))
        fill += int(count_q[c])
    if not groups:
        return spark.createDataFrame([], schema)
    plan = []  # (group, query blocks, data blocks, data cells)
    group_of = np.full(len(centre), -1)
    for g, cells in groups.items():
        group_of[cells] = g
        wanted = np.flatnonzero(needed[cells].any(0))
        plan.append((g, max(1, -(-int(count_q[cells].sum()) // block)), max(1, -(-int(count[wanted].sum()) // data_block)), wanted))
    small = F.broadcast(spark.createDataFrame([(int(c), int(g), int(nq), int(nd)) for g, nq, nd, _ in plan for c in groups[g]], "cell int, g int, nq int, nd int"))
    large = F.broadcast(spark.createDataFrame([(int(c), int(g), int(nq), int(nd)) for g, nq, nd, wanted in plan for c in wanted], "cell int, g int, nq int, nd int"))
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    queries = celled.where(is_query).join(small, "cell").select("g", dealt("nq", 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("db"), "row", "raw")
    # new names, as both sides come from one table
    data = celled.join(large, "cell").select("g", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), dealt("nd", 2).alias("db"), F.col("id").alias("vid"), F.col("row").alias("vrow"), F.col("raw").alias("vraw"))
    data = data.select(F.col("g").alias("vg"), F.col("qb").alias("vqb"), F.col("db").alias("vdb"), "vid", "vrow", "vraw")

    def local(left, right):
        names = ["query_row", "vec_id", "vec_row", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        l, r = left.combine_chunks(), right.combine_chunks()
        found = solve(l["row"].to_numpy(), _matrix(l["raw"], dim, kind), r["vid"].to_numpy(), r["vrow"].to_numpy(), _matrix(r["vraw"], dim, kind), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names)

    best = queries.groupBy("g", "qb", "db").cogroup(data.groupBy("vg", "vqb", "vdb")).applyInArrow(local, "query_row long, vec_id long, vec_row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = celled.where(is_query).select(F.col("row").alias("query_row"), F.col("id").alias("query_id"))
    return best.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")
