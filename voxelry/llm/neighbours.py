"""Nearest vectors by a block matrix join.

Queries and candidates are dealt into blocks of bounded size; a cell of the grid of query blocks and candidate blocks is
one group of a Spark shuffle. In a cell, vectors become int8 codes with a scale each, products of codes are tiles of one
exact integer product, and the norms of what the codes leave out bound the error of each product. Pairs whose upper
bound reaches the least of a query's heap (or the k-th lower bound of the tile) are computed again in double precision,
components added from left to right, and go into the heap. The cells' heaps of a query are merged by a window.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
different lengths are never compared; a row never finds itself, but other rows with its id are candidates like any
others; a null id is never a query and comes last among ties; fewer than k candidates are all returned; an empty table
gives no rows. Other columns of the input are not looked at. All pairs of a query and a candidate are bounded, none is
sampled; equal vectors, however many, are computed again like all that tie.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelry.storage import cut

#: Vectors of either kind that a cell of the grid has, about, at most and at least.
MOST_SIDE, LEAST_SIDE = 8192, 64
#: Candidates of a tile, components whose code products add up exactly in single precision, pairs computed again at once.
TILE, EXACT, AT_ONCE = 1024, 1024, 1 << 18
#: Added to every error, for products that are lost altogether.
SMALLEST = 1e-300


def usable(vector: str):
    """Whether a vector can take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes from -127 to 127 (as float32), scales, and upper bounds of the norms of the coded vectors and of the rests."""
    scale = np.abs(x).max(axis=1) / 127
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        codes = np.where(scale[:, None] > 0, np.rint(x / scale[:, None]), 0)
    codes = np.clip(np.nan_to_num(codes), -127, 127)
    coded = codes * scale[:, None]

    def norm(v: np.ndarray) -> np.ndarray:
        largest = np.abs(v).max(axis=1)
        unit = v / np.where(largest > 0, largest, 1)[:, None]  # neither squares of large nor of small numbers are lost
        return largest * np.sqrt((unit * unit).sum(axis=1)) * (1 + 1e-9)

    return codes.astype(np.float32), scale, norm(coded), norm(x - coded) + scale * 1e-12


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of codes, exact: each run of components stays below 2 ** 24."""
    out = (a[:, :EXACT] @ b[:, :EXACT].T).astype(np.float64)
    for at in range(EXACT, a.shape[1], EXACT):
        out += a[:, at : at + EXACT] @ b[:, at : at + EXACT].T
    return out


def left_to_right(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b (given by columns) in double precision, components added in order."""
    total = np.zeros(len(i))
    for x, y in zip(a, b, strict=True):
        total += x[i] * y[j]
    return total


def cell_heaps(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_id: list, k: int) -> list[list[tuple]]:
    """For each query its k best (score, minus id, id) of the cell, as a heap; None counts as the largest id."""
    heaps: list[list[tuple]] = [[] for _ in q_row]
    least = np.full(len(q_row), -np.inf)
    q_code, q_scale, q_norm, q_rest = quantised(q)
    q_columns = np.ascontiguousarray(q.T)
    q_full = q_norm + q_rest
    for at in range(0, len(c_row), TILE):
        part = slice(at, at + TILE)
        x, row, ids = c[part], c_row[part], c_id[part]
        code, scale, norm, rest = quantised(x)
        with np.errstate(over="ignore", invalid="ignore"):
            near = code_products(q_code, code) * (q_scale[:, None] * scale)
            error = (q_rest[:, None] * (norm + rest) + q_full[:, None] * rest) * (1 + 1e-9) + np.abs(near) * 1e-12 + SMALLEST
            lower = near - error
        own = q_row[:, None] == row
        lower[own] = -np.inf
        bound = least
        if len(row) > k:
            bound = np.fmax(least, np.partition(np.nan_to_num(lower, nan=-np.inf), len(row) - k, axis=1)[:, len(row) - k])
        # Written so that a product that is not a number is computed again.
        i, j = np.nonzero(~(near + error < bound[:, None]) & ~own)
        columns = np.ascontiguousarray(x.T)
        for a in range(0, len(i), AT_ONCE):
            qi, cj = i[a : a + AT_ONCE], j[a : a + AT_ONCE]
            for m, n, s in zip(qi.tolist(), cj.tolist(), left_to_right(q_columns, columns, qi, cj).tolist(), strict=True):
                name = ids[n]
                item = (s, -math.inf if name is None else -name, name)
                heap = heaps[m]
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, item)
        least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    lists = table.column("vector").combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(table.num_rows, -1), table.column("row").to_numpy(), table.column("id").to_pylist()


def grid(n_queries: int, n_candidates: int, tasks: int) -> tuple[int, int]:
    """Numbers of query and candidate blocks: square cells, at least one a task unless they get too small."""
    side = min(MOST_SIDE, max(LEAST_SIDE, math.isqrt(n_queries * n_candidates // max(tasks, 1))))
    return -(-n_queries // side), -(-n_candidates // side)


def nearest_vectors(vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` largest inner products."""
    numbered = vectors.where(usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    # Written, so that a row keeps its number whatever is computed again.
    rows = cut(numbered.withColumn("row", F.monotonically_increasing_id()))
    asks = F.col("id") % every == 0
    n = rows.agg(F.count("*"), F.count_if(asks)).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_q, n_c = grid(n[1], n[0], tasks) if n[1] else (1, 1)
    block = lambda b, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(b)).cast("int")
    dealt = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    columns = ("id", "row", "vector", F.size("vector").alias("dim"))
    queries = rows.where(asks).select(*columns, F.lit(True).alias("asks"), block(n_q, 1).alias("qb"), dealt(n_c).alias("cb"))
    candidates = rows.select(*columns, F.lit(False).alias("asks"), block(n_c, 2).alias("cb"), dealt(n_q).alias("qb"))
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(table: pa.Table) -> pa.Table:
        mask = table.column("asks")
        ask, have = table.filter(mask), table.filter(pa.compute.invert(mask))
        if not ask.num_rows or not have.num_rows:
            return schema.empty_table()
        (q, q_row, q_id), (c, c_row, c_id) = _rows(ask), _rows(have)
        found = cell_heaps(q, q_row, c, c_row, c_id, k)
        flat = [(int(q_row[m]), q_id[m], name, s) for m, heap in enumerate(found) for s, _, name in heap]
        return pa.Table.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*flat, strict=True), schema.types, strict=True)], schema=schema) if flat else schema.empty_table()

    heaps = queries.unionByName(candidates).groupBy("dim", "qb", "cb").applyInArrow(cell, "row long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return heaps.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB's SQL for :func:`nearest_vectors`: every query against every row.
ORACLE_SQL = """
with v as materialized (select row_number() over () r, vec_id, embedding::double[] e from embeddings
  where len(embedding) > 0 and len(embedding) = list_count(embedding) and isfinite(list_sum(embedding::double[])) and list_max(embedding) - list_min(embedding) + abs(list_max(embedding)) > 0),
s as (select q.r, q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by r order by score desc, vec_id nulls last))::int rank, vec_id, score from s
qualify rank <= 20
"""
