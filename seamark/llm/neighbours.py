"""Nearest neighbours by a block matrix join.

Candidates are dealt by a hash of their id to `ceil(n / TILE)` lanes and queries to `ceil(queries / QUERY_TILE)`;
each pair of a candidate lane and a query lane is one tile, so a task holds one tile whatever the table's size. Within a
tile, vectors are rounded to int8 with a scale each. The product of the int8 matrices gives the distance
of the rounded vectors, and the rounding errors' lengths bound how far the true one can be from it. Pairs
whose least possible distance is above the k-th least of the greatest possible ones drop out; the rest
are computed in double precision from the original vectors, and heaps of k merge blocks and tiles. The
result is exact.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take
no part. Finite vectors of any length do. Rows are meant to have distinct ids; of several with one id, the least vector counts. Vectors
are compared with those of the same dimension. Equal distances go to the smaller id. No rows give no
rows. Columns beside id and vector are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, TILE, QUERY_TILE, BLOCK = 10, 8192, 2048, 1024
PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def sound(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale for each row, and the length of each row's rounding error."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0.0) / 127.0, np.finfo(float).tiny)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, adding the squares in the order of the dimensions, as a plain loop would. Rows whose squares leave the range of a double are scaled by a power of two first."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore"):
        for j in range(a.shape[1]):
            total += (a[:, j] - b[:, j]) ** 2
        out = np.sqrt(total)
        odd = np.flatnonzero(~(total < np.inf) | (total < 1e-280))
        if len(odd):
            apart = a[odd] - b[odd]
            most = np.abs(apart).max(axis=1)
            fine = (most > 0) & (most < np.inf)
            odd, apart, unit = odd[fine], apart[fine], 2.0 ** np.floor(np.log2(most[fine]))
            out[odd] = np.sqrt(((apart / unit[:, None]) ** 2).sum(axis=1)) * unit
    return out


def matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_in_tile(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query, its k nearest of `vectors` other than rows of its own id, as (distance, id)."""
    whole = np.float32 if queries.shape[1] * 127 * 127 < 2**24 else np.float64  # sums of int8 products stay exact
    q_codes, q_scale, q_error = quantised(queries)
    q_wide = q_codes.astype(whole)
    q_norm = (q_codes.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
    best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    np.seterr(over="ignore", invalid="ignore")  # bounds of very long vectors are no numbers, and let their pairs through
    for at in range(0, len(ids), BLOCK):
        x, own = vectors[at : at + BLOCK], ids[at : at + BLOCK]
        codes, scale, error = quantised(x)
        product = (q_wide @ codes.astype(whole).T).astype(np.float64) * (q_scale[:, None] * scale)
        norm = (codes.astype(np.float64) ** 2).sum(axis=1) * scale**2
        about = np.sqrt(np.maximum(q_norm[:, None] + norm - 2 * product, 0))
        slack = q_error[:, None] + error + 1e-7 * (np.sqrt(q_norm)[:, None] + np.sqrt(norm)) + 1e-300
        same = query_ids[:, None] == own
        most = np.where(same, np.inf, about + slack)
        reach = np.partition(most, k - 1, axis=1)[:, k - 1] if len(own) > k else np.full(len(query_ids), np.inf)
        reach = np.minimum(reach, [b[-1][0] if len(b) == k else np.inf for b in best])
        rows, columns = np.nonzero(~(about - slack > reach[:, None]) & ~same)
        exact = np.empty(len(rows))
        for lo in range(0, len(rows), 65_536):
            part = slice(lo, lo + 65_536)
            exact[part] = distances(queries[rows[part]], x[columns[part]])
        order = np.lexsort((own[columns], exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        starts = np.searchsorted(rows, np.arange(len(query_ids) + 1))
        for i in np.unique(rows).tolist():
            part = slice(starts[i], min(starts[i] + k, starts[i + 1]))
            fresh = zip(exact[part].tolist(), own[columns[part]].tolist(), strict=True)
            best[i] = [x for x, _ in zip(heapq.merge(best[i], fresh), range(k), strict=False)]
    return best


def tile(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return PAIRS.empty_table()
        query_ids = queries.column("id").to_numpy()
        best = nearest_in_tile(matrix(queries, "vector"), query_ids, matrix(candidates, "vector"), candidates.column("id").to_numpy(), k)
        rows = [(q, i, d) for q, found in zip(query_ids.tolist(), best, strict=True) for d, i in found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, PAIRS.types, strict=True)], schema=PAIRS)

    return run


def search(table: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score (Euclidean distance) of the k nearest other rows of each row for which is_query holds."""
    rows = table.filter(F.col(id_col).isNotNull() & sound(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id", "asks").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    lanes, query_lanes = max(1, math.ceil(n / TILE)), max(1, math.ceil(asking / QUERY_TILE))
    # by a hash of the id, so that a task run again after a lost executor deals its rows to the same lanes
    dealt = lambda df, m: df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    spread = lambda df, m: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    candidates = spread(dealt(rows, lanes), query_lanes).select("dim", F.col("own").alias("lane"), F.col("other").alias("query_lane"), "id", "vector")
    queries = spread(dealt(rows.filter("asks"), query_lanes), lanes).select("dim", F.col("other").alias("lane"), F.col("own").alias("query_lane"), "id", "vector")
    keys = ["dim", "lane", "query_lane"]
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(tile(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_divisible(table: DataFrame, by: int = 100, k: int = K) -> DataFrame:
    return search(table, F.col("vec_id") % by == 0, k)
