"""Exact top-k inner-product search with a pivot table.

Distances of every vector to many pivots are stored once.  For a query q and a
candidate x, ``max_p |d(q,p) - d(x,p)|`` bounds their distance from below and
so their inner product from above.  Candidates are evaluated in the order of
that bound and a query stops as soon as no bound reaches its k-th best score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

PIVOTS = 32
PIVOT_SAMPLE = 2_000  # rows from which pivots are chosen, twice as many at most; only affects speed
HASHES = 1 << 20
FOUND = ("query_row", "query_id", "vec_id", "score")
NOTHING = pd.DataFrame({c: [] for c in FOUND}, dtype="int64")
BLOCK = 4_096  # candidates and queries per task
CHUNK = 256


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) per component as long.

    Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part.  Rows that repeat an id are rows of their own.
    """
    x = F.col(vector_column)
    usable = F.forall(x, lambda y: F.coalesce(F.abs(y) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(y, F.lit(0))))
    return (
        vectors.filter(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0))
        .filter(usable)
        .select(
            F.col(id_column).cast("long").alias("vec_id"),
            F.transform(x, lambda y: F.floor(y.cast("double") * scale).cast("long")).alias("v"),
        )
    )


def choose_pivots(sample: list[list[int]], pivots: int) -> dict[int, np.ndarray]:
    """Per dimension: the origin and vectors that are each farthest from those chosen before."""
    chosen = {}
    for dim in {len(v) for v in sample}:
        rows = np.array([v for v in sample if len(v) == dim], dtype=np.float64)
        taken = [np.zeros(dim)]
        far = (rows**2).sum(1)
        while len(taken) < pivots and far.max() > 0:
            taken.append(rows[int(far.argmax())])
            far = np.minimum(far, ((rows - taken[-1]) ** 2).sum(1))
        chosen[dim] = np.array(taken)
    return chosen


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """(row, vec_id, v, d, dim, near): distances ``d`` to the pivots and the nearest pivot, written once; ``row`` tells rows apart."""
    share = math.ceil(HASHES * sample / max(1, vectors.count()))
    rows = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(HASHES)) < share).limit(2 * sample).select("v").collect()
    chosen = choose_pivots([r.v for r in rows], pivots)

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["v"].map(len)
            for dim, part in batch.groupby(dims):
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                p = chosen.get(dim, np.zeros((1, dim)))
                d = np.sqrt(np.maximum(((v[:, None, :] - p[None]) ** 2).sum(2), 0)) if len(v) * p.size < 4e6 else np.stack(
                    [np.sqrt(((v - row) ** 2).sum(1)) for row in p], axis=1
                )
                yield pd.DataFrame({"row": part["row"].to_numpy(), "vec_id": part["vec_id"].to_numpy(), "v": list(part["v"]), "d": list(d), "dim": dim, "near": d.argmin(1)})

    schema = "row long, vec_id long, v array<long>, d array<double>, dim int, near int"
    return cut(vectors.withColumn("row", F.monotonically_increasing_id()).mapInPandas(distances, schema))


def _best(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query of another; exact."""
    x, q = np.stack(block["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    exact = x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) < 2**52  # sums of doubles are then whole numbers
    x, q = (x.astype(np.float64), q.astype(np.float64)) if exact else (x, q)
    dx, dq = np.stack(block["d"].to_numpy()), np.stack(queries["d"].to_numpy())
    xx, qq = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    ids, qids = block["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    rows, qrows = block["row"].to_numpy(), queries["row"].to_numpy()
    out = []
    for i in range(len(q)):
        low = np.zeros(len(x))
        for p in range(dx.shape[1]):
            np.maximum(low, np.abs(dx[:, p] - dq[i, p]), out=low)
        bound = (qq[i] + xx - low**2) / 2
        bound += 1e-9 * (qq[i] + xx) + 1e-6  # rounding of the stored distances
        order = np.argsort(-bound, kind="stable")
        scores, found = np.empty(0, x.dtype), np.empty(0, ids.dtype)
        for start in range(0, len(order), CHUNK):
            if len(scores) >= k and bound[order[start]] < scores[k - 1]:
                break
            part = order[start : start + CHUNK]
            part = part[rows[part] != qrows[i]]
            scores, found = np.concatenate([scores, x[part] @ q[i]]), np.concatenate([found, ids[part]])
            keep = np.lexsort((found, -scores))[:k]
            scores, found = scores[keep], found[keep]
        out.append(pd.DataFrame({"query_row": qrows[i], "query_id": qids[i], "vec_id": found, "score": scores.astype(np.int64)}))
    return pd.concat(out, ignore_index=True) if out else NOTHING


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 1024,
    pivots: int = PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    ``is_query`` is a condition on ``vec_id``.  Candidates are all rows but the
    query's own, rows of the same id included; rows that repeat a query's id are
    queries of their own; ties go to the smaller id; fewer than k candidates give fewer
    rows.  Only vectors of equal length meet.  An empty table gives no rows.
    Blocks of candidates (split by nearest pivot, then by id) meet blocks of
    queries, so neither side is ever held whole.
    """
    table = pivot_table(integer_vectors(vectors, id_column, vector_column, scale), pivots)
    queries = table.filter(is_query).toDF(*table.columns)
    counts = table.groupBy("dim", "near").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    parts = cut(counts.select("dim", "near", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    ways = cut(counts.groupBy("dim").agg(F.greatest(F.ceil(F.sum("q") / block), F.lit(1)).cast("int").alias("ways")))
    blocks = parts.select("dim", "near", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    slot = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")

    candidates = (
        table.join(F.broadcast(parts), ["dim", "near"])  # at most ``pivots`` rows a dimension
        .withColumn("part", slot("parts"))
        .join(F.broadcast(ways), "dim")
        .withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
        .select("dim", "near", "part", "way", "row", "vec_id", "v", "d")
    )
    asked = (
        queries.join(F.broadcast(ways), "dim")
        .select("dim", slot("ways").alias("way"), "row", "vec_id", "v", "d")
        .join(blocks, "dim")  # every query meets every block of its length once
        .select("dim", "near", "part", "way", "row", "vec_id", "v", "d")
    )
    keys = ["dim", "near", "part", "way"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in FOUND])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return NOTHING
        return _best(left, right, k)

    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(search, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: list[tuple], k: int, scale: int = 1024) -> list[tuple]:
    """The same by comparing everything; for tests."""
    vectors = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((i, [math.floor(x * scale) for x in v]))
    out = []
    for row, (i, v) in enumerate(vectors):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for other, (j, w) in enumerate(vectors) if other != row and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)
