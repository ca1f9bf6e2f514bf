"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are integers.  Rows are dealt to blocks: candidates to groups of about
`CANDIDATES`, queries to groups of at most about `QUERIES`; every pair of a
query group and a candidate group is one task's work, so neither side is ever
held whole by anyone.  In a task the candidates lie in vertical layout, one
row of the array for each dimension.  The scores are accumulated `BLOCK`
dimensions at a time, in order of the query's mass, and after each block the
candidates whose score can no longer reach the query's k-th best are dropped:
what the remaining dimensions can add is at most the product of the remaining
lengths of query and candidate (Cauchy-Schwarz), and the k-th largest of
score minus that is a floor that k candidates reach for sure.  The survivors
are compacted before the next block.  Each task returns k rows for each query,
which merge to the k best.

Edge cases: vectors that are null, empty, or hold null or non-finite
components take no part; a query meets candidates of its own length only; all
candidates are returned where there are fewer than k; equal scores go to the
smaller id; rows with a query's own id are never its candidates; repeated rows
are candidates each.  Sums beyond 2**53 are carried in 64-bit integers; where a
vector's square sum reaches 2**62, so that a score could pass 64 bits, the
search stops with an error instead of a wrong score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairgrade.session import materialize

BLOCK = 16
CANDIDATES, QUERIES = 20_000, 512


def scaled(vector, factor: int = 1024):
    """floor(factor * x) of each component as longs; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * F.lit(float(factor)))))


def best(query: np.ndarray, ids: np.ndarray, columns: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of `query` the ids and scores of its k best candidates.

    columns: one row for each dimension, one column for each candidate; own: the queries' ids, which are excluded."""
    wide = int(np.abs(query).max(initial=0)) * int(np.abs(columns).max(initial=0)) * len(columns) >= 1 << 53
    kind = np.int64 if wide else np.float64
    columns = columns.astype(kind)
    square = (columns.astype(np.float64) ** 2).reshape(len(columns), -1)
    out = []
    for q, me in zip(query, own, strict=True):
        order = np.argsort(-np.abs(q), kind="stable")
        q = q[order].astype(kind)
        alive = np.flatnonzero(ids != me)
        score = np.zeros(len(alive), kind)
        rest = square[:, alive].sum(0)
        for lo in range(0, len(q), BLOCK):
            dims = order[lo:lo + BLOCK]
            part = columns[dims] if len(alive) == columns.shape[1] else columns[np.ix_(dims, alive)]
            score = score + q[lo:lo + BLOCK] @ part
            if lo + BLOCK >= len(q) or len(alive) <= k:
                continue
            rest = np.maximum(rest - (square[dims] if part.shape[1] == columns.shape[1] else square[np.ix_(dims, alive)]).sum(0), 0)
            slack = np.sqrt(rest * float((q[lo + BLOCK:].astype(np.float64) ** 2).sum())) * (1 + 1e-9) + 1e-6
            floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
            keep = np.flatnonzero(score + slack >= floor)
            alive, score, rest = alive[keep], score[keep], rest[keep]
        top = np.lexsort((ids[alive], -score))[:k]
        out.append((ids[alive][top], score[top].astype(np.int64)))
    return out


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row for which `is_query` holds.

    vector: an integer array column (see `scaled`); null takes no part."""
    rows = materialize(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
                       .where(F.col("v").isNotNull() & F.col("id").isNotNull()).withColumn("n", F.size("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    counts = rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(square)).first()
    if (counts[2] or 0) >= 2.0 ** 62:
        raise ValueError(f"scores do not fit 64 bits: a vector has the square sum {counts[2]:.3g}, the bound is 2**62")
    n_groups, q_groups = max(1, -(-counts[0] // CANDIDATES)), max(1, -(-counts[1] // QUERIES))
    salt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", F.hash("v")), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.where("q").select("id", "v", "n", salt(q_groups, 1).alias("qg")).withColumn("cg", every(n_groups))
    held = rows.select("id", "v", "n", salt(n_groups, 2).alias("cg")).withColumn("qg", every(q_groups))

    def meet(ident: tuple, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        query, columns = np.stack(a["v"].to_numpy()), np.ascontiguousarray(np.stack(c["v"].to_numpy()).T)
        own = a["id"].to_numpy()
        found = best(query, c["id"].to_numpy(), columns, own, k)
        return pd.DataFrame({"query_id": np.repeat(own, [len(x) for x, _ in found]), "vec_id": np.concatenate([x for x, _ in found]), "score": np.concatenate([s for _, s in found])})

    met = (asked.groupBy("qg", "cg", "n").cogroup(held.groupBy("qg", "cg", "n")).applyInPandas(meet, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
