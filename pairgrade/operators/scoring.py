"""Score expressions and pair scoring on embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairgrade.functions.vectors import let


# ------------------------------------------------------------- probabilities

def argmax(p: Column) -> Column:
    """0-based class of the largest value; ties go to the lowest class."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("bigint")


def softmax(x: Column) -> Column:
    """Numerically safe softmax of an array column."""
    def shares(e):
        return let(F.aggregate(e, F.lit(0.0), lambda t, v: t + v), lambda total: F.transform(e, lambda v: v / total))

    def exps(s):
        return let(F.array_max(s).cast("double"), lambda top: let(
            F.transform(s, lambda v: F.exp(v.cast("double") - top)), shares))

    return let(x, exps)


def severe_score(p: Column) -> Column:
    """P(tier >= 3) as a double."""
    return F.get(p, 3).cast("double") + F.get(p, 4).cast("double")


def expected_level(p: Column) -> Column:
    return F.aggregate(F.transform(p, lambda v, k: v.cast("double") * k), F.lit(0.0), lambda s, v: s + v)


# ------------------------------------------------------------ vector algebra

def vec_sub(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double"))


def vec_mul(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))


def vec_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return vec_sum(vec_mul(x, y))


def slices(df: DataFrame, vec: str, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """Cut a feature array into named blocks: name -> (0-based start, length)."""
    return df.withColumns({n: F.slice(vec, s + 1, l) for n, (s, l) in parts.items()})


def pair_vectors(pairs: DataFrame, emb: DataFrame, id_col: str, vec: str, how: str = "inner") -> DataFrame:
    """Attach ``h_a`` and ``h_b``; equi joins on a unique key."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(emb.select(F.col(id_col).alias(side), F.col(vec).alias(f"h_{side}")), side, how)
    return out


def pair_ops(h_a: Column, h_b: Column) -> Column:
    """[h_a, h_b, h_a - h_b, h_a * h_b]; order matters, so pairs are canonical."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.concat(d(h_a), d(h_b), vec_sub(h_a, h_b), vec_mul(h_a, h_b))


def diagonal_scores(h_a: Column, h_b: Column, relations: Sequence[Sequence[float]]) -> Column:
    """sum_d h_a r_c h_b for every relation vector (a handful of literals)."""
    return let(vec_mul(h_a, h_b), lambda prod: F.array(*[dot(prod, _lit(r)) for r in relations]))


def complex_scores(h_a: Column, h_b: Column, relations: Sequence[Sequence[float]], half: int) -> Column:
    """Re(<h_a, r, conj(h_b)>) with vectors stored as Re followed by Im."""
    re = lambda x: F.slice(x, 1, half)
    im = lambda x: F.slice(x, half + 1, half)
    same = F.zip_with(vec_mul(re(h_a), re(h_b)), vec_mul(im(h_a), im(h_b)), lambda u, v: u + v)
    turn = F.zip_with(vec_mul(re(h_a), im(h_b)), vec_mul(im(h_a), re(h_b)), lambda u, v: u - v)
    return let(same, lambda s: let(turn, lambda t: F.array(*[
        dot(s, _lit(r[:half])) + dot(t, _lit(r[half:])) for r in relations])))


def bilinear_scores(df: DataFrame, matrices: Sequence[Sequence[Sequence[float]]], out: str) -> DataFrame:
    """h_a' W_c h_b per class, as a numpy product over Arrow batches.

    The matrices (classes x d x d, a model's parameters, which do not grow with
    the rows) are broadcast once; expressions would need d*d literals per class.
    """
    w = np.asarray(matrices, dtype=np.float64)
    shared = df.sparkSession.sparkContext.broadcast(w)

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        x, y = np.stack(a.to_numpy()).astype(np.float64), np.stack(b.to_numpy()).astype(np.float64)
        return pd.Series(list(np.einsum("ni,cij,nj->nc", x, shared.value, y, optimize=True)))

    return df.withColumn(out, F.pandas_udf(score, T.ArrayType(T.DoubleType()))("h_a", "h_b"))


def _lit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# ------------------------------------------------------------ batch inference

def score_pairs(queries: DataFrame, emb: DataFrame, id_col: str, vec: str, scorers: dict, left: str = "drug_a",
                right: str = "drug_b", n_classes: int = 5) -> DataFrame:
    """Grade query pairs with every scorer; rows with unknown ids stay, NULL.

    ``scorers``: name -> function (h_a, h_b) -> array of class scores.  Pairs
    are put in canonical order first because vectors are order dependent.
    """
    q = queries.withColumn("a", F.least(left, right)).withColumn("b", F.greatest(left, right))
    v = pair_vectors(q, emb, id_col, vec, how="left")
    known = F.col("h_a").isNotNull() & F.col("h_b").isNotNull()
    v = v.withColumn("in_index", known)
    for name, fn in scorers.items():
        v = v.withColumn(f"__p_{name}", F.when(known, softmax(fn(F.col("h_a"), F.col("h_b")))))
    cols = [F.when(F.col("in_index"), argmax(F.col(f"__p_{n}"))).alias(f"{n}_pred") for n in scorers]
    cols += [F.get(f"__p_{n}", c).alias(f"{n}_p{c}") for n in scorers for c in range(n_classes)]
    return v.select(*queries.columns, F.col("a").alias(f"{left}_canon"), F.col("b").alias(f"{right}_canon"),
                    "in_index", *cols)


def unknown_ids(queries: DataFrame, emb: DataFrame, id_col: str, left: str = "drug_a", right: str = "drug_b") -> DataFrame:
    ids = queries.select(F.explode(F.array(left, right)).alias(id_col)).distinct()
    return ids.join(emb.select(id_col), id_col, "left_anti")
