"""Bookkeeping of prediction runs: keys, unions, grids, alignment, matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Seed positions and run-id strides of the published protocol.
SEED_INDEX = {42: 0, 123: 1, 2024: 2}
PAIR_STRIDE, DRUG_BASE, DRUG_STRIDE = 15, 1000, 6
HOLDOUT_NAMES = ("test", "holdout", "", "none")


def norm_test_set(c: Column) -> Column:
    return F.when(F.lower(F.coalesce(c, F.lit(""))).isin(*HOLDOUT_NAMES), "test").otherwise(c)


def norm_fold(split: Column, fold: Column) -> Column:
    """Cold-start runs have no fold; families store 0 or 1 for it."""
    return F.when(split == "drug", F.lit(0).cast("bigint")).otherwise(fold)


def run_key(method: Column, fold: Column, seed: Column, split: Column | None = None,
            test_set: Column | None = None) -> Column:
    parts = [method, F.concat(F.lit("f"), fold.cast("string")), F.concat(F.lit("s"), seed.cast("string"))]
    return F.concat_ws("_", *parts, *[c for c in (split, test_set) if c is not None])


def _seed_index(seed: Column) -> Column:
    return F.coalesce(*[F.when(seed == s, F.lit(i)) for s, i in SEED_INDEX.items()])


def pair_run_id(method_index: Column, fold: Column, seed: Column) -> Column:
    return (method_index * PAIR_STRIDE + (fold - 1) * len(SEED_INDEX) + _seed_index(seed)).cast("bigint")


def drug_run_id(method_index: Column, seed: Column, part: Column) -> Column:
    return (DRUG_BASE + method_index * DRUG_STRIDE + _seed_index(seed) * 2
            + F.when(part == "S1", 0).otherwise(1)).cast("bigint")


def pair_holdout(df: DataFrame) -> DataFrame:
    return df.where((F.col("split") == "pair") & F.col("test_set").isin("test", "holdout"))


def cold_start(df: DataFrame, test_set: str | None = None) -> DataFrame:
    m = (F.col("split") == "drug") | F.col("test_set").isin("S1", "S2")
    return df.where(m if test_set is None else m & (F.col("test_set") == test_set))


def single_run(df: DataFrame, method: str, fold: int, seed: int) -> DataFrame:
    """Rows of exactly one run; more than one split or test set is an error."""
    r = df.where((F.col("method") == method) & (F.col("fold") == fold) & (F.col("seed") == seed))
    kinds = r.agg(F.count_distinct("split", "test_set")).scalar()
    bad = F.raise_error(F.lit(f"not exactly one run {method} fold {fold} seed {seed}"))
    return r.where(F.when(kinds == 1, F.lit(True)).otherwise(bad.cast("boolean")))


def duplicate_keys(runs: DataFrame) -> DataFrame:
    """Keys (method, fold, seed, normalised test set) present more than once."""
    return (runs.groupBy("method", "fold", "seed", norm_test_set(F.col("test_set")).alias("test_set"))
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def union_unique(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of run tables (a row per run); a repeated key stops the job."""
    out = first
    for o in others:
        out = out.unionByName(o)
    w = Window.partitionBy("method", "fold", "seed", norm_test_set(F.col("test_set")))
    bad = F.raise_error(F.concat_ws(" ", F.lit("repeated run"), run_key(F.col("method"), F.col("fold"), F.col("seed"))))
    return (out.withColumn("__n", F.count(F.lit(1)).over(w))
            .where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(bad.cast("boolean"))).drop("__n"))


def prefer_primary(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    return primary.unionByName(fallback.join(primary.select(*keys), list(keys), "left_anti"))


def grid_check(runs: DataFrame, methods: Sequence[str], folds: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """Expected grid against present runs: ok, error, missing or extra."""
    lit = lambda vs, t: F.explode(F.array(*[F.lit(v).cast(t) for v in vs]))
    grid = (runs.sparkSession.range(1).select(lit(methods, "string").alias("method"))
            .withColumn("fold", lit(folds, "bigint")).withColumn("seed", lit(seeds, "bigint"))
            .withColumn("__want", F.lit(True)))
    have = runs.select("method", "fold", "seed", F.col("error").isNotNull().alias("__err"), F.lit(True).alias("__have"))
    j = grid.join(have, ["method", "fold", "seed"], "full")
    status = (F.when(F.col("__have").isNull(), "missing").when(F.col("__want").isNull(), "extra")
              .when(F.col("__err"), "error").otherwise("ok"))
    return j.select("method", "fold", "seed", status.alias("status"))


def display_label(df: DataFrame, labels: DataFrame, method: str = "method") -> DataFrame:
    l = labels.select(F.col("method").alias(method), F.col("label").alias("__l"))
    return df.join(l, method, "left").withColumn("label", F.coalesce("__l", method)).drop("__l")


def match_runs(runs: DataFrame, method_a: str, others: Sequence[str] | None = None) -> DataFrame:
    """Pairs of runs of ``method_a`` and every other method on equal keys.

    ``runs`` has a row per run.  Test-set names are normalised, the fold of
    cold-start runs is ignored, the first run per key counts.
    """
    r = runs.select("method", norm_fold(F.col("split"), F.col("fold")).alias("fold"), "seed", "split",
                    norm_test_set(F.col("test_set")).alias("test_set")).distinct()
    key = ["fold", "seed", "split", "test_set"]
    a = r.where(F.col("method") == method_a).withColumnRenamed("method", "method_a")
    b = r.where((F.col("method") != method_a) if others is None else F.col("method").isin(*others))
    return a.join(b.withColumnRenamed("method", "method_b"), key).select("method_a", "method_b", *key)


def align(rows_a: DataFrame, rows_b: DataFrame, on: Sequence[str] = ("fold", "seed", "split", "test_set")) -> DataFrame:
    """Rows of two runs side by side on ``row_id``; the label is A's.

    Both sides are unique per (run, row_id), so the join never multiplies.
    """
    a = rows_a.select(F.col("method").alias("method_a"), *on, "row_id", "y_true", F.col("y_pred").alias("pred_a"))
    b = rows_b.select(F.col("method").alias("method_b"), *on, "row_id", F.col("y_true").alias("y_b"),
                      F.col("y_pred").alias("pred_b"))
    return a.join(b, [*on, "row_id"])


def align_report(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    return aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("y_true") != F.col("y_b")).alias("label_conflicts"))


def align_single(rows_a: DataFrame, prior: DataFrame, on: Sequence[str] = ("fold", "seed", "split", "test_set")) -> DataFrame:
    """One deterministic run (first by seed, fold) against every run of A."""
    first = prior.agg(F.min(F.struct("seed", "fold"))).scalar()
    p = prior.where(F.struct("seed", "fold") == first)
    b = p.select(F.col("method").alias("method_b"), "row_id", F.col("y_true").alias("y_b"), F.col("y_pred").alias("pred_b"))
    a = rows_a.select(F.col("method").alias("method_a"), *on, "row_id", "y_true", F.col("y_pred").alias("pred_a"))
    return a.join(b, "row_id")


def stable_order(df: DataFrame, method_order: Sequence[str]) -> DataFrame:
    """Add the position used for listing: fixed method order, unknown last.

    ``df`` is a run-level table (a row per run).
    """
    pos = F.coalesce(*[F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(method_order)],
                     F.lit(len(method_order)))
    w = Window.partitionBy(F.lit(0)).orderBy("split", "test_set", pos, "method", "fold", "seed")
    return df.withColumn("position", F.row_number().over(w).cast("bigint"))


def best_config(results: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Best finished configuration; failed rows have no metric or an error."""
    ok = results.where(F.col("error").isNull() & F.col(metric).isNotNull())
    cols = [c for c in results.columns if c not in (*by, "error")]
    rest = [c for c in cols if c != metric]  # breaks ties, so a re-run picks the same row
    best = F.max_by(F.struct(*cols), F.struct(metric, *rest))
    return ok.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def long_cell(table: DataFrame, metric: str, alpha: float | None, beta: float | None, **eq) -> DataFrame:
    """The one row of a long result table at (alpha, beta); NULL budgets for
    reference rows.  Anything but one row stops the job."""
    near = lambda c, v: F.col(c).isNull() if v is None else (F.abs(F.col(c) - v) < 1e-9)
    cond = (F.col("metric") == metric) & near("alpha", alpha) & near("beta", beta)
    for k, v in eq.items():
        cond = cond & (F.col(k) == v)
    hit = table.where(cond)
    n = hit.agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    bad = F.raise_error(F.concat(F.lit(f"{metric}: rows found "), F.col("n").cast("string")))
    return n.select("mean", "sd", F.when(F.col("n") == 1, F.col("n")).otherwise(bad.cast("bigint")).alias("n"))


def budget_curve(table: DataFrame, metric: str, beta: float, alphas: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Mean over alpha at a fixed beta, one column per alpha."""
    t = table.where((F.col("metric") == metric) & (F.abs(F.col("beta") - beta) < 1e-9))
    return t.groupBy(*by).agg(*[
        F.max(F.when(F.abs(F.col("alpha") - a) < 1e-9, F.col("mean"))).alias(f"a_{a:g}".replace(".", "_"))
        for a in alphas])
