"""Ordinal evaluation of prediction runs.

Everything that is a function of hard labels is computed from confusion
cells: one aggregation to (run, y_true, y_pred) counts with map-side partials,
then arithmetic on at most 25 rows per run.  Score curves count equal scores
first and use exact running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairgrade.functions.ordering import add_running, exact_quantile, unit_bucket, width_bucket

CLASSES = range(5)
HIGH = 3

# Metrics where a larger value is worse, aliases of metric names.
LOWER_IS_BETTER = ("severe_underestimation_rate", "mae_ordinal")
METRIC_ALIASES = {"acc": "accuracy", "f1": "macro_f1", "macro-f1": "macro_f1", "macro_F1": "macro_f1",
                  "kappa": "qwk", "QWK": "qwk", "mae": "mae_ordinal", "MAE": "mae_ordinal"}


# ------------------------------------------------------------ confusion cells

def confusion_cells(df: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred",
                    weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys, F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(n.alias("n"))


def normalized_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-normalised confusion matrix (share of each true class)."""
    w = Window.partitionBy(*keys, "y_true")  # at most 5 rows
    return cells.withColumn("share", F.col("n") / F.sum("n").over(w))


def _s(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def cell_totals(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run with every sum the hard-label metrics need."""
    y, p = F.col("y_true"), F.col("y_pred")
    aggs = [F.sum("n").alias("n")]
    for c in CLASSES:
        aggs += [_s((y == c) & (p == c)).alias(f"tp{c}"), _s(y == c).alias(f"s{c}"), _s(p == c).alias(f"q{c}")]
    aggs += [_s(F.abs(y - p) <= 1).alias("n_adj"), F.sum(F.abs(y - p) * F.col("n")).alias("abs_err"),
             _s(y >= HIGH).alias("n_high"), _s(y < HIGH).alias("n_low"),
             _s((y >= HIGH) & (p >= HIGH)).alias("hit_high"), _s((y < HIGH) & (p < HIGH)).alias("hit_low"),
             _s((y >= HIGH) & (p <= 1)).alias("n_under"),
             F.sum((y - p) * (y - p) * F.col("n")).alias("d2"),
             F.sum(y * F.col("n")).alias("sy"), F.sum(p * F.col("n")).alias("sp"),
             F.sum(y * y * F.col("n")).alias("sy2"), F.sum(p * p * F.col("n")).alias("sp2")]
    return cells.groupBy(*keys).agg(*aggs)


def _ratio(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, b)


def precision(c: int) -> Column:
    return F.coalesce(_ratio(f"tp{c}", f"q{c}"), F.lit(0.0))


def recall(c: int) -> Column:
    return F.coalesce(_ratio(f"tp{c}", f"s{c}"), F.lit(0.0))


def f1(c: int) -> Column:
    """2tp / (support + predicted); 0 when the class occurs nowhere."""
    return F.coalesce(_ratio(2 * F.col(f"tp{c}"), F.col(f"s{c}") + F.col(f"q{c}")), F.lit(0.0))


def _total(cols) -> Column:
    out = None
    for c in cols:
        out = c if out is None else out + c
    return out


def accuracy() -> Column:
    return _ratio(_total(F.col(f"tp{c}") for c in CLASSES), "n")


def macro_f1(classes=CLASSES) -> Column:
    classes = list(classes)
    return _total(f1(c) for c in classes) / F.lit(float(len(classes)))


def weighted_f1() -> Column:
    return _ratio(_total(f1(c) * F.col(f"s{c}") for c in CLASSES), "n")


def adjacent_accuracy() -> Column:
    return _ratio("n_adj", "n")


def mae() -> Column:
    return _ratio("abs_err", "n")


def sensitivity() -> Column:
    return _ratio("hit_high", "n_high")


def specificity() -> Column:
    return _ratio("hit_low", "n_low")


def underestimation() -> Column:
    return _ratio("n_under", "n_high")


def qwk() -> Column:
    """Quadratic weighted kappa from moments; 1 when nothing can disagree."""
    d = lambda c: F.col(c).cast("double")
    expected = d("sy2") + d("sp2") - F.lit(2.0) * d("sy") * d("sp") / d("n")
    return F.when(F.col("n") <= 0, F.lit(None)).when(expected == 0, F.lit(1.0)).otherwise(
        1.0 - d("d2") / expected)


HARD_METRICS = {
    "accuracy": accuracy, "macro_f1": macro_f1, "weighted_f1": weighted_f1,
    "adjacent_acc": adjacent_accuracy, "high_risk_sens": sensitivity, "high_risk_spec": specificity,
    "severe_underestimation_rate": underestimation, "qwk": qwk, "mae_ordinal": mae,
}


def hard_metrics(cells: DataFrame, keys: Sequence[str], names: Sequence[str] = tuple(HARD_METRICS)) -> DataFrame:
    t = cell_totals(cells, keys)
    return t.select(*keys, *[HARD_METRICS[m]().alias(m) for m in names])


def severity_metrics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro-F1 over labels 1..4 and QWK on rows whose true tier is >= 1."""
    t = cell_totals(cells.where(F.col("y_true") >= 1), keys)
    return t.select(*keys, macro_f1(range(1, 5)).alias("macro_f1_sev"), qwk().alias("qwk_sev"))


def per_class_report(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = cell_totals(cells, keys)
    rows = F.array(*[F.struct(
        F.lit(c).cast("bigint").alias("cls"),
        _ratio(F.col("n") - F.col(f"s{c}") - F.col(f"q{c}") + 2 * F.col(f"tp{c}"), "n").alias("ovr_accuracy"),
        precision(c).alias("precision"), recall(c).alias("recall"), f1(c).alias("f1"),
        F.col(f"s{c}").alias("support")) for c in CLASSES])
    return t.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


# ------------------------------------------------------------- score curves

def class_scores(runs: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y_true") -> DataFrame:
    """Distinct (run, class, score) with positive and negative counts.

    Class numbers are exploded, not ``p`` itself: exploding a computed array
    repeats its expression in an inferred size filter.
    """
    x = runs.select(*keys, F.col(y).alias("__y"), F.col(p).alias("__p"),
                    F.explode(F.array(*[F.lit(c).cast("bigint") for c in CLASSES])).alias("cls"))
    x = x.select(*keys, "cls", "__y", F.get("__p", F.col("cls").cast("int")).alias("score"))
    return binary_scores(x, [*keys, "cls"], "score", F.col("__y") == F.col("cls"))


def binary_scores(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    pos = F.count_if(positive).alias("pos")
    return df.groupBy(*keys, F.col(score).alias("score")).agg(pos, F.count_if(~positive).alias("neg"))


def running_curve(scores: DataFrame, keys: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """tp, fp counted from the highest score down, and class totals."""
    b = unit_bucket("score") if bucket is None else bucket
    return add_running(scores, keys, "score", b, {"pos": "tp", "neg": "fp"},
                       {"pos": "n_pos", "neg": "n_neg"}, descending=True)


def auroc(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under ROC with ties counted half; NULL when a side is empty."""
    d = lambda c: F.col(c).cast("double")
    area = F.sum(d("neg") * (d("tp") - d("pos") / 2.0))
    return curve.groupBy(*keys).agg(
        F.try_divide(area, F.max(d("n_pos")) * F.max(d("n_neg"))).alias("auroc"))


def average_precision(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step-wise average precision, equal scores taken together."""
    d = lambda c: F.col(c).cast("double")
    return curve.groupBy(*keys).agg(F.try_divide(
        F.sum(d("pos") * d("tp") / (d("tp") + d("fp"))), F.max(d("n_pos"))).alias("ap"))


def auroc_and_ap(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return curve.groupBy(*keys).agg(
        F.try_divide(F.sum(d("neg") * (d("tp") - d("pos") / 2.0)),
                     F.max(d("n_pos")) * F.max(d("n_neg"))).alias("auroc"),
        F.try_divide(F.sum(d("pos") * d("tp") / (d("tp") + d("fp"))), F.max(d("n_pos"))).alias("ap"))


def macro_ranking(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro AUROC and AP over the classes that occur."""
    per = auroc_and_ap(running_curve(class_scores(runs, keys), [*keys, "cls"]), [*keys, "cls"])
    return per.groupBy(*keys).agg(F.avg("auroc").alias("macro_auroc"), F.avg("ap").alias("macro_ap"))


def metrics_table(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All scalars and the per-class F1 of every run."""
    t = cell_totals(confusion_cells(runs, keys), keys)
    hard = t.select(*keys, F.col("n").alias("n_eval"), *[m().alias(k) for k, m in HARD_METRICS.items()],
                    *[f1(c).alias(f"f1_c{c}") for c in CLASSES])
    return hard.join(macro_ranking(runs, keys), list(keys))


def metric_by_name(table: DataFrame, keys: Sequence[str], name: str, runs: DataFrame | None = None) -> DataFrame:
    """One metric of every run by its name or an alias.

    A ranking metric that ``table`` lacks is computed from the rows ``runs``:
    with probabilities ``p``, else with the one-hot of the prediction.
    """
    key = METRIC_ALIASES.get(name, name)
    if key not in table.columns and runs is not None and key in ("macro_auroc", "macro_ap"):
        if "p" not in runs.columns:
            runs = runs.withColumn("p", F.array(*[(F.col("y_pred") == c).cast("double") for c in CLASSES]))
        table = macro_ranking(runs, keys)
    if key not in table.columns:
        raise ValueError(f"no metric {name}")
    return table.select(*keys, F.lit(key).alias("metric"), F.col(key).alias("value"))


# ---------------------------------------------------------------- run tables

def long_metrics(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return table.unpivot(list(keys), list(metrics), "metric", "value")


def mean_sd(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population SD over finite values; NULL when there is none."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return long.groupBy(*by, "metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
                                           F.count(v).alias("n_runs"))


def best_flag(summary: DataFrame, by: Sequence[str] = (), tolerance: float = 1e-12) -> DataFrame:
    """Best methods per metric; ties within the tolerance share the flag."""
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    s = summary.withColumn("__v", F.col("mean") * sign)
    w = Window.partitionBy(*by, "metric")  # a row per method
    return s.withColumn("is_best", F.coalesce(F.abs(F.col("__v") - F.max("__v").over(w)) <= tolerance,
                                              F.lit(False))).drop("__v")


def coldstart_wide(long: DataFrame, test_sets: Sequence[str] = ("S1", "S2")) -> DataFrame:
    g = long.groupBy("method", "metric").pivot("test_set", list(test_sets)).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
    return g


def representative_run(table: DataFrame, by: Sequence[str] = ("method",), metric: str = "macro_f1") -> DataFrame:
    """Per method the run closest to the median; distances equal to 12 digits
    are ties, which go to the lower fold, then seed.

    ``table`` has one row per run, so these windows are over a few rows.
    """
    med = table.groupBy(*by).agg(F.percentile(metric, F.lit(0.5)).alias("median"))
    j = table.join(med, list(by))
    order = Window.partitionBy(*by).orderBy(
        F.round(F.abs(F.col(metric) - F.col("median")), 12), "fold", "seed")
    return j.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def operating_curve(runs: DataFrame, keys: Sequence[str], thresholds=(0.5, 0.3, 0.2, 0.1, 0.05),
                    score: str = "r") -> DataFrame:
    """High-tier sensitivity and false-high rate at each point, in one pass.

    Thresholds become columns of one aggregation instead of copies of rows.
    """
    points = [("argmax", F.col("y_pred") >= HIGH)] + [(f"t = {t:g}", F.col(score) >= t) for t in thresholds]
    high, low = F.col("y_true") >= HIGH, F.col("y_true").isin(1, 2)
    aggs = [F.count_if(high).alias("nh"), F.count_if(low).alias("nl")]
    for i, (_, c) in enumerate(points):
        aggs += [F.count_if(high & c).alias(f"h{i}"), F.count_if(low & c).alias(f"l{i}")]
    g = runs.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("point"), F.try_divide(f"h{i}", "nh").alias("ht_sens"),
                              F.try_divide(f"l{i}", "nl").alias("false_high"))
                     for i, (n, _) in enumerate(points)])
    return g.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def curve_summary(curve: DataFrame) -> DataFrame:
    return curve.groupBy("method", "point").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("ht_sens").alias("ht_sens_mean"), F.stddev_pop("ht_sens").alias("ht_sens_sd"),
        F.avg("false_high").alias("false_high_mean"), F.stddev_pop("false_high").alias("false_high_sd"))


# ------------------------------------------------------- curves on a grid

GRID = 100


def _interpolate(points: DataFrame, keys: Sequence[str], first: Column) -> DataFrame:
    """Linear interpolation of (x, y) points at x = 0, 1/100, .. 1.

    ``points`` has a ``pt`` struct that sorts along the curve and holds x and
    y.  Each point falls in one grid cell, of which only the first and last
    point matter; the 101-row grid then looks left and right.
    """
    cell = F.ceil(F.col("pt.x100")).cast("int")
    cells = points.groupBy(*keys, cell.alias("g")).agg(F.min("pt").alias("lo"), F.max("pt").alias("hi"))
    grid = points.select(*keys).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    j = grid.join(cells, [*keys, "g"], "left")
    w = Window.partitionBy(*keys).orderBy("g")  # 101 rows
    left = F.coalesce(F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first)
    right = F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    j = j.withColumn("l", left).withColumn("r", right)
    x = F.col("g").cast("double")
    slope = (F.col("r.y") - F.col("l.y")) / (F.col("r.x100") - F.col("l.x100"))
    y = F.when(F.col("r").isNull() | (F.col("l.x100") == x), F.col("l.y")).otherwise(
        F.col("l.y") + slope * (x - F.col("l.x100")))
    return j.select(*keys, F.col("g").cast("bigint").alias("g"), y.alias("value"))


def _point(order: list[Column], x100: Column, y: Column) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)],
                    x100.alias("x100"), y.alias("y"))


def roc_pr_grid(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro-average ROC and PR curves on a 101-point grid."""
    k = [*keys, "cls"]
    c = running_curve(class_scores(runs, keys), k).where("n_pos > 0 and n_neg > 0")
    d = lambda n: F.col(n).cast("double")
    zero = F.lit(0).cast("bigint")
    roc = c.select(*k, _point([F.col("fp"), F.col("tp")], d("fp") * 100.0 / d("n_neg"),
                              d("tp") / d("n_pos")).alias("pt"))
    roc0 = _point([zero, zero], F.lit(0.0), F.lit(0.0))
    pr = c.select(*k, _point([F.col("tp"), F.col("fp")], d("tp") * 100.0 / d("n_pos"),
                             d("tp") / (d("tp") + d("fp"))).alias("pt"))
    pr0 = _point([zero, zero], F.lit(0.0), F.lit(1.0))
    r = _interpolate(roc, k, roc0).withColumn(
        "value", F.when(F.col("g") == 0, 0.0).when(F.col("g") == GRID, 1.0).otherwise(F.col("value")))
    p = _interpolate(pr, k, pr0)
    both = r.withColumn("curve", F.lit("roc")).unionByName(p.withColumn("curve", F.lit("pr")))
    return both.groupBy(*keys, "curve", "g").agg(F.avg("value").alias("value"))


# ------------------------------------------------------------ weights, losses

def class_weights(df: DataFrame, y: str, keys: Sequence[str] = (), fixed_classes: int | None = None) -> DataFrame:
    """Balanced weights n / (K n_c): K = classes present, or a fixed number
    with every class counted at least once."""
    keys = list(keys)
    counts = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("n_c"))
    if fixed_classes:
        grid = counts.select(*keys).distinct() if keys else df.sparkSession.range(1)
        every = F.array(*[F.lit(c).cast(df.schema[y].dataType) for c in range(fixed_classes)])
        grid = grid.select(*keys, F.explode(every).alias(y))
        counts = grid.join(counts, [*keys, y], "left").withColumn(
            "n_c", F.greatest(F.coalesce("n_c", F.lit(0)), F.lit(1)))
    w = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])  # a row per class
    k = F.lit(fixed_classes) if fixed_classes else F.count(F.lit(1)).over(w)
    return counts.select(*keys, y, (F.sum("n_c").over(w) / (k * F.col("n_c"))).alias("weight"))


def log_loss(runs: DataFrame, weights: DataFrame, keys: Sequence[str], gamma: float = 2.0,
             smoothing: float = 0.1, p: str = "p", y: str = "y_true", floor: float = 1e-15) -> DataFrame:
    """Class-weighted cross entropy and focal loss with label smoothing.

    Weights have at most five rows; they are joined as one literal-sized map.
    """
    wmap = weights.agg(F.map_from_entries(F.collect_list(F.struct(y, "weight"))).alias("__w"))
    x = runs.withColumn("__w", wmap.scalar())
    lnp = F.transform(p, lambda v: F.log(F.greatest(v.cast("double"), F.lit(floor))))
    w_y = F.try_element_at("__w", F.col(y))
    nll = -F.get(lnp, F.col(y).cast("int"))
    k = F.size(p)
    every = F.aggregate(F.transform(lnp, lambda v, c: -v * F.coalesce(
        F.try_element_at(F.col("__w"), c.cast(weights.schema[y].dataType)), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    ce = (1.0 - smoothing) * nll * w_y + F.lit(smoothing) / k * every
    focal = F.pow(1.0 - F.exp(-ce), F.lit(gamma)) * ce
    x = x.select(*keys, w_y.alias("w"), nll.alias("nll"), focal.alias("focal"))
    return x.groupBy(*keys).agg((F.sum(F.col("w") * F.col("nll")) / F.sum("w")).alias("cross_entropy"),
                                (F.sum(F.col("focal") * F.col("w")) / F.sum("w")).alias("focal_loss"))


# ---------------------------------------------------------------- ext levels

def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, bucket: Column, n: str = "n",
                  out: str = "rank") -> DataFrame:
    """Average rank of each distinct value from its counts."""
    run = add_running(counts, keys, value, bucket, {n: "__cum"})
    return run.withColumn(out, F.col("__cum") - (F.col(n) - 1) / 2.0).drop("__cum")


def spearman(df: DataFrame, x: str, y: str, x_bucket: Column, y_bucket: Column, min_rows: int = 3) -> DataFrame:
    """Spearman correlation from joint counts of the two values."""
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    rx = average_ranks(joint.groupBy(x).agg(F.sum("n").alias("n")), [], x, x_bucket, out="rx").select(x, "rx")
    ry = average_ranks(joint.groupBy(y).agg(F.sum("n").alias("n")), [], y, y_bucket, out="ry").select(y, "ry")
    j = joint.join(rx, x).join(ry, y)
    n = F.sum("n").cast("double")
    s = lambda e: F.sum(F.col("n") * e)
    sx, sy = s(F.col("rx")), s(F.col("ry"))
    cov = s(F.col("rx") * F.col("ry")) - sx * sy / n
    vx = s(F.col("rx") * F.col("rx")) - sx * sx / n
    vy = s(F.col("ry") * F.col("ry")) - sy * sy / n
    rho = F.when(F.sum("n") >= min_rows, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), rho.alias("rho"))


def group_auroc(df: DataFrame, score: str, positive: Column, min_rows: int = 4) -> DataFrame:
    """AUROC of one score; NULL when a side is empty or rows are too few."""
    g = df.select(F.lit(0).alias("__g"), F.col(score).alias("score"), positive.alias("__pos"))
    c = running_curve(binary_scores(g, ["__g"], "score", F.col("__pos")), ["__g"])
    a = auroc(c, ["__g"]).join(
        c.groupBy("__g").agg(F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg")), "__g")
    return a.select("n_pos", "n_neg", F.when(F.col("n_pos") + F.col("n_neg") >= min_rows, F.col("auroc")).alias("auroc"))


def ext_level_report(df: DataFrame, level: str, y_pred: str, expected: str) -> DataFrame:
    """Per external level: detection rates, expected level, class counts."""
    g = df.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(y_pred) >= 1).cast("double")).alias("detected"),
        F.avg((F.col(y_pred) >= HIGH).cast("double")).alias("share_high"),
        F.avg(expected).alias("mean_expected"),
        *[F.count_if(F.col(y_pred) == c).alias(f"pred_{c}") for c in CLASSES])
    med = exact_quantile(df, [level], expected, width_bucket(expected, 1 / 64), [0.5], ["median_expected"])
    return g.join(med, level)


def topk_rows(df: DataFrame, order: Sequence[Column], k: int = 20) -> DataFrame:
    """First k rows of an order: each task keeps k, so nothing is sorted whole.

    The order must be total, or the cut among ties is arbitrary.
    """
    return df.orderBy(*order).limit(k)
