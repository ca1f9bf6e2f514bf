"""Exact ranks and running totals that never put one group in one task.

A plain ``row_number() over (partition by k order by v)`` sorts a whole group
in one task; with one group holding a third of 100 TB that task dies.  Here a
group is cut into value-ordered buckets, each bucket is ranked on its own, and
the rows before each bucket are counted from a small (group, bucket) table.
The result is the exact rank: buckets only decide who sorts what.

A bucket must be a deterministic, order-preserving function of the first order
column, so that a re-run task after an executor loss gives the same bucket.
Group keys must not be NULL.  Buckets are never NULL: a nullable join key would
make the optimizer copy the whole score expression into an IS NOT NULL filter
below the aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairgrade.session import materialize

_B = "__bucket"


def hash_bucket(hash_hex: str | Column, digits: int = 4) -> Column:
    """Leading hex digits: 16**digits even, ordered buckets of a hash order.

    The counts per bucket are the only table that grows with ``digits``; give
    fewer where groups are many (run x repeat), more where one group is huge."""
    col = F.col(hash_hex) if isinstance(hash_hex, str) else hash_hex
    return F.coalesce(F.substring(col, 1, digits), F.lit(""))


def unit_bucket(score: str | Column, per_unit: int = 16) -> Column:
    """Ordered buckets for a score in [0, 1], even in log-odds.

    Softmax scores pile up near 0 and 1, where equal-width buckets would be
    hot; equal steps of log-odds spread them.  ln is monotone, so is the
    bucket.  0 and 1 themselves get the end buckets.
    """
    s = F.col(score) if isinstance(score, str) else score
    s = s.cast("double")
    bucket = (F.when(s <= 0, F.lit(-1_000_000)).when(s >= 1, F.lit(1_000_000))
              .otherwise(F.floor((F.log(s) - F.log(1 - s)) * per_unit)))
    return F.coalesce(bucket.cast("int"), F.lit(-1_000_001))


def width_bucket(value: str | Column, width: float) -> Column:
    """Ordered buckets of equal width for a bounded numeric value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.floor(v.cast("double") / F.lit(float(width))).cast("bigint"), F.lit(-(2 ** 62)))


def range_bucket(df: DataFrame, column: str, n: int = 512) -> Column:
    """Ordered buckets for a text column of any distribution: the number of
    boundaries at or below the value.

    The boundaries are the ``n`` distinct values with the smallest hashes, a
    uniform sample of fixed size, as one literal array.  They only decide who
    sorts what; a family of names with a common prefix is cut like any other.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    sample = values.orderBy(F.md5("v"), "v").limit(n).collect()
    bounds = F.array(*[F.lit(r["v"]) for r in sorted(sample, key=lambda r: r["v"].encode())]).cast("array<string>")
    return F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(column))), F.lit(-1))


def _offsets(totals: DataFrame, keys: list[str], values: Sequence[str],
             descending: bool, grand: bool) -> DataFrame:
    # One row per (group, bucket): at most the number of buckets per group.
    # Text buckets are summed per leading two characters first, so that a
    # group's buckets do not meet in one task.
    if isinstance(totals.schema[_B].dataType, T.StringType):
        return _offsets_by_prefix(totals, keys, values, descending, grand)
    part = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    order = F.col(_B).desc() if descending else F.col(_B).asc()
    before = part.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.col(k) for k in keys] + [F.col(_B)]
    for v in values:
        cols.append(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__before_{v}"))
        if grand:
            cols.append(F.sum(v).over(part).alias(f"__all_{v}"))
    return totals.select(*cols)


def _offsets_by_prefix(totals: DataFrame, keys: list[str], values: Sequence[str],
                       descending: bool, grand: bool) -> DataFrame:
    rows = totals.withColumn("__prefix", F.substring(F.col(_B), 1, 2))
    sums = rows.groupBy(*keys, "__prefix").agg(*[F.sum(v).alias(v) for v in values])
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    part = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    before = part.orderBy(turn("__prefix")).rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.select(*keys, "__prefix", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__top_{v}") for v in values],
                       *[F.sum(v).over(part).alias(f"__all_{v}") for v in values if grand])
    inside = Window.partitionBy(*keys, "__prefix").orderBy(turn(_B)).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select(*keys, "__prefix", _B, *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__own_{v}") for v in values])
    return own.join(tops, [*keys, "__prefix"]).select(
        *keys, _B, *[(F.col(f"__own_{v}") + F.col(f"__top_{v}")).alias(f"__before_{v}") for v in values],
        *[F.col(f"__all_{v}") for v in values if grand])


def add_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
             bucket: Column, name: str, total: str | None = None) -> DataFrame:
    """1-based exact ``row_number`` within ``keys`` by ``order``.

    ``order`` must be total (ties broken), or the rank of ties is arbitrary.
    ``total`` also attaches the group size.
    """
    keys = list(keys)
    rows = df.withColumn(_B, bucket)
    sizes = rows.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("n"))
    off = _offsets(sizes, keys, ["n"], False, total is not None)
    inside = Window.partitionBy(*keys, _B).orderBy(*order)
    out = (
        rows.join(off, keys + [_B])
        .withColumn(name, (F.row_number().over(inside) + F.col("__before_n")).cast("bigint"))
    )
    drop = [_B, "__before_n"]
    if total is not None:
        out = out.withColumnRenamed("__all_n", total)
    return out.drop(*drop)


def add_running(df: DataFrame, keys: Sequence[str], order: str, bucket: Column,
                sums: dict[str, str], totals: dict[str, str] | None = None,
                descending: bool = False) -> DataFrame:
    """Inclusive running sums within ``keys`` along ``order``.

    ``df`` holds one row per (keys, order) - group equal values first - so
    ties are already one row.  ``sums`` maps column -> running-sum name,
    ``totals`` maps column -> group-total name.
    """
    keys, totals = list(keys), totals or {}
    rows = df.withColumn(_B, bucket)
    used = list(dict.fromkeys([*sums, *totals]))
    per_bucket = rows.groupBy(*keys, _B).agg(*[F.sum(c).alias(c) for c in used])
    off = _offsets(per_bucket, keys, used, descending, bool(totals))
    o = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, _B).orderBy(o).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = rows.join(off, keys + [_B])
    # Every window expression sits in one projection: one sort serves them all.
    out = out.select(
        *[F.col(c) for c in df.columns],
        *[(F.sum(c).over(inside) + F.col(f"__before_{c}")).alias(n) for c, n in sums.items()],
        *[F.col(f"__all_{c}").alias(n) for c, n in totals.items()],
    )
    return out


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, bucket: Column,
                   probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Linear-interpolated exact quantiles per group for groups of any size.

    Equal values are counted first; the two order statistics around each
    position are then picked by running count.  (``percentile`` keeps every
    distinct value of a group in one buffer; use that only for small groups.)
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")))
    run = add_running(counts, keys, value, bucket, {"__c": "__cum"}, {"__c": "__n"})
    aggs = []
    for p, name in zip(probs, names):
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
        aggs += [
            F.min(F.when(F.col("__cum") >= lo, F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__cum") >= hi, F.col(value))).alias(f"__hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"__w_{name}"),
        ]
    g = run.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
        for n in names])


def flag_first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 k, name: str) -> DataFrame:
    """Flag the ``k`` smallest rows of each group, without ranking the others.

    Runs the small job that finds the cuts when called.  The bucket that holds the k-th row is found from counts; only that bucket
    is sorted to get the k-th row itself, and every row is then compared with
    it.  The rows are never shuffled.  ``k`` is a function of the group size
    or a DataFrame (keys..., quota).

    Groups must be experiment dimensions (class, seed, run, repeat): the cut
    table has one row per group and is broadcast.
    """
    keys = list(keys)
    g = keys or ["__g"]
    rows = df.withColumn(_B, bucket)
    if not keys:
        rows = rows.withColumn("__g", F.lit(0))
    sizes = rows.groupBy(*g, _B).agg(F.count(F.lit(1)).alias("n"))
    off = _offsets(sizes, g, ["n"], False, True)
    off = off.join(sizes.withColumnRenamed("n", "__in"), g + [_B])
    if isinstance(k, DataFrame):
        off = off.join(F.broadcast(k.select(*g, F.col("quota").alias("__k"))), g)
    else:
        off = off.withColumn("__k", k(F.col("__all_n")))
    off = off.withColumn("__k", F.least("__k", "__all_n"))
    at = off.where((F.col("__before_n") < F.col("__k")) & (F.col("__k") <= F.col("__before_n") + F.col("__in")))
    at = at.select(*g, _B, (F.col("__k") - F.col("__before_n")).alias("__need"))
    # One boundary bucket per group.
    inside = Window.partitionBy(*g).orderBy(*order)
    cut = (rows.select(*g, _B, *[c for c in order if c not in g]).join(F.broadcast(at), g + [_B])
           .withColumn("__rn", F.row_number().over(inside)).where(F.col("__rn") == F.col("__need"))
           .select(*g, F.struct(*order).alias("__cut")))
    # A row per group, kept as a table: later passes over the flagged rows
    # then cost one comparison instead of finding the cut again.
    cut = materialize(cut)
    flag = F.coalesce(F.struct(*order) <= F.col("__cut"), F.lit(False))
    if keys:
        out = rows.join(F.broadcast(cut), g, "left")
    else:  # one row: a scalar, not a join
        out = rows.withColumn("__cut", cut.select("__cut").scalar())
    return out.select(*df.columns, flag.alias(name))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, bucket: Column,
                     ks: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """The k-th smallest ``value`` (1-based, ties counted) of each group.

    ``ks`` maps the group sizes (keys..., n) to asked positions
    (keys..., ..., k) and all its rows come back; a k outside 1..n gives NULL.
    Two passes over ``df``: bucket counts (kept as a small table when called),
    then only the buckets that hold an asked position are ordered.
    """
    keys = list(keys)
    rows = df.select(*keys, value).withColumn(_B, bucket)
    sizes = materialize(rows.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__in")))
    asked = ks(sizes.groupBy(*keys).agg(F.sum("__in").alias("n")))
    off = _offsets(sizes, keys, ["__in"], False, False).join(sizes, keys + [_B])
    cols = [c for c in asked.columns if c not in keys]
    hit = off.join(F.broadcast(asked), keys).where(
        (F.col("__before___in") < F.col("k")) & (F.col("k") <= F.col("__before___in") + F.col("__in")))
    hit = hit.select(*keys, _B, *cols, (F.col("k") - F.col("__before___in")).alias("__need"))
    wanted = hit.select(*keys, _B).distinct()
    vals = (rows.join(F.broadcast(wanted), keys + [_B], "left_semi")
            .groupBy(*keys, _B, value).agg(F.count(F.lit(1)).alias("__c")))
    inside = Window.partitionBy(*keys, _B).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = vals.withColumn("__cum", F.sum("__c").over(inside))
    found = (cum.join(F.broadcast(hit), keys + [_B]).where(F.col("__cum") >= F.col("__need"))
             .groupBy(*keys, *cols).agg(F.min(value).alias(out)))
    return asked.join(found, keys + cols, "left")
