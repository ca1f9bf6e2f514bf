"""Leak-free splits and samples in seeded hash order.

A random permutation is replaced by the order of md5(seed|key): the same rows
are drawn whatever the partitioning, order of files or number of executors.
Ranks go through ``add_rank``, so no class is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairgrade.functions.hashing import hex_to_long, keyed_md5, pair_key_hash
from pairgrade.functions.ordering import add_rank, flag_first_k, hash_bucket

SEALED_FOLD = -1


def rank_by_hash(df: DataFrame, seed, ids: Sequence[str], name: str = "rank",
                 keys: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """Position of every row in the seeded random order (within ``keys``)."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    h = df.withColumn("__h", keyed_md5(seed, *[F.col(i) for i in ids]))
    return add_rank(h, list(keys), ["__h", *ids], hash_bucket("__h"), name, total).drop("__h")


def ceil_share(numer: int, denom: int) -> Callable[[Column], Column]:
    return lambda n: F.floor((n * numer + (denom - 1)) / denom).cast("bigint")


def rounded_share(numer: int, denom: int, at_least: int = 0) -> Callable[[Column], Column]:
    def take(n):
        r = F.floor((n * (2 * numer) + denom) / (2 * denom)).cast("bigint")
        return F.least(F.greatest(r, F.lit(at_least).cast("bigint")), n)
    return take


def class_quotas(counts: DataFrame, y: str, take: Callable[[Column], Column]) -> DataFrame:
    """Split a total take over classes by largest remainder (ties: lower class).

    ``counts`` has one row per class; the windows run over those few rows.
    """
    whole = Window.partitionBy(F.lit(0))
    t = counts.withColumn("__n", F.sum("n").over(whole)).withColumn("__take", take(F.col("__n")))
    # Products of two row counts overflow bigint at scale: decimals.
    t = (t.withColumn("__prod", F.expr("cast(n as decimal(19,0)) * cast(__take as decimal(19,0))"))
         .withColumn("__base", F.expr("cast(__prod div __n as bigint)"))
         .withColumn("__rem", F.expr("__prod - cast(__base as decimal(19,0)) * cast(__n as decimal(19,0))")))
    short = F.col("__take") - F.sum("__base").over(whole)
    order = F.row_number().over(whole.orderBy(F.col("__rem").desc(), F.col(y)))
    before = Window.partitionBy(F.lit(0)).orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    return (t.withColumn("quota", F.col("__base") + (order <= short).cast("bigint"))
            .withColumn("rest_before", F.coalesce(F.sum(F.col("n") - F.col("quota")).over(before), F.lit(0)))
            .select(y, "quota", "rest_before"))


def _hashed(df: DataFrame, seed, ids: Sequence[str]) -> DataFrame:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return df.withColumn("__h", keyed_md5(seed, *[F.col(i) for i in ids]))


def first_by_hash(df: DataFrame, seed, ids: Sequence[str], k, name: str,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Flag the first ``k`` rows of the seeded order (within ``keys``)."""
    out = flag_first_k(_hashed(df, seed, ids), list(keys), ["__h", *ids], hash_bucket("__h"), k, name)
    return out.drop("__h")


def _class_counts(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))


def stratified_cut(df: DataFrame, y: str, ids: Sequence[str], seed, take: Callable[[Column], Column],
                   name: str = "in_test") -> DataFrame:
    """Flag a stratified share of the rows; the rows are not shuffled."""
    return first_by_hash(df, seed, ids, class_quotas(_class_counts(df, y), y, take), name, [y])


def stratified_or_plain_cut(df: DataFrame, y: str, ids: Sequence[str], seed,
                            take: Callable[[Column], Column], name: str) -> DataFrame:
    """Stratified cut; one plain cut when a class is too small to stratify
    (a class with a single row, or fewer rows taken or left than classes)."""
    whole = Window.partitionBy(F.lit(0))
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    n, k = F.sum("n").over(whole), F.count(F.lit(1)).over(whole)
    t = take(n)
    small = (F.min("n").over(whole) < 2) | (t < k) | (n - t < k)
    strata = c.select(y, F.when(small, F.lit(-1)).otherwise(F.col(y)).alias("__stratum"))
    return stratified_cut(df.join(F.broadcast(strata), y), "__stratum", ids, seed, take, name).select(*df.columns, name)


def sealed_and_folds(df: DataFrame, y: str, ids: Sequence[str], seed, n_folds: int = 5,
                     numer: int = 1, denom: int = 5) -> DataFrame:
    """``sealed_test`` flag (stratified share) and ``fold`` of the others.

    Folds deal the remaining rows of the concatenated classes in turn, so fold
    sizes differ by at most one overall and per class.  Sealed rows: fold -1.
    """
    quotas = class_quotas(_class_counts(df, y), y, ceil_share(numer, denom))
    r = rank_by_hash(df, seed, ids, "__rn", [y]).join(F.broadcast(quotas), y)  # a row per class
    sealed = F.col("__rn") <= F.col("quota")
    fold = (F.col("__rn") - F.col("quota") - 1 + F.col("rest_before")) % n_folds + 1
    return (r.withColumn("sealed_test", sealed.cast("bigint"))
            .withColumn("fold", F.when(sealed, F.lit(SEALED_FOLD)).otherwise(fold).cast("bigint"))
            .select(*df.columns, "sealed_test", "fold"))


def three_way(df: DataFrame, y: str, ids: Sequence[str], seed) -> DataFrame:
    """60/20/20: test first, then a quarter of the rest as validation."""
    t = stratified_cut(df, y, ids, seed, ceil_share(1, 5), "__test")
    rest = t.where(~F.col("__test")).drop("__test")
    v = stratified_cut(rest, y, ids, seed, ceil_share(1, 4), "__val")
    return (t.where("__test").drop("__test").withColumn("part", F.lit("test"))
            .unionByName(v.withColumn("part", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")))


def stratified_cap(df: DataFrame, y: str, ids: Sequence[str], seed, caps: dict[int, int]) -> DataFrame:
    """Keep all rows of a tier, or its first ``cap`` in seeded order."""
    n = F.col("n")
    cap = F.coalesce(*[F.when(F.col(y) == t, F.lit(c).cast("bigint")) for t, c in caps.items()], n)
    quotas = _class_counts(df, y).select(y, F.least(cap, n).alias("quota"))
    return first_by_hash(df, seed, ids, quotas, "__keep", [y]).where("__keep").drop("__keep")


def held_out_entities(entities: DataFrame, seeds: Sequence[int], numer: int = 1, denom: int = 5) -> DataFrame:
    """(seed, entity_id, held_out) for each seed: round(share * n) held out."""
    e = entities.select("entity_id", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])).alias("seed"))
    r = first_by_hash(e, F.col("seed"), ["entity_id"], rounded_share(numer, denom), "held_out", ["seed"])
    return r.select("seed", "entity_id", "held_out")


def membership_flags(pairs: DataFrame, members: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """``in_a`` / ``in_b``: which endpoint lies in the member set."""
    m = members.select(*on, "entity_id").distinct()
    out = pairs
    for side in ("a", "b"):
        s = m.withColumnRenamed("entity_id", side).withColumn(f"__in_{side}", F.lit(True))
        out = (out.join(s, [*on, side], "left")
               .withColumn(f"in_{side}", F.coalesce(f"__in_{side}", F.lit(False))).drop(f"__in_{side}"))
    return out


def cold_start_split(pairs: DataFrame, held: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Entity-level split per seed: KK none, S1 one, S2 both endpoints held out.

    An entity's seeds travel as one array (an element per seed), so pairs are
    joined once and not once per seed.
    """
    m = held.where("held_out").groupBy("entity_id").agg(F.collect_set(F.col("seed").cast("bigint")).alias("__seeds"))
    f = pairs
    for side in ("a", "b"):
        f = f.join(m.select(F.col("entity_id").alias(side), F.col("__seeds").alias(f"__{side}")), side, "left")
    f = f.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    flags = {f"in_{side}": F.coalesce(F.array_contains(f"__{side}", F.col("seed")), F.lit(False)) for side in ("a", "b")}
    f = f.withColumns(flags).select("seed", *[c for c in pairs.columns if c != "seed"], *flags)
    k = F.col("in_a").cast("int") + F.col("in_b").cast("int")
    return f.withColumn("part", F.when(k == 0, "KK").when(k == 1, "S1").otherwise("S2"))


def set_diff_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both-way difference of two key sets: counts, smallest example, equality."""
    l = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    r = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    j = l.join(r, list(keys), "full")
    only_l, only_r = F.col("__r").isNull(), F.col("__l").isNull()
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return j.agg(F.count_if(~only_l & ~only_r).alias("n_both"), F.count_if(only_l).alias("only_left"),
                 F.count_if(only_r).alias("only_right"),
                 F.min(F.when(only_l, key)).alias("example_left"),
                 F.min(F.when(only_r, key)).alias("example_right"),
                 (F.count_if(only_l | only_r) == 0).cast("int").alias("is_equal"))


def split_manifest(df: DataFrame) -> DataFrame:
    return df.select(pair_key_hash(F.col("a"), F.col("b")).alias("pair_hash"), "sealed_test", "fold")


def edge_drop(edges: DataFrame, cols: Sequence[str], seed: int, ratio: float) -> DataFrame:
    """Remove a seeded random share of the edges; stateless, no shuffle."""
    u = hex_to_long(F.substring(keyed_md5(seed, *[F.col(c) for c in cols]), 1, 8))
    return edges.where(u >= F.lit(int(ratio * 2**32)))


def bounded_sample(df: DataFrame, ids: Sequence[str], seed: int, n: int, required: Column | None = None) -> DataFrame:
    """First ``n`` rows in seeded order, plus every required row."""
    r = first_by_hash(df, seed, ids, lambda total: F.least(F.lit(n).cast("bigint"), total), "__keep")
    keep = F.col("__keep")
    return r.where(keep | required if required is not None else keep).select(*df.columns)


def rows_by_id(df: DataFrame, row_ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose id is listed; ids that do not exist vanish."""
    return df.join(row_ids.select(key).distinct(), key, "left_semi")
