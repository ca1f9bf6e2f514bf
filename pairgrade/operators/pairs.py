"""Unordered pairs: canonical form, first-wins dedupe, audits and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairgrade.functions.hashing import pair_key_hash
from pairgrade.functions.text import strip


def canonical_pair(df: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``a`` < ``b`` (bytewise, stripped) and whether they were swapped."""
    l, r = strip(F.col(left)), strip(F.col(right))
    return (df.withColumn("a", F.least(l, r)).withColumn("b", F.greatest(l, r))
            .withColumn("swapped", l > r))


def swap_counts(df: DataFrame, left: str, right: str, by: list[str]) -> DataFrame:
    c = canonical_pair(df, left, right)
    return c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(F.col("swapped").cast("bigint")).alias("n_swapped"))


def _pair_keys(left: str, right: str, ordered: bool) -> list[Column]:
    """The unordered pair; ``ordered``: ``left`` is nowhere above ``right``, so
    rows that are dealt by the two columns are not shuffled again."""
    ends = (F.col(left), F.col(right)) if ordered else (F.least(left, right), F.greatest(left, right))
    return [c.alias(n) for c, n in zip(ends, ("a", "b"))]


def keep_first_pair(df: DataFrame, left: str, right: str, pos: str,
                    keep: dict[str, str], ordered: bool = False) -> DataFrame:
    """One row per unordered pair; values come from the smallest ``pos``.

    An aggregate (min_by) rather than a window: it pre-aggregates before the
    shuffle, so a pair repeated a billion times costs one row per task.
    """
    first = F.min_by(F.struct(*[F.col(c).alias(n) for n, c in keep.items()]), F.col(pos))
    out = df.groupBy(*_pair_keys(left, right, ordered)).agg(first.alias("f"))
    return out.select("a", "b", *[F.col(f"f.{n}").alias(n) for n in keep])


def pair_hash(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumn("pair_hash", pair_key_hash(F.col(left), F.col(right)))


def class_distribution(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """Rows and share per class (optionally within ``by``); classes are few."""
    by = by or []
    n = df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*by or [F.lit(0)])  # a handful of class rows
    return n.select(*by, y, "n", (F.col("n") / F.sum("n").over(group)).alias("share"))


def stage_distribution(df: DataFrame, left: str, right: str, pos: str, y: str, n_classes: int = 5,
                       ordered: bool = False) -> DataFrame:
    """(stage, y, n, share): rows of each class before (``raw``) and after (``dedup``) the first row of each unordered
    pair is kept.  One scan and one shuffle: a pair carries a counter for each class beside its first label."""
    classes = range(n_classes)
    per = df.groupBy(*_pair_keys(left, right, ordered)).agg(
        F.min_by(y, pos).alias("first"), *[F.count_if(F.col(y) == c).alias(f"c{c}") for c in classes])
    total = per.agg(*[F.sum(f"c{c}").alias(f"raw_{c}") for c in classes], *[F.count_if(F.col("first") == c).alias(f"dedup_{c}") for c in classes])
    rows = []
    for stage in ("raw", "dedup"):
        whole = sum((F.col(f"{stage}_{c}") for c in classes[1:]), F.col(f"{stage}_0"))
        rows += [F.struct(F.lit(stage).alias("stage"), F.lit(c).cast("bigint").alias("y"), F.col(f"{stage}_{c}").alias("n"),
                          (F.col(f"{stage}_{c}") / whole).alias("share")) for c in classes]
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("n > 0")


def dup_group_audit(df: DataFrame, left: str, right: str, y: str) -> DataFrame:
    """Unordered duplicate groups: extra rows and agreement of their labels."""
    g = df.groupBy(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), F.collect_set(y).alias("labels"))  # <= 5 labels
    dup = g.where("rows > 1")
    labels = F.array_join(F.transform(F.array_sort("labels"), lambda v: v.cast("string")), ",")
    return dup.groupBy(labels.alias("label_set")).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("rows") - 1).alias("extra_rows"),
        F.sum((F.array_min("labels") > 0).cast("bigint")).alias("all_positive"),
        F.sum((F.array_max("labels") == 0).cast("bigint")).alias("all_negative"),
        F.sum(((F.array_min("labels") == 0) & (F.array_max("labels") > 0)).cast("bigint")).alias("mixed"))


def crosstab(df: DataFrame, row: str, row_values: list, col: str, col_values: list,
             prefix: str) -> DataFrame:
    """Full grid of counts, zeros included; value lists are the grid."""
    counts = df.groupBy(row).pivot(col, col_values).agg(F.count(F.lit(1)))
    dtype = df.schema[row].dataType
    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(v).cast(dtype) for v in row_values])).alias(row))
    return grid.join(counts, row, "left").select(
        row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(f"{prefix}{v}")
               for v in col_values])


def label_lookup_strict(df: DataFrame, labels: DataFrame, left: str, right: str,
                        old_label: str) -> DataFrame:
    """Relabel positives by ordered key; label 0 passes; any miss is an error."""
    look = labels.select(F.col(left), F.col(right), F.col("tier").alias("__new"))
    j = df.join(look, [left, right], "left")
    new = (F.when(F.col(old_label) == 0, F.lit(0))
           .when(F.col("__new").isNotNull(), F.col("__new"))
           .otherwise(F.raise_error(F.concat_ws(" ", F.lit("no label for pair"), left, right))))
    return j.withColumn("new_label", new.cast("bigint")).drop("__new")


def pair_anti_join(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (a, b) that are not a known unordered pair."""
    k = known.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"))
    return candidates.join(k, (F.least("a", "b") == F.col("__a")) & (F.greatest("a", "b") == F.col("__b")),
                           "left_anti")


def manifest_flag(user_pairs: DataFrame, manifest: DataFrame, left: str, right: str) -> DataFrame:
    """Flag every pair found in a hashed manifest."""
    m = manifest.select("pair_hash").distinct().withColumn("__hit", F.lit(True))
    return (pair_hash(user_pairs, left, right).join(m, "pair_hash", "left")
            .withColumn("in_manifest", F.coalesce("__hit", F.lit(False))).drop("__hit"))


def match_report(flagged: DataFrame) -> DataFrame:
    hit = F.col("in_manifest").cast("bigint")
    return flagged.agg(F.sum(hit).alias("matched"), F.sum(1 - hit).alias("unmatched"),
                       F.try_divide(F.sum(hit), F.count(F.lit(1))).alias("match_rate"))


# Accepted spellings of the two id columns.
PAIR_SYNONYMS = [("drug_a", "drug_b"), ("drug1_id", "drug2_id"), ("drug1", "drug2"), ("id_a", "id_b")]


def resolve_pair_columns(df: DataFrame, synonyms=PAIR_SYNONYMS) -> DataFrame:
    """Rename the pair columns to ``a``/``b``, matching names without case."""
    have = {c.lower(): c for c in df.columns}
    for x, y in synonyms:
        if x in have and y in have:
            return df.withColumnsRenamed({have[x]: "a", have[y]: "b"})
    raise ValueError(f"no pair columns among {df.columns}")


def pair_caption(pairs: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Attach both entity names; an unknown name falls back to the id."""
    n = names.select(F.col(key).alias("__k"), F.col(name).alias("__n"))
    a = n.withColumnsRenamed({"__k": "a", "__n": "__na"})
    b = n.withColumnsRenamed({"__k": "b", "__n": "__nb"})
    blank = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .withColumn("name_a", F.coalesce(blank("__na"), F.col("a")))
            .withColumn("name_b", F.coalesce(blank("__nb"), F.col("b")))
            .drop("__na", "__nb"))


def entity_max_tier(pairs: DataFrame, y: str = "y") -> DataFrame:
    """Highest tier over all pairs of each entity."""
    return (pairs.select(F.explode(F.array("a", "b")).alias("entity_id"), F.col(y).alias("__y"))
            .groupBy("entity_id").agg(F.max("__y").alias("max_tier")))


def entity_universe(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()


def order_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in (
        ("n_less", F.col(left) < F.col(right)), ("n_greater", F.col(left) > F.col(right)),
        ("n_equal", F.col(left) == F.col(right)))])
