"""Mixing of sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should have; the whole part is certain, the fraction is settled by
the pivotal method: two documents with fractions exchange mass, at random and
fair to both, until one of them is 0 or 1, and the other goes on to the next.
Mass is counted in words (fraction times size), so a source's expected words
stay at its target through every exchange.  The exchanges form a reduction
tree: `FAN` documents of a source meet in one task and leave at most one
undecided, `FAN` of those meet in the next level, up to one for each source,
which is rounded to the nearer side.  Rows of equal key, source and size are one
row with a count first: the whole part of count times fraction is certain, one
fraction goes on, and the rows share the copies as evenly as they can.  So no
group is larger than about `FAN` rows, whatever the size of a source and
however often a key occurs.

Random numbers come from the seed, the source's rank, the level and the group,
and documents meet in a fixed order, so reruns agree.

Edge cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, last in order; without rows or words all
targets are 0; repeated rows get one result each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairgrade.session import materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
FAN, SEED = 1024, 23


def word_count(text):
    """Words `[^\\x20\\x09-\\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS,
                   share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each source: _source, rank (from 0), source_size, n, target.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all sizes; none gets more
    than `most` times its size, and what is cut off is shared by the others.  That is a water level: with sources in
    the order of limit / weight, the level is (what is left) / (weights left) at the first source whose own limit is
    not below it.  The windows run over sources, not rows.
    """
    found = rows.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = found.withColumn("rank", F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    limit = most * F.col("source_size")
    ranked = ranked.withColumn("full", limit / F.col("weight"))
    up = W.orderBy("full", "rank")
    everything = W.partitionBy()
    level = (share * F.sum("source_size").over(everything) - (F.sum(limit).over(up) - limit)) / (F.sum("weight").over(everything) - (F.sum("weight").over(up) - F.col("weight")))
    ranked = ranked.withColumn("level", level)
    at = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "rank", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least(limit, F.coalesce(at, F.lit(float("inf"))) * F.col("weight"))).select("_source", "rank", "source_size", "n", "target")


def settle(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal rounding of the fractions `part` in the given order; at most one stays between 0 and 1."""
    part, chance = part.astype(float).copy(), rng.random(len(part))
    a = -1
    for b in np.flatnonzero((part > 0) & (part < 1)):
        if a < 0:
            a = b
            continue
        ratio = size[a] / size[b]
        up, down = min(1 - part[a], part[b] / ratio), min(part[a], (1 - part[b]) / ratio)
        if chance[b] * (up + down) < down:  # raise a by `up`
            a_ends, part[a], part[b] = 1 - part[a] <= part[b] / ratio, part[a] + up, part[b] - up * ratio
        else:
            a_ends, part[a], part[b] = part[a] <= (1 - part[b]) / ratio, part[a] - down, part[b] + down * ratio
        ends, stays = (a, b) if a_ends else (b, a)
        part[ends] = round(part[ends])
        if part[stays] < 1e-9 or part[stays] > 1 - 1e-9:
            part[stays] = round(part[stays])
            a = -1
        else:
            a = stays
    return part


def copies(rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", seed: int = SEED, fan: int = FAN) -> DataFrame:
    """Per row of `rows`: key, source, size, source_size, target and copies (how often the mix takes it)."""
    rows = rows.select(F.col(key).alias("_key"), F.col(source).alias("_src"), F.col(size).cast("long").alias("_size"))
    targets = materialize(source_targets(rows, "_src", "_size"))
    groups = F.ceil(F.col("n") / fan)
    merged = rows.groupBy("_key", "_src", "_size").agg(F.count(F.lit(1)).alias("rows"))
    level = (merged.join(targets, F.col("_src").eqNullSafe(F.col("_source")))
             .withColumn("share", F.when(F.col("_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
             .withColumn("whole", F.floor("share")).withColumn("part", F.col("share") - F.col("whole"))
             .withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "_key", "_size"), groups))
             .select("_key", "_src", "_size", "rows", "source_size", "target", "whole", "part", "rank", "group"))
    most = targets.agg(F.max("n")).first()[0] or 0
    schema = level.schema
    done, left, depth = [], max(1, -(-most // fan)), 0

    def meet(depth: int, root: bool):
        def run(ident: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.assign(_id=g["_key"].astype(str)).sort_values(["_size", "_id"], ascending=[False, True], kind="stable").drop(columns="_id")
            rng = np.random.default_rng([seed, int(ident[0]), depth, int(ident[1])])
            part = settle(g["_size"].to_numpy(), g["part"].to_numpy(), rng)
            g["part"] = np.floor(part + 0.5) if root else part
            return g

        return run

    while True:
        root = left <= 1
        level = materialize(level.groupBy("rank", "group").applyInPandas(meet(depth, root), schema))
        settled = F.col("part").isin(0.0, 1.0)
        done.append(level.where(settled))
        if root:
            break
        level = level.where(~settled).withColumn("group", F.floor(F.col("group") / fan))
        left, depth = -(-left // fan), depth + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    total = (F.col("whole") + F.col("part")).cast("long")
    each = out.withColumn("total", total).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    own = F.floor(F.col("total") / F.col("rows")) + (F.col("i") <= F.col("total") % F.col("rows")).cast("long")
    return each.select(F.col("_key").alias(key), F.col("_src").alias(source), F.col("_size").alias(size), "source_size", "target", own.cast("long").alias("copies"))
