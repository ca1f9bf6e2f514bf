"""Exact ranks, cuts and order statistics against plain windows, with skew."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from pairgrade.functions.ordering import (add_rank, add_running, exact_quantile, flag_first_k, hash_bucket,
                                          order_statistics, unit_bucket, width_bucket)


@pytest.fixture(scope="module")
def rows(spark):
    # One group holds most of the rows; scores are tied and pile up near 0.
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).otherwise("hot").alias("g"),
        "id", F.md5(F.col("id").cast("string")).alias("h"),
        (F.pow((F.col("id") * 37 % 101) / 100.0, 6)).alias("s"))
    return df.cache()


def test_rank_equals_row_number(rows):
    r = add_rank(rows, ["g"], ["h", "id"], hash_bucket("h", 2), "rn", total="n")
    w = Window.partitionBy("g").orderBy("h", "id")
    bad = (r.withColumn("want", F.row_number().over(w)).withColumn("all", F.count("*").over(Window.partitionBy("g")))
           .where("rn <> want or n <> all"))
    assert bad.count() == 0 and r.count() == 3000


@pytest.mark.parametrize("k", [0, 1, 7, 10_000])
def test_first_k(rows, k):
    f = flag_first_k(rows, ["g"], ["h", "id"], hash_bucket("h", 2), lambda n: F.lit(k).cast("bigint"), "keep")
    w = Window.partitionBy("g").orderBy("h", "id")
    assert f.withColumn("want", F.row_number().over(w) <= k).where("keep <> want").count() == 0


def test_first_k_without_keys(rows):
    f = flag_first_k(rows, [], ["h", "id"], hash_bucket("h", 2), lambda n: F.floor(n / 2).cast("bigint"), "keep")
    assert f.where("keep").count() == 1500


def test_running_totals_both_ways(rows):
    c = rows.groupBy("g", "s").agg(F.count("*").alias("c"))
    for desc in (False, True):
        r = add_running(c, ["g"], "s", unit_bucket("s"), {"c": "cum"}, {"c": "n"}, descending=desc)
        o = F.col("s").desc() if desc else F.col("s").asc()
        w = Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
        assert r.withColumn("want", F.sum("c").over(w)).where("cum <> want").count() == 0


def test_order_statistics_with_ties(rows):
    ks = lambda n: n.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(5), F.col("n"), F.col("n") + 1)))
    got = {(r["g"], r["k"]): r["v"] for r in order_statistics(rows, ["g"], "s", unit_bucket("s"), ks, "v").collect()}
    for g in ("g0", "hot"):
        s = np.sort([r["s"] for r in rows.where(F.col("g") == g).collect()])
        assert got[(g, 0)] is None and got[(g, len(s) + 1)] is None
        assert got[(g, 1)] == s[0] and got[(g, 5)] == s[4] and got[(g, len(s))] == s[-1]


def test_exact_quantile(rows):
    q = exact_quantile(rows, ["g"], "s", width_bucket("s", 1 / 32), [0.025, 0.5], ["lo", "mid"]).collect()
    for r in q:
        s = [x["s"] for x in rows.where(F.col("g") == r["g"]).collect()]
        assert np.allclose([r["lo"], r["mid"]], np.quantile(s, [0.025, 0.5]), atol=1e-12)
