"""Look-up tables of fixed size as one value of a query."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrade.session import materialize


def constant(spark: SparkSession, **arrays: pa.Array) -> Column:
    """A struct of arrays, by name, as a scalar subquery over a one-row table.

    Tasks get it once, in Spark's binary form; a literal of that size would be written out in every description of
    every plan that holds it.  Attach it as a column and use that column once, through `let`: the optimiser then puts
    the subquery in its place, and no row carries the arrays."""
    row = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in arrays.items()})
    return materialize(spark.createDataFrame(row).select(F.struct(*arrays).alias("tables"))).scalar()


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once: a variable within an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ship(spark: SparkSession, value):
    """A function that gives `value` within tasks; the value travels once to each executor.

    Broadcasts pickle classes by reference; here the class travels with the value, so that workers need no copy of the
    package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def may_hold(keys: DataFrame, column: str, bits: int = 20):
    """A test that is true for every value of `column` in `keys`: a bit map of fixed size, 2 ** bits, by hash.

    It keeps most rows that a semi join would drop from being shuffled for it; a full map only saves nothing."""
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(5), column), 64 - bits)
    found = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("m")).collect()
    words = [0] * (1 << (bits - 6))
    for r in found:
        words[r["w"]] = r["m"]
    held = constant(keys.sparkSession, words=pa.array(words, pa.int64()))["words"]

    def test(key):
        at = F.shiftrightunsigned(F.xxhash64(F.lit(5), key), 64 - bits)
        return F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1

    return test
