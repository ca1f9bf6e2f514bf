"""Flat files: CSV tables, id lists, split manifests, features, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PAIR_EVENTS = "id1 string, id2 string, description string"
MANIFEST = "pair_hash string, sealed_test bigint, fold bigint"
_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quoteAll": "true",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with an explicit schema; ids stay strings, quotes are doubled."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.options(**_CSV).option("compression", compression).csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Text list of ids, one per line (gzip is read natively)."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).where("entity_id <> ''")


def write_ids(df: DataFrame, path: str) -> None:
    df.select(F.col("entity_id").cast("string")).write.text(path)


def write_features(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str]) -> None:
    """Feature rows as one float array per key, clustered by key."""
    vec = F.array(*[F.col(c).cast("float") for c in columns]).alias("features")
    df.select(*keys, vec).repartition(*keys).sortWithinPartitions(*keys).write.parquet(path)


def table_digest(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-free digest of a table: the sum of 60-bit row hashes.

    Fields are written with their length, NULL as ``-``, so that no two rows
    of different values are written alike.  Columns may be expressions."""
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    row = F.sha2(F.concat(*[field(F.expr(c).cast("string")) for c in columns]), 256)
    h = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("decimal(38,0)").alias("digest")).select(
        F.lit(name).alias("name"), "n_rows", F.col("digest").cast("string").alias("digest"))


def exact_text(value: Column, kind: T.DataType) -> Column:
    """A value as text that other engines write alike: whole numbers in decimal, floating-point numbers exactly (to
    2**-93) as their whole part and three groups of 31 binary places, times as microseconds, dates as days since 1970,
    arrays with the number of their elements and each element's own length."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = value.cast("double")
        parts, rest = [F.floor(x)], x - F.floor(x)
        for _ in range(3):
            rest = rest * F.lit(float(2**31))
            parts.append(F.floor(rest))
            rest = rest - F.floor(rest)
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(odd, x.cast("string")).otherwise(F.concat_ws(".", *[p.cast("string") for p in parts]))
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.ArrayType):
        return F.concat(F.size(value).cast("string"), F.lit("["), F.array_join(F.transform(value, lambda v: _field(exact_text(v, kind.elementType))), ""))
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def _field(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def column_digests(df: DataFrame, name: str, keys: Sequence[str], part: Column) -> DataFrame:
    """(name, part, column, n_rows, n_null, digest) for each column of a table and each part of its rows.

    A digest is the sum of 60-bit hashes of the row's key and the column's value, so it depends on which row holds a
    value but not on the order of the rows, and digests of new rows are added to those of the old ones.  One pass over
    the table; the result has a row for each part and column."""
    kinds = {f.name: f.dataType for f in df.schema}
    key = F.concat(*[_field(exact_text(F.col(k), kinds[k])) for k in keys])
    def h(c):
        return F.conv(F.substring(F.sha2(F.concat(key, _field(exact_text(F.col(c), kinds[c]))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = [x for i, c in enumerate(df.columns) for x in (F.sum(h(c)).cast("decimal(38,0)").alias(f"d{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"))]
    t = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"z{i}").alias("n_null"), F.col(f"d{i}").cast("string").alias("digest")) for i, c in enumerate(df.columns)])
    return t.select(F.lit(name).alias("name"), "part", "n_rows", F.explode(rows).alias("r")).select("name", "part", "r.column", "n_rows", "r.n_null", "r.digest")


def merge_digests(*parts: DataFrame) -> DataFrame:
    """Digests of tables whose rows are the rows of all given ones."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("name", "part", "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("digest"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns and parts in which two snapshots differ: (name, part, column, change, old_rows, new_rows); change is
    ``added``, ``removed``, ``rows`` (another number of rows) or ``values``."""
    on = ["name", "part", "column"]
    side = lambda d, s: d.select(*on, F.col("n_rows").alias(f"{s}_rows"), F.col("n_null").alias(f"{s}_null"), F.col("digest").alias(f"{s}_digest"))
    j = side(old, "old").join(side(new, "new"), on, "full")
    change = (F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").when(F.col("old_rows") != F.col("new_rows"), "rows")
              .when((F.col("old_digest") != F.col("new_digest")) | (F.col("old_null") != F.col("new_null")), "values"))
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select(*on, "change", "old_rows", "new_rows")


def file_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Folder, SHA-256 and byte size per output file (files below 2 GB)."""
    f = spark.read.format("binaryFile").load(glob)
    return f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"),
                    F.sha2("content", 256).alias("sha256"))


def class_meta(before: DataFrame, after: DataFrame, y: str, feature_dim: int) -> DataFrame:
    """One-row report: samples, class counts before and after, changes."""
    def counts(df):
        c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
        return c.agg(F.sum("n").alias("n"), F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col(y).cast("string"), "n")))).alias("counts"))  # a row per class
    a = counts(after).select(F.col("n").alias("n_samples"), F.col("counts").alias("counts"), F.lit(1).alias("__k"))
    b = counts(before).select(F.col("n").alias("n_before"), F.col("counts").alias("counts_before"), F.lit(1).alias("__k"))
    return a.join(b, "__k").drop("__k").withColumn("feature_dim", F.lit(feature_dim).cast("bigint"))


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)  # one row
