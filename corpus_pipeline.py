"""From raw documents to tokens: quality rules, line and document deduplication, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `docs`.  `run` applies them to the table `documents` and writes each stage's rows before the next reads them.

Defined results: null texts count as empty; rows without a doc_id go through all stages, but are linked with no other
row (only rows of equal text are copies); repeated rows are one document after the near-copies stage; an empty table
gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrade.llm import linededup, mixing, nearcopies, perplexity
from pairgrade.llm.queries import byte_bpe
from pairgrade.llm.registry import QUERIES, table
from pairgrade.session import materialize

# No SQL: perplexity, dependent rounding and tokens cannot be expressed in it.
ORACLE_SQL = None


def _identity(*columns: str):
    """128 bits that equal rows share."""
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))


def _whole(docs: DataFrame, own) -> DataFrame:
    """Rows as one column `row` beside their `id`, so that no name of theirs can clash."""
    return docs.select(own.alias("id"), F.struct(*docs.columns).alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie in their language's perplexity band."""
    own = _identity("doc_id", "text", "lang")
    rows = docs.select(own.alias("id"), "lang", "text")
    good = perplexity.verdict(rows, key="id").where("kept").select("id").distinct()
    return _whole(docs, own).join(good, "id", "left_semi").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the lines that no earlier line is like."""
    out = linededup.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies, the one of the smallest doc_id."""
    gone = nearcopies.near_copies(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    left = _whole(docs, F.col("doc_id").cast("long")).join(gone, "id", "left_anti")
    # Rows of equal doc_id and text are one document; where other columns differ, a hash of the row says which one stays.
    one = left.groupBy(_identity("row.doc_id", "row.text").alias("id")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    own = F.concat_ws("-", F.xxhash64(F.lit(1), "doc_id", "text"), F.xxhash64(F.lit(2), "doc_id", "text"))
    taken = mixing.copies(docs.select(own.alias("id"), "source", mixing.word_count(F.col("text")).alias("size")), key="id")
    taken = taken.groupBy("id").agg(F.max("copies").alias("copies")).where(F.col("copies") > 0)
    rows = _whole(docs, own).join(taken, "id")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the tokens, their number, and digests of the tokens and of the text decoded from them."""
    tok = byte_bpe()
    coded = tok.encode(docs, "text", "ids", ["doc_id", "source"])
    return tok.decode(coded, "ids", "_bytes").select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").cast("array<int>").alias("ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near copies", near_copies),
    ("mixing", mix_sources),
    ("byte BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


QUERIES["pipeline"] = run
