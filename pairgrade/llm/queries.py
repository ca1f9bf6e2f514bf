"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairgrade.llm import bpe, extract, langid, licenses, linededup, merkle, mixing, nearcopies, ngram_join, perplexity, quality, runs, topk
from pairgrade.llm.constants import let
from pairgrade.llm.registry import held_out, query, table


@query("op1_ppm_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


@query("op2_subword_quality")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = quality.fit(docs.where(~F.col("held_out")), labels)
    return quality.predict(docs, model, keep=("doc_id", "held_out"))


@query("op3_perplexity_rules")
def op3(spark, sf_dir):
    return perplexity.verdict(table(spark, sf_dir, "documents"))


@query("op4_tag_path_extraction")
def op4(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


@query("op7_pivotal_mixing")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.copies(rows)
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
             cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


@query("op5_branch_and_bound_topk", OP5_SQL)
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.search(rows, F.col("vec_id") % 100 == 0, k=10)


@query("op8_license_digests", licenses.sql())
def op8(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


@query("op6_signature_near_copies")
def op6(spark, sf_dir):
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), shingle=2)


@query("op10_line_dedup", linededup.sql())
def op10(spark, sf_dir):
    found = linededup.report(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def byte_bpe() -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    tok = byte_bpe()
    coded = tok.encode(table(spark, sf_dir, "documents"), "text", "ids", ["doc_id"])
    return tok.decode(coded, "ids", "bytes").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query("op12_ngram_jaccard_join")
def op12(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", merkle.sql())
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(lowered))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(rows, "doc_id", "source", carry=["tampered"])
    found = found.withColumn("folded_root", merkle.folded(F.col("path"), F.coalesce("tampered", "leaf")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def periodic_text(key, text):
    """The text; for one row of ten with its words from a place on made periodic, both by the crc32 of the key."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def spread(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        some = lambda start, size: F.array_join(F.slice(words, start + 1, size), " ")
        again = F.repeat(F.concat(F.lit(" "), some(a, p)), F.floor((n - a) / p).cast("int") - 1)
        last = (n - a) % p
        return F.when(n > 0, F.concat(some(F.lit(0), a + p), again, F.when(last > 0, F.concat(F.lit(" "), some(a, last))).otherwise(""))).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), let(words, spread)).otherwise(text)


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = runs.find(docs.select("doc_id", periodic_text(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
