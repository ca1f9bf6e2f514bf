"""Licence scan by canonical digests.

A text is normalised: lower case; lines that state a copyright go; every run
of other characters than letters and digits becomes one space; equivalent
spellings become one.  The digest of the whole canonical text is hash-joined
to the digests of known texts, normalised the same way, and so is the digest
of each line, which finds one-line notices.

Edge cases: null and empty texts, and texts of nothing but punctuation and
copyright lines, have no digest and match nothing; a text that equals several
known entries of one licence matches it once; the smallest licence name wins
if known entries of several licences coincide; rows that share a doc_id share
their notices; length is not bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrade.llm.license_texts import EQUIVALENT, KNOWN

# Fixed: what a copyright line starts with, and how it states a holder or a year.  Prose that a line break puts at a
# line's start ("copyright notice that is", "copyright holders and contributors") states neither.
_STATED = (
    r"(\(c\)|©|:|[0-9]{4}|[\[<{]"  # a sign, a year or a blank to fill in
    r"|.*[^0-9](19|20)[0-9]{2}([^0-9]|$)|.*@"  # a year or an address further on
    r"|(by\s|the\s)?.*[^\p{L}](inc|llc|ltd|gmbh|corp|corporation|foundation|company|university)[^\p{L}\p{N}]*(all rights reserved[^\p{L}\p{N}]*)?$"
    r"|the\s.*[^\p{L}](authors|contributors|developers|maintainers|team|project|regents)[^\p{L}]|the\s.*[^\p{L}](authors|contributors|developers|maintainers|team|project|regents)$"
    r"|[\p{L}\p{N}.-]+\s+(authors|contributors|developers|maintainers|team|project)[^\p{L}\p{N}]*$)"
)
COPYRIGHT = r"^[^\p{L}\p{N}©(]*((portions )?copyright\s*" + _STATED + r"|\(c\)\s*[0-9]|©|all rights reserved[^\p{L}\p{N}]*$)"


def canonical(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line.  A text's is its lines' ones, joined."""
    low = F.lower(line)
    # Two spaces between words, so that each has its own on either side.
    out = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for other, word in EQUIVALENT:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.replace(out, F.lit("  "), F.lit(" "))))


def lines(text: Column) -> Column:
    """Canonical lines of a text, without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), canonical), lambda x: x != "")


def digest(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.sha2(F.array_join(parts, " "), 256))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and digest of each known text; a bounded list given by the user."""
    rows = spark.createDataFrame(texts or KNOWN, "license_id string, body string")
    return rows.groupBy(digest(lines(F.col("body"))).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known_digests: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of `docs`: the key, digest of the canonical text, license_id of the whole text (null if unknown) and
    notices, the licences whose known text is one of its lines."""
    rows = docs.select(F.col(key).alias("_key"), lines(F.col(text)).alias("_lines"))
    whole = rows.select("_key", digest(F.col("_lines")).alias("digest"))
    parts = rows.select("_key", F.explode("_lines").alias("line")).select("_key", F.sha2("line", 256).alias("part"))
    found = parts.join(known_digests, F.col("part") == F.col("known_digest")).groupBy(F.col("_key").alias("_at")).agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    return (whole.join(known_digests, F.col("digest") == F.col("known_digest"), "left")
            .join(found, F.col("_key").eqNullSafe(F.col("_at")), "left")
            .select(F.col("_key").alias(key), "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices")))


def sql(texts: list[tuple[str, str]] | None = None) -> str:
    """The same over a table `documents` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = r"concat(' ', regexp_replace(lower(l), '[^\p{L}\p{N}]+', '  ', 'g'), ' ')"
    for other, word in EQUIVALENT:
        out = f"replace({out}, ' {other} ', ' {word} ')"
    canon = f"case when regexp_matches(lower(l), {quoted(COPYRIGHT)}) then '' else trim(replace({out}, '  ', ' ')) end"
    cut = lambda column: f"list_filter(list_transform(string_split({column}, chr(10)), lambda l: {canon}), lambda x: x <> '')"
    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in texts or KNOWN)
    return f"""
with raw(license_id, body) as (values {rows}),
known as (select sha256(array_to_string({cut('body')}, ' ')) as digest, min(license_id) as license_id from raw group by 1),
d as (select doc_id, {cut('text')} as lines from documents),
n as (select doc_id, list_sort(list(distinct license_id)) as notices
      from (select doc_id, unnest(lines) as line from d) p join known on sha256(line) = digest group by 1)
select d.doc_id, case when len(lines) > 0 then sha256(array_to_string(lines, ' ')) end as digest, k.license_id, array_to_string(coalesce(n.notices, []), ',') as notices
from d left join known k on len(lines) > 0 and k.digest = sha256(array_to_string(lines, ' ')) left join n on n.doc_id is not distinct from d.doc_id
"""
