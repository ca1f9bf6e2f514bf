"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line (between newlines) is the set of its distinct words.  A line goes if an
earlier line, in the order of key and line number, is like it: Jaccard
similarity of at least `PERCENT` / 100.  Lines of fewer than `MIN_WORDS` words
are no boilerplate worth removing and stay.

* Rarity: words are counted over all lines in `RARITY` counters, by hash.  The
  counters' order goes to the tasks as one array of fixed size, so
  each word becomes a number whose order is rarity first, hash second; sets
  are sorted arrays of these numbers.
* Equal sets are one class with its earliest place.
* Prefix: similar sets of n words share one of their n - ceil(p n) + 1 rarest.
  Classes are posted under those only, with their size, the word's position
  and a 64-bit parity map of the set.
* Filters in the join condition: length; position (what can still be common
  after the shared word); parity (the common words are at most half of both
  sizes less the differing bits).
* Verification: candidates' full sets are built again from their texts and
  joined once more; the condition ends with the size of the intersection.

Both joins are semi joins: a line leaves at its first match, so a group of many
similar lines yields one row for each line and not one for each pair.  The
first keeps every line with a candidate on either side, its two sides being
one exchange; the second asks for an earlier match.  They are on the word alone, between plain exchanges, so a frequent word's
partition can be split.

Edge cases: null texts stay null, empty ones empty; lines of rows without a key
come last in order; rows that share a key are one document: a line is not a
repeat of the line at its own place; a repeated row thus keeps the same lines;
texts and lines of any length are used whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgrade.llm.constants import constant, let, may_hold
from pairgrade.session import materialize

PERCENT, MIN_WORDS = 90, 3
RARITY_BITS = 17


# Fixed: white space within a line.
_SPACE = " \\t\\x0b\\x0c\\r"


def _words(line: Column) -> Column:
    """Split at single spaces, which takes no pattern; other white space is rare and becomes spaces first."""
    other = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    spaced = F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _lines(docs: DataFrame, text: str, key: str, min_words: int) -> DataFrame:
    """Lines of at least `min_words` words (a pattern from the line's start, so that a filter does not split the line)."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    return rows.where(F.col("body").rlike(f"^[{_SPACE}]*+(?:[^{_SPACE}]++[{_SPACE}]++){{{max(0, min_words - 1)}}}[^{_SPACE}]"))


def _order(docs: DataFrame, text: str) -> Column:
    """Place of each of the 2 ** RARITY_BITS hash counters, rarest first, as a constant of the query."""
    n = 1 << RARITY_BITS
    counts = docs.select(F.explode(F.split(text, f"[{_SPACE}\\n]+")).alias("w")).groupBy(F.xxhash64("w").bitwiseAND(n - 1).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["b"]: r["n"] for r in counts}
    place = [0] * n
    for i, b in enumerate(sorted(range(n), key=lambda b: (found.get(b, 0), b))):
        place[b] = i
    return constant(docs.sparkSession, place=pa.array(place, pa.int32()))


def _sets(lines: DataFrame, order: Column) -> DataFrame:
    """set: sorted distinct numbers of the words; the high bits are the place in `order`, the low ones the rest of the hash."""
    n = 1 << RARITY_BITS
    place = lambda t, w: F.shiftleft(F.get(t["place"], F.xxhash64(w).bitwiseAND(n - 1).cast("int")).cast("long"), 63 - RARITY_BITS)
    number = lambda t: F.transform(_words(F.col("body")), lambda w: place(t, w).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), RARITY_BITS + 1)))
    rows = lines.withColumn("_order", order)
    return rows.select("doc", "line", let(F.col("_order"), lambda t: F.sort_array(F.array_distinct(number(t)))).alias("set"))


def _earlier(a: str, b: str) -> Column:
    """Place a lies before place b; rows without a key last."""
    da, db = F.col(f"{a}.doc"), F.col(f"{b}.doc")
    same = da.eqNullSafe(db) & (F.col(f"{a}.line") < F.col(f"{b}.line"))
    return same | F.coalesce(da < db, F.lit(False)) | (da.isNotNull() & db.isNull())


def _least_common(percent: int, a: str, b: str) -> Column:
    return F.ceil(percent * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + percent))


def removals(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc and line (from 0) of every line that goes."""
    lines = _lines(docs, text, key, min_words)
    order = _order(docs, text)
    prefix = F.slice("set", F.lit(1), F.size("set") - F.ceil(percent * F.size("set") / 100).cast("int") + 1)
    parity = F.aggregate("set", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))))
    held = materialize(_sets(lines, order).select("doc", "line", F.size("set").alias("n"), F.xxhash64(F.lit(1), "set").alias("k1"), F.xxhash64(F.lit(2), "set").alias("k2"), prefix.alias("prefix"), parity.alias("parity")))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "line")
    classes = materialize(held.groupBy("k1", "k2").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("times"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
                          .select("k1", "k2", F.col("p.doc").alias("doc"), F.col("p.line").alias("line"), "times", "n", "prefix", "parity"))

    # Sets of fewer words than this are similar only if equal.
    least = -(-100 // (100 - percent)) if percent < 100 else 1 << 30
    posts = classes.where(F.col("n") >= least - 1).select("doc", "line", "n", "parity", F.posexplode("prefix").alias("i", "word"))
    a, b = posts.alias("a"), posts.alias("b")
    common = _least_common(percent, "a", "b")
    rest = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))  # the shared word and those after it
    differ = F.bit_count(F.col("a.parity").bitwiseXOR(F.col("b.parity")))
    like = ((F.col("a.word") == F.col("b.word")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
            & (rest >= common) & (F.col("a.n") + F.col("b.n") - differ >= 2 * common))
    apart = _earlier("a", "b") | _earlier("b", "a")
    touched = materialize(a.join(b, like & apart, "left_semi").select("doc", "line").distinct())

    owners = materialize(touched.groupBy(F.col("doc").alias("owner")).agg(F.collect_set("line").alias("chosen")))  # a text's own lines
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text")).where(may_hold(owners, "owner")(F.col("doc")))
    texts = texts.join(owners, F.col("doc").eqNullSafe(F.col("owner")))
    again = texts.select("doc", "chosen", F.posexplode(F.split("_text", "\n")).alias("line", "body")).where(F.array_contains("chosen", F.col("line")))
    whole = _sets(again.select("doc", "line", "body"), order).withColumn("n", F.size("set")).withColumn("parity", parity).withColumn("prefix", prefix)
    whole = materialize(whole)
    # Words that only one of these lines has in its prefix meet nothing: they need not carry a set to the join.
    met = whole.select(F.explode("prefix").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("word")
    light = whole.select("doc", "line", F.posexplode("prefix").alias("i", "word")).join(met, "word", "left_semi")
    kept = materialize(light.groupBy("doc", "line").agg(F.collect_list(F.struct("i", "word")).alias("posts")))  # a prefix at most
    full = whole.join(kept.select(F.col("doc").alias("d"), F.col("line").alias("l"), "posts"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l")))
    full = full.select("doc", "line", "n", "parity", "set", F.inline("posts"))
    a, b = full.alias("a"), full.alias("b")
    exact = F.size(F.array_intersect(F.col("a.set"), F.col("b.set"))) >= common
    near = materialize(b.join(a, like & _earlier("a", "b") & exact, "left_semi").select("doc", "line").distinct())

    flagged = classes.join(near.select(F.col("doc").alias("d"), F.col("line").alias("l"), F.lit(True).alias("near")), F.col("doc").eqNullSafe(F.col("d")) & (F.col("line") == F.col("l")), "left")
    decided = flagged.where((F.col("times") > 1) | F.col("near")).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.struct("doc", "line").alias("c"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = held.select("doc", "line", "k1", "k2").join(decided, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    at_first = F.col("doc").eqNullSafe(F.col("c.doc")) & (F.col("line") == F.col("c.line"))
    return gone.where(F.col("near") | ~at_first).select("doc", "line").distinct()


def _by_document(gone: DataFrame) -> DataFrame:
    return gone.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_list("line")).alias("_gone"))  # as long as a text's lines


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of `docs`: the key, n_lines, n_removed and removed (line numbers from 0)."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    gone = _by_document(removals(docs, text, key, percent, min_words))
    none = F.array().cast("array<int>")
    return rows.join(gone, F.col("_key").eqNullSafe(F.col("_doc")), "left").select(F.col("_key").alias(key), "n_lines", F.size(F.coalesce("_gone", none)).alias("n_removed"), F.coalesce("_gone", none).alias("removed"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the texts' remaining lines; rows and other columns stay as they are."""
    gone = _by_document(removals(docs, text, key, percent, min_words))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.struct(*docs.columns).alias("row")).join(gone, F.col("_key").eqNullSafe(F.col("_doc")), "left")
    kept = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    out = F.when(F.col("_gone").isNull(), F.col("row")[text]).otherwise(kept)
    return rows.select(*(out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def sql(percent: int = PERCENT, min_words: int = MIN_WORDS) -> str:
    """`report` over a table `documents` in DuckDB's SQL."""
    return f"""
with d as (select doc_id, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, unnest(range(len(lines))) as line, unnest(lines) as body from d where lines is not null),
w as (select doc_id, line, list_filter(regexp_split_to_array(body, '[ \\t\\x0b\\x0c\\r]+'), lambda x: x <> '') as words from l),
s as (select doc_id, line, list_sort(list_distinct(words)) as set from w where len(words) >= {min_words}),
c as (select set, min(struct_pack(doc_id := doc_id, line := line)) as p, row_number() over (order by min(struct_pack(doc_id := doc_id, line := line))) as place, len(set) as n from s group by set),
t as (select place, n, unnest(set) as word from c),
f as (select word, count(*) as times from t group by word),
o as (select place, n, word, row_number() over (partition by place order by times, word) as i from t join f using (word)),
x as (select * from o where i <= n - cast(ceil({percent} * n / 100.0) as bigint) + 1),
pairs as (select distinct a.place as a, b.place as b from x a join x b on a.word = b.word and a.place < b.place
          and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
near as (select distinct b from pairs join c ca on ca.place = a join c cb on cb.place = b
         where (100 + {percent}) * len(list_intersect(ca.set, cb.set)) >= {percent} * (ca.n + cb.n)),
gone as (select distinct s.doc_id, s.line from s join c using (set) left join near on near.b = c.place
         where near.b is not null or s.doc_id <> c.p.doc_id or s.line <> c.p.line),
g as (select doc_id, list_sort(list(line)) as removed from gone group by doc_id)
select d.doc_id, cast(coalesce(len(d.lines), 0) as integer) as n_lines, cast(coalesce(len(g.removed), 0) as integer) as n_removed,
       array_to_string(coalesce(g.removed, []), ',') as removed
from d left join g on g.doc_id is not distinct from d.doc_id
"""
