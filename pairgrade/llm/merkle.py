"""Merkle manifest of a dataset: a leaf for each row, a tree for each group, a tree over the groups' roots.

H is the lower-case hexadecimal SHA-256 digest.  A leaf is H of the row's fields.  Nodes of a level lie in order; every
`FANOUT` consecutive ones become their H (the last run may be shorter, even a single node) while there is more than
one.  What remains is the group's subroot; the subroots, in the groups' order (null first, bytewise), make the root.

* Levels are strings: a block of `FANOUT` ** `LEVELS` consecutive nodes is one row that keeps each of its levels as one
  string of hexadecimal digests.  Parents are digests of substrings of fixed width, and a node's siblings are the two
  substrings beside its own within its run.  All of it is SQL on binary strings, in which a substring takes no search.
* Roots of blocks are the nodes of the next round; the rounds recurse until each group has one block.  A block has a
  bounded number of rows, so no group is held by one task, however large; a round divides the rows by 4,096.
* Places are exact: leaves are written in range order, every file numbers its rows, and the numbers before a file come
  from a count for each file and group.

Edge cases: a null field is `-`; rows of equal keys are ordered by their leaf, rows without a key come first; a null
group is a group of its own; a lone leaf is its subroot, a lone subroot the root; an empty table has no rows and no
root; repeated rows are leaves of their own; fields of any length are used whole.  Columns are taken by name, others
do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairgrade.session import materialize

FANOUT, LEVELS, HEX = 16, 3, 64
BLOCK = FANOUT ** LEVELS


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with pos, the place from 0 within the group by `order`, and n, the size of the group."""
    by = [group, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    filed = materialize(ranged.withColumns({"_file": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = filed.groupBy("_file", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("_file", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return filed.join(places, ["_file", group]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_file", "_at", "_shift")


def _up(level: Column) -> Column:
    """The level above: the digest of each run of `FANOUT` digests, one after the other."""
    width = FANOUT * HEX
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """A row for each block of nodes (g, pos, n, hash, payload): g, block, n and its members in order."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return nodes.groupBy("g", block).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "hash", *payload))).alias("members"))


def _levels(blocks: DataFrame) -> DataFrame:
    """`blocks` with l0 to l2, the levels below `LEVELS`, n0 to n2, the nodes that the group has in them, and top."""
    out = blocks.withColumn("l0", F.array_join("members.hash", "").cast("binary")).withColumn("n0", F.col("n"))
    for k in range(1, LEVELS + 1):
        more = F.col(f"n{k - 1}") > 1
        out = out.withColumn(f"l{k}", F.when(more, _up(F.col(f"l{k - 1}"))).otherwise(F.col(f"l{k - 1}")))
        out = out.withColumn(f"n{k}", F.ceil(F.col(f"n{k - 1}") / FANOUT).cast("long"))
    return out.withColumn("top", F.col(f"l{LEVELS}").cast("string"))


def _beside(k: int, i: Column) -> Column:
    """Siblings on level k, before and after, of the node above place i of the block."""
    level, node, width = F.col(f"l{k}"), F.floor(i / FANOUT ** k).cast("int"), FANOUT * HEX
    run = F.floor(node / FANOUT).cast("int") * width
    own = (node % FANOUT) * HEX
    return F.struct(F.substring(level, run + 1, own).alias("before"), F.substring(level, run + own + 1 + HEX, width - HEX - own).alias("after"))


_PATH = "array<struct<before:binary,after:binary>>"


def _paths(nodes: DataFrame, payload: Sequence[str] = (), above=None) -> DataFrame:
    """g, pos, hash, payload, subroot and path (siblings from below, before and after) of each node.

    `above`: a function of the groups' subroots (g, subroot) that gives further columns of g, among them `rest`, the
    path from there on."""
    blocks = _blocks(nodes, payload)
    blocks = materialize(blocks)
    levelled = _levels(blocks)
    tops = materialize(levelled.select("g", "block", "n", "top"))
    roots = tops.where(F.col("n") <= BLOCK).select("g", "block", F.col("top").alias("subroot"), F.array().cast(_PATH).alias("higher"))
    large = tops.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        next_nodes = large.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("hash"))
        further = _paths(next_nodes).select("g", F.col("pos").alias("block"), "subroot", F.col("path").alias("higher"))
        roots = roots.unionByName(materialize(further))
    kept = levelled.join(roots, ["g", "block"])
    extra: list[str] = []
    if above is not None:
        over = above(roots.select("g", "subroot").distinct())
        extra = [c for c in over.columns if c not in ("g", "rest")]
        kept = kept.join(over, "g").withColumn("higher", F.concat("higher", "rest"))
    own = lambda i: F.when(F.col("n2") > 1, F.array(*(_beside(k, i) for k in range(3)))).when(
        F.col("n1") > 1, F.array(*(_beside(k, i) for k in range(2)))).when(F.col("n0") > 1, F.array(_beside(0, i))).otherwise(F.array().cast(_PATH))
    one = F.explode(F.transform("members", lambda m, i: F.struct(*(m[c].alias(c) for c in ("pos", "hash", *payload)), F.concat(own(i), F.col("higher")).alias("path"))))
    return kept.select("g", "subroot", *extra, one.alias("m")).select("g", "subroot", *extra, "m.*")


def manifest(rows: DataFrame, key: str, group: str, leaf: str = "leaf", carry: Sequence[str] = ()) -> DataFrame:
    """For each of `rows`: key, group, leaf, subroot, root, path and the columns to `carry`.

    `leaf` holds the digest of the row.  path is the proof: for each level from the leaf's to the root's the siblings
    before and after the node, as strings of digests; `folded` gives the root again."""
    held = rows.select(F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n")).alias("g"),
                       F.col(key).alias("k"), F.col(leaf).alias("hash"), F.struct(F.col(group).alias("group"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry))).alias("held"))
    nodes = _numbered(materialize(held), "g", ["k", "hash"])

    def over_groups(roots: DataFrame) -> DataFrame:
        named = _numbered(roots.select("g", "subroot").withColumn("all", F.lit(0)), "all", ["g"])
        paths = _paths(named.select(F.col("all").alias("g"), "pos", "n", F.col("subroot").alias("hash"), F.col("g").alias("name")), ["name"])
        return materialize(paths.select(F.col("name").alias("g"), F.col("subroot").alias("root"), F.col("path").alias("rest")))

    found = _paths(nodes, ["k", "held"], over_groups)
    return found.select(F.col("k").alias(key), F.col("held.group").alias(group), F.col("hash").alias("leaf"), "subroot", "root", "path",
                        *(F.col(f"held.c{i}").alias(c) for i, c in enumerate(carry)))


def siblings(path: Column) -> Column:
    """All siblings of a path as one binary string, from the leaf's to the root's, left to right."""
    return F.aggregate(path, F.lit(b""), lambda acc, s: F.concat(acc, s["before"], s["after"]))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf.cast("binary"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256).cast("binary")).cast("string")


def crc32_sql(digits: str) -> str:
    """DuckDB expression of the unsigned crc32 of a text of ASCII characters, bit by bit."""
    steps = f"flatten(list_transform(string_split({digits}, ''), lambda c: list_prepend(cast(ascii(c) as bigint), [-1, -1, -1, -1, -1, -1, -1, -1])))"
    step = "case when s >= 0 then xor(c, s) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {steps}), lambda c, s: {step}), 4294967295)"


def sql(levels: int = 7, group_levels: int = 4) -> str:
    """DuckDB SQL of the query over `documents`, for groups of up to 16 ** `levels` rows."""
    part = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    digest = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""t as (select doc_id, coalesce('s' || source, 'n') as g, {digest('text')} as leaf,
      case when doc_id is not null and {crc32_sql('cast(doc_id as varchar)')} % 5 = 0 then {digest(low)} else {digest('text')} end as other from documents)""",
           """p0 as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, other as f, '' as proof from t)""",
           """a0 as (select g, i, leaf as h, count(*) over (partition by g) as n from p0)"""]

    def climb(k: int, key: str, a: str, p: str) -> None:
        out.append(f"r{a}{k} as (select {key}, i // 16 as i, n, string_agg(h, '' order by i) as s from {a}{k} group by all)")
        out.append(f"{a}{k + 1} as (select {key}, i, case when n > 1 then sha256(s) else s end as h, case when n > 1 then (n + 15) // 16 else 1 end as n from r{a}{k})")
        cut = f"(p.i % 16) * {HEX}"
        out.append(f"""{p}{k + 1} as (select p.* exclude (i, f, proof), p.i // 16 as i,
      case when n > 1 then sha256(substr(s, 1, {cut}) || f || substr(s, {cut} + {HEX + 1})) else f end as f,
      case when n > 1 then proof || substr(s, 1, {cut}) || substr(s, {cut} + {HEX + 1}) else proof end as proof
      from {p}{k} p join r{a}{k} r on p.{key} = r.{key} and p.i // 16 = r.i)""")

    for k in range(levels):
        climb(k, "g", "a", "p")
    out.append(f"b as (select g, 0 as u, row_number() over (order by g) - 1 as i, h, count(*) over () as n from a{levels})")
    out.append("b0 as (select u, i, h, n from b)")
    out.append(f"q0 as (select p.* exclude (i), b.i, b.u, b.h as subroot from p{levels} p join b on p.g = b.g)")
    for k in range(group_levels):
        climb(k, "u", "b", "q")
    return "with " + ",\n".join(out) + f"""
select doc_id, leaf, subroot, a.h as root, sha256(proof) as proof_sha256, f as folded_root, f = a.h as verified from q{group_levels}, b{group_levels} a"""
