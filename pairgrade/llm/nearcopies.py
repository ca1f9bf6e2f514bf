"""Near-copies by a signature-coordinate inverted join.

A text is the set of its distinct word shingles.  Equal sets are one class.
Each class has a signature of `COORDINATES` min-hash values and is posted
under every (coordinate, value) pair.  Two classes whose sets have Jaccard
similarity s agree in a binomial number of coordinates with mean s * 64; at
s = 0.8 they agree in fewer than `MATCHES` = 36 with probability 4e-6, so
pairs are candidates from 36 collisions on and are confirmed on full sets.

* Skip: a pair that only one class is posted under is dropped, and then every
  class with fewer than `MATCHES` postings left.
* Prefix: two classes that collide `MATCHES` times collide in the rarest
  m - MATCHES + 1 of their m postings, so only these are merged.
* Hubs: in each posting list every class is checked against one hub, the class
  with the heaviest postings.  In a large group of near-copies this links most
  of them with one check each.
* Rest, exactly: classes that may still collide with another component's lie in blocks of about `BLOCK` (by heaviest posting
  and, within a large component, by component).  Blocks that share a posting
  and hold more than one component between them are compared in one task:
  collisions are counted on the signatures; the members that have a candidate
  are compared once more with their sets, and only the links of a spanning
  forest returned.  So no group is held by
  one task, no pair is emitted that is not a link, none is left out.

Links are joined to components; a class of copies takes part as one node.

Edge cases: null and empty texts and texts without words have an empty set and
are linked with nothing; texts with fewer words than a shingle are one shingle;
rows without a key are measured and kept but linked with nothing; rows that
share a key are one node; repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrade.llm import flat
from pairgrade.llm.components import components
from pairgrade.llm.constants import may_hold
from pairgrade.session import materialize

COORDINATES, MATCHES = 64, 36
SHINGLE, PERCENT = 5, 80
BLOCK, LARGE, ROWS = 256, 64, 2048

_SALTS = flat.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    start, end, at = flat.words(data, off)
    h = flat.hashes(flat.lower(data), start, end)
    n = np.diff(at)
    own = np.repeat(np.arange(len(n)), n)
    key = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        key = key * np.uint64(0xD1342543DE82EF95) + h[j:len(h) - size + 1 + j] if len(key) else key
    key = flat.mix(key)
    out = []
    for i in range(len(n)):
        if n[i] >= size:
            out.append(np.unique(key[at[i]:at[i + 1] - size + 1]))
        elif n[i]:
            whole = np.zeros(1, np.uint64)
            for x in h[at[i]:at[i + 1]]:
                whole = whole * np.uint64(0xD1342543DE82EF95) + x
            out.append(flat.mix(whole + np.uint64(n[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of the `COORDINATES` hash functions over a set that is not empty."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 8192):
        part = shingles[lo:lo + 8192]
        for k, salt in enumerate(_SALTS):
            x = part * salt
            out[k] = min(out[k], (x ^ (x >> np.uint64(29))).min())
    return (flat.mix(out * np.uint64(0xBF58476D1CE4E5B9) + _SALTS) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signatures(size: int):
    """Arrow function: key, n, id (digest of the set) and signature of each text."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in flat.chunks(b.column("_text")):
                sets = shingle_sets(data, off, size)
                ids = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_key").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
                    ["_key", "n", "id", "sig"])

    return run


def _sets(size: int):
    """Arrow function: rep and set of each text whose set has the wanted digest."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in flat.chunks(b.column("_text")):
                rep, want = b.column("rep").slice(lo, hi - lo), b.column("id").slice(lo, hi - lo).to_pylist()
                sets = shingle_sets(data, off, size)
                own = [i for i, s in enumerate(sets) if hashlib.md5(s.tobytes()).digest() == want[i]]
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(own, pa.int64())), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["rep", "set"])

    return run


def confirm(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which (index in a, index in b) pairs have 100 * intersection >= percent * union."""
    sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(pairs) < 400:
        both = np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in pairs], np.int64)
    else:  # many pairs of few sets: product of their incidence matrices, some thousand shingles at a time
        ra, rb = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
        all_a, all_b = np.concatenate([a[i] for i in ra]), np.concatenate([b[j] for j in rb])
        shared = np.intersect1d(all_a, all_b)
        row_a, row_b = np.repeat(np.arange(len(ra)), sizes_a[ra]), np.repeat(np.arange(len(rb)), sizes_b[rb])
        total = np.zeros((len(ra), len(rb)), np.float32)
        for lo in range(0, len(shared), 4096):
            part = shared[lo:lo + 4096]
            sides = []
            for values, row, n in ((all_a, row_a, len(ra)), (all_b, row_b, len(rb))):
                at = np.minimum(np.searchsorted(part, values), len(part) - 1)
                hit = part[at] == values
                m = np.zeros((n, len(part)), np.float32)
                m[row[hit], at[hit]] = 1
                sides.append(m)
            total += sides[0] @ sides[1].T
        both = total[np.searchsorted(ra, pairs[:, 0]), np.searchsorted(rb, pairs[:, 1])].astype(np.int64)
    union = sizes_a[pairs[:, 0]] + sizes_b[pairs[:, 1]] - both
    return 100 * both >= percent * union


def forest(ends: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the given links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for u, v in ends.tolist():
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def _block_pairs(g: pd.DataFrame):
    """Row numbers of the two blocks of each pair in a bucket of pairs; the same twice for a block with itself."""
    a, b, side = (g[c].to_numpy() for c in ("block_a", "block_b", "side"))
    order = np.lexsort((side, b, a))
    x, y = a[order], b[order]
    for run in np.split(order, np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1):
        if len(run):
            cut = np.searchsorted(side[run], 1)
            first = run[:cut]
            yield first, first if a[run[0]] == b[run[0]] else run[cut:]


def _collisions(g: pd.DataFrame, matches: int, percent: int):
    """For each pair of blocks: their rows, and the (row, row) pairs of different components whose signatures collide
    often enough."""
    if not len(g):
        return
    sig, n, comp = np.stack(g["sig"].to_numpy()), g["n"].to_numpy(), g["comp"].to_numpy()
    for i, j in _block_pairs(g):
        ok = (comp[i][:, None] != comp[j][None]) & (100 * np.minimum(n[i][:, None], n[j][None]) >= percent * np.maximum(n[i][:, None], n[j][None]))
        if j is i:
            ok = np.triu(ok, 1)
        pairs = np.argwhere(ok)
        for lo in range(0, len(pairs), 1 << 14):
            part = pairs[lo:lo + (1 << 14)]
            part = part[(sig[i[part[:, 0]]] == sig[j[part[:, 1]]]).sum(1) >= matches]
            if len(part):
                yield i[part[:, 0]], j[part[:, 1]]


def _needed(matches: int, percent: int):
    """Pandas function over signatures of pairs of blocks: the members that have a candidate, with their side."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [np.union1d(i, j) for i, j in _collisions(g, matches, percent)]
        return g.iloc[np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]))][["block_a", "block_b", "side", "rep"]]

    return run


def _compare(matches: int, percent: int):
    """Pandas function over members with their sets: links of a spanning forest."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        links, rep = [], g["rep"].to_numpy()
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in g["set"]]
        for i, j in _collisions(g, matches, percent):
            good = confirm(sets, sets, np.stack([i, j], 1), percent)
            links += forest(np.stack([rep[i[good]], rep[j[good]]], 1))
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


def _candidates(classes: DataFrame, matches: int) -> DataFrame:
    """Classes that may have a partner: id, rep, n, sig, weight, prefix (their rarest postings) and home (their heaviest)."""
    posted = classes.select("rep", F.posexplode("sig").alias("c", "value")).select("rep", F.xxhash64("c", "value").alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    own = posted.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("posts"))  # 64 for each class
    own = own.where(F.size("posts") >= matches)
    return classes.join(own, "rep").select(
        "id", "rep", "n", "sig", F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["times"]).alias("weight"),
        F.slice("posts", F.lit(1), F.size("posts") - (matches - 1)).alias("prefix"), F.element_at("posts", -1).alias("home"))


def _touched(placed: DataFrame, matches: int, percent: int) -> DataFrame:
    """Classes that share a posting with a class of another component that may collide often enough.

    Two bits of each coordinate fit two numbers; coordinates that are equal have equal bits, so fewer than `matches`
    equal pairs of bits rule a pair out.  A semi join: one row for each posting at most."""
    half = lambda i: F.aggregate(F.slice("sig", 1 + i * COORDINATES // 2, COORDINATES // 2), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 2).bitwiseOR(x.bitwiseAND(3).cast("long")))
    posts = placed.select("rep", "comp", "n", half(0).alias("s0"), half(1).alias("s1"), F.explode("token").alias("token"))
    a, b = posts.alias("a"), posts.alias("b")

    def differ(c: str):
        x = F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(0x5555555555555555))

    alike = COORDINATES - differ("s0") - differ("s1") >= matches
    size = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & size & alike, "left_semi").select("rep").distinct()


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """Per row of `docs`: key (an integer), n_shingles, component_id (smallest key reachable) and kept."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    measured = materialize(rows.mapInArrow(_signatures(shingle), "_key long, n long, id binary, sig array<int>"))
    live = measured.where(F.col("_key").isNotNull() & (F.col("n") > 0))
    classes = materialize(live.groupBy("id").agg(F.min("_key").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    found = materialize(_candidates(classes, matches))

    def build(owners: DataFrame) -> DataFrame:
        """rep and set of the classes that `owners` names."""
        owners = materialize(owners.select("rep").distinct().join(found.select("rep", "id"), "rep"))
        texts = rows.where(may_hold(owners, "rep")(F.col("_key"))).join(owners, F.col("_key") == F.col("rep")).select("rep", "id", "_text")
        return materialize(texts.mapInArrow(_sets(shingle), "rep long, set array<long>"))

    posts = found.select("rep", "weight", F.explode("prefix.token").alias("token"))
    hubs = posts.groupBy("token").agg(F.max(F.struct("weight", "rep")).alias("hub"), F.count(F.lit(1)).alias("times"))
    stars = posts.join(hubs.where(F.col("times") > 1), "token").select("rep", F.col("hub.rep").alias("hub")).where("rep <> hub").distinct()
    signed = lambda k: found.select(F.col("rep").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n").alias(f"n_{k}"))
    full = lambda k: sets.select(F.col("rep").alias(k), F.col("set").alias(f"set_{k}"))
    agree = F.size(F.filter(F.zip_with("sig_rep", "sig_hub", lambda x, y: x == y), lambda x: x))
    near = 100 * F.least("n_rep", "n_hub") >= percent * F.greatest("n_rep", "n_hub")
    close = materialize(stars.join(signed("rep"), "rep").join(signed("hub"), "hub").where(near & (agree >= matches)).select("rep", "hub"))
    sets = build(close.select("rep").union(close.select("hub")))
    both = F.size(F.array_intersect("set_rep", "set_hub"))
    alike = close.join(full("rep"), "rep").join(full("hub"), "hub").where(100 * both >= percent * (F.size("set_rep") + F.size("set_hub") - both))
    first = materialize(alike.select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    reached = components(first)

    size = reached.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    block = F.xxhash64("home.token", F.when(F.col("members") >= LARGE, F.col("root")), F.pmod(F.xxhash64("rep"), F.ceil(F.col("home.times") / BLOCK)))
    placed = materialize(found.join(reached.withColumnRenamed("node", "rep"), "rep", "left").join(size, "root", "left")
                         .select("rep", "n", "sig", F.coalesce("root", "rep").alias("comp"), block.alias("block"), "prefix.token"))
    placed = materialize(placed.join(_touched(placed, matches, percent), "rep"))
    blocks = placed.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = placed.select("comp", F.explode("token").alias("token")).groupBy("token").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l <> h")
    touch = materialize(placed.select("block", F.explode("token").alias("token")).join(mixed.select("token"), "token", "left_semi").distinct().join(blocks, "block"))
    a, b = (touch.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high"))) for s in "ab")
    pairs = materialize(a.join(b, "token").where("block_a <= block_b and least(low_a, low_b) <> greatest(high_a, high_b)").select("block_a", "block_b").distinct())
    sides = pairs.select("block_a", "block_b", F.lit(0).alias("side"), F.col("block_a").alias("block")).unionByName(
        pairs.where("block_a <> block_b").select("block_a", "block_b", F.lit(1).alias("side"), F.col("block_b").alias("block")))
    # Pairs of small blocks share a task's call: buckets of about `ROWS` rows.
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    total = sides.join(sizes, "block").agg(F.sum("size")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("block_a", "block_b"), F.lit(max(1, -(-total // ROWS)))).alias("bucket")
    met = sides.join(placed.select("rep", "n", "sig", "comp", "block"), "block").withColumn("bucket", bucket)
    needed = materialize(met.groupBy("bucket").applyInPandas(_needed(matches, percent), "block_a long, block_b long, side int, rep long"))
    sets = sets.unionByName(build(needed.join(sets.select("rep"), "rep", "left_anti")))
    near = needed.join(placed.select("rep", "n", "sig", "comp"), "rep").join(sets, "rep").withColumn("bucket", bucket)
    second = near.groupBy("bucket").applyInPandas(_compare(matches, percent), "u long, v long")
    links = first.unionByName(materialize(second))

    roots = components(links)
    of = classes.select("id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    return (measured.select("_key", "n", F.when(F.col("_key").isNotNull(), F.col("id")).alias("id")).join(of, "id", "left")
            .withColumn("component_id", F.coalesce("root", "_key"))
            .select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept")))
