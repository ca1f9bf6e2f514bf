"""Jaccard join of texts on word n-grams, as a blocked sparse matrix product.

A text is the set of its distinct word n-grams, by 64-bit hash; equal sets are one class, a row of the incidence matrix
of classes by n-grams.  Its product with its transpose holds the overlaps; two classes link when
100 * overlap >= percent * union.  Most of the product is ruled out by sizes before any pair is looked at:

* Sieve: a class has a partner only if at least percent / 100 of its n-grams occur in other classes too.  N-grams are
  dealt to buckets as packed arrays; a task sends each n-gram once, however many of its texts hold it, so a frequent
  n-gram costs one entry for each task and not for each text.  Buckets reply with the number of shared n-grams of each
  class.  Only classes that reach the bound go on, without the n-grams that no other one of them has.
* Blocks: with n-grams ordered by rarity, linked sets of n share one of the n - ceil(p n) + 1 rarest.  Classes that
  are tied by such n-grams lie in one block; most blocks are small, and many of them make a task.
* Product: a task multiplies the block's rows, some thousand columns at a time, the rarest first.  After each group of
  columns, rows and columns of the overlap matrix leave when no pair of theirs can still reach the overlap that their
  sizes ask for: what they share so far and the smaller of what is left.
* Large blocks (over `ROWS` classes or `TOKENS` n-grams) are cut in parts.  All parts are first held against one row,
  the class of the most frequent n-grams; only classes that it does not link are then held against all parts.

Tasks return the links of a spanning forest; pairs that do not link are never written.  Links join to components.

Edge cases: null and empty texts and texts without words have an empty set and are linked with nothing; texts with
fewer words than an n-gram are one n-gram; rows without a key are measured, but linked with nothing, and their
component is null; rows that share a key are judged each by its own text; repeated rows are copies of each other;
an empty table gives an empty result.  Classes are told apart by 64 bits of a digest.
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
from pairgrade.llm.nearcopies import forest, shingle_sets
from pairgrade.session import materialize

NGRAM, PERCENT = 4, 85
SEND, SIEVE = 1 << 20, 1 << 20  # n-grams that a task packs at a time; n-grams of a bucket
ROWS, TOKENS = 2048, 1 << 20
TILE, COLUMNS = 512, 4096


def _class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _measure(size: int):
    def run(batches):
        for b in batches:
            for lo, hi, data, off in flat.chunks(b.column("_text")):
                sets = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([_class(s) if len(s) else None for s in sets], pa.int64())], ["_key", "n", "cls"])

    return run


def _wanted(size: int):
    """Arrow function: cls and set of each text whose class is the wanted one."""

    def run(batches):
        for b in batches:
            for lo, hi, data, off in flat.chunks(b.column("_text")):
                cls = b.column("cls").slice(lo, hi - lo).to_pylist()
                own = [(c, s) for c, s in zip(cls, shingle_sets(data, off, size), strict=True) if len(s) and _class(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64()))], ["cls", "set"])

    return run


PACKED = "bucket long, grams binary, marks binary, owners binary"


def _pack(held: dict[int, np.ndarray], buckets: int) -> list[tuple]:
    """Rows of `PACKED` for some classes: for each bucket its n-grams (without the bucket), each with the number of its
    class among `owners` (0: of several); and one row with the number of n-grams that each class shares here."""
    if not held:
        return []
    ids = np.array(list(held), np.int64)
    gram, own = np.concatenate(list(held.values())), np.repeat(np.arange(len(ids)), [len(s) for s in held.values()])
    order = np.argsort(gram)
    gram, own = gram[order], own[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    times = np.diff(np.r_[first, len(gram)])
    many = np.repeat(times > 1, times)
    out = [(int(ids[0] % buckets), b"", np.bincount(own[many], minlength=len(ids)).astype(np.int64).tobytes(), ids.tobytes())]
    gram, own = gram[first], np.where(times > 1, -1, own[first])
    bucket = (gram % np.uint64(buckets)).astype(np.int64)
    rest = (gram // np.uint64(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(gram) else np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if lo < hi:
            at = order[lo:hi]
            present, mark = np.unique(np.r_[-1, own[at]], return_inverse=True)
            out.append((int(bucket[at[0]]), rest[at].tobytes(), mark[1:].astype(np.uint32 if len(present) > 65535 else np.uint16).tobytes(), ids[present[1:]].tobytes()))
    return out


def _send(size: int, buckets: int):
    def run(batches):
        held: dict[int, np.ndarray] = {}
        total = 0

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "grams", "marks", "owners"])

        for b in batches:
            for _, _, data, off in flat.chunks(b.column("_text")):
                for s in shingle_sets(data, off, size):
                    if len(s) and (c := _class(s)) not in held:
                        held[c] = s
                        total += len(s)
                if total >= SEND:
                    yield batch(_pack(held, buckets))
                    held, total = {}, 0
        if held:
            yield batch(_pack(held, buckets))

    return run


def _reply(dests: int):
    """Pandas function over a bucket: how many of its n-grams each class shares with another, packed by destination."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids, counts, grams, owners, shared = [], [], [], [], []
        for gram, mark, own in zip(g["grams"], g["marks"], g["owners"], strict=True):
            own = np.frombuffer(own, np.int64)
            if not len(gram):
                ids.append(own)
                counts.append(np.frombuffer(mark, np.int64))
                continue
            gram = np.frombuffer(gram, np.uint32)
            mark = np.frombuffer(mark, np.uint16 if len(mark) == 2 * len(gram) else np.uint32)
            grams.append(gram)
            owners.append(np.r_[0, own][mark])
            shared.append(mark == 0)
        if grams:
            gram, own, many = np.concatenate(grams), np.concatenate(owners), np.concatenate(shared)
            order = np.lexsort((own, many, gram))
            gram, own, many = gram[order], own[order], many[order]
            first = np.r_[True, gram[1:] != gram[:-1]]
            fresh = (first | (own != np.r_[0, own[:-1]])) & ~many
            group = np.cumsum(first) - 1
            known = (np.bincount(group, weights=fresh) > 1) | (np.bincount(group, weights=many) > 0)
            hit = own[fresh & known[group]]
            u, n = np.unique(hit, return_counts=True)
            ids.append(u)
            counts.append(n)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        dest = (ids % dests).astype(np.int64)
        out = [(int(d), ids[dest == d].tobytes(), counts[dest == d].astype(np.int32).tobytes()) for d in np.unique(dest[counts > 0])]
        return pd.DataFrame(out, columns=["dest", "ids", "counts"])

    return run


def _total(g: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in g["ids"]]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([np.frombuffer(x, np.int32) for x in g["counts"]]))
    return pd.DataFrame({"cls": ids, "shared": n.astype(np.int64)})


def _incidence(values: np.ndarray, row: np.ndarray, rows: int, columns: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
    hit = columns[at] == values
    m = np.zeros((rows, len(columns)), np.float32)
    m[row[hit], at[hit]] = 1
    return m


def _tile(a: list[np.ndarray], na: np.ndarray, b: list[np.ndarray], nb: np.ndarray, percent: int) -> np.ndarray:
    """(row of a, row of b) pairs with 100 * overlap >= percent * union; a and b hold the shared n-grams of sets of
    na and nb n-grams."""
    need = -(-percent * (na[:, None] + nb[None]) // (100 + percent))
    ia, ib = np.arange(len(a)), np.arange(len(b))

    def flatten(sets, rows):
        return np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])

    (va, ra), (vb, rb) = flatten(a, ia), flatten(b, ib)
    ua, ca = np.unique(va, return_counts=True)
    ub, cb = np.unique(vb, return_counts=True)
    both, xa, xb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = both[np.argsort(ca[xa] + cb[xb], kind="stable")]
    ka, kb = np.isin(va, both), np.isin(vb, both)
    va, ra, vb, rb = va[ka], ra[ka], vb[kb], rb[kb]
    left_a, left_b = np.bincount(ra, minlength=len(ia)), np.bincount(rb, minlength=len(ib))
    total = np.zeros((len(ia), len(ib)), np.float32)
    lo = 0
    while True:
        alive = total + np.minimum(left_a[:, None], left_b[None]) >= need
        keep_a, keep_b = alive.any(1), alive.any(0)
        if not keep_a.any():
            return np.zeros((0, 2), np.int64)
        if keep_a.sum() < len(ia) or keep_b.sum() < len(ib):
            total, need = total[np.ix_(keep_a, keep_b)], need[np.ix_(keep_a, keep_b)]
            ia, ib, left_a, left_b = ia[keep_a], ib[keep_b], left_a[keep_a], left_b[keep_b]
            new_a, new_b = np.cumsum(keep_a) - 1, np.cumsum(keep_b) - 1
            va, ra = va[keep_a[ra]], new_a[ra[keep_a[ra]]]
            vb, rb = vb[keep_b[rb]], new_b[rb[keep_b[rb]]]
        if lo >= len(both):
            hit = np.argwhere(total >= need)
            return np.stack([ia[hit[:, 0]], ib[hit[:, 1]]], 1)
        part = np.sort(both[lo:lo + COLUMNS])
        ma, mb = _incidence(va, ra, len(ia), part), _incidence(vb, rb, len(ib), part)
        total += ma @ mb.T
        left_a, left_b = left_a - ma.sum(1).astype(np.int64), left_b - mb.sum(1).astype(np.int64)
        lo += COLUMNS


def product(cls_a, a, na, cls_b, b, nb, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest between rows of a and b (the same lists: within a)."""
    out = []
    for i in range(0, len(a), TILE):
        for j in range(i if a is b else 0, len(b), TILE):
            hit = _tile(a[i:i + TILE], na[i:i + TILE], b[j:j + TILE], nb[j:j + TILE], percent)
            ends = np.stack([cls_a[i + hit[:, 0]], cls_b[j + hit[:, 1]]], 1)
            out += forest(ends[ends[:, 0] != ends[:, 1]])
    return forest(np.array(out, np.int64).reshape(-1, 2))


LINK = "u long, v long"


def _multiply(percent: int, by: list[str]):
    """Pandas function over blocks: rows of side 0, among themselves or against those of side 1 where there are any."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in g.groupby(by, sort=False):
            cls, n = x["cls"].to_numpy(), x["n"].to_numpy()
            sets = [np.asarray(t, np.int64) for t in x["grams"]]
            side = x["side"].to_numpy() == 1
            d, q = np.flatnonzero(~side), np.flatnonzero(side)
            a = [sets[i] for i in d]
            if len(q):
                out += product(cls[q], [sets[i] for i in q], n[q], cls[d], a, n[d], percent)
            else:
                out += product(cls[d], a, n[d], cls[d], a, n[d], percent)
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _large_links(rows: DataFrame, percent: int, most_rows: int, most_tokens: int) -> DataFrame:
    """Links within large blocks; rows: root, members, tokens, cls, n, grams, weight."""
    parts = F.greatest(F.ceil(F.col("members") / most_rows), F.ceil(F.col("tokens") / most_tokens)).cast("long")
    dealt = materialize(rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), "parts")))
    hub = dealt.groupBy("root").agg(F.max_by("cls", F.struct("weight", "cls")).alias("cls"))
    hub = materialize(dealt.join(hub, ["root", "cls"]).drop("part"))
    columns = ["root", "part", "open_part", "side", "cls", "n", "grams"]
    one = F.lit(0).cast("long").alias("open_part")

    def against(asked: DataFrame, data: DataFrame) -> DataFrame:
        met = data.withColumn("side", F.lit(0)).select(columns).unionByName(asked.withColumn("side", F.lit(1)).select(columns))
        return met.groupBy("root", "part", "open_part").applyInPandas(_multiply(percent, ["root", "part", "open_part"]), LINK)

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    first = materialize(against(hub.select("*", every.alias("part"), one), dealt.select("*", one)))
    linked = first.select(F.col("u").alias("cls")).union(first.select("v")).distinct()
    rest = dealt.join(linked, "cls", "left_anti")
    wide = rest.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most_rows), F.ceil(F.sum(F.size("grams")) / most_tokens)).cast("long").alias("opens"))
    rest = materialize(rest.join(wide, "root").withColumn("open_part", F.pmod(F.xxhash64(F.lit(1), "cls"), "opens")))
    asked = rest.drop("part").select("*", every.alias("part"))
    data = dealt.join(wide, "root").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("opens") - 1)).alias("open_part"))
    return first.unionByName(materialize(against(asked, data)))


def ngram_join(docs: DataFrame, text: str = "text", key: str = "doc_id", ngram: int = NGRAM, percent: int = PERCENT,
               most_rows: int = ROWS, most_tokens: int = TOKENS) -> DataFrame:
    """Per row of `docs`: key (an integer), n_shingles and component_id (smallest key reachable by links)."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    measured = materialize(rows.mapInArrow(_measure(ngram), "_key long, n long, cls long"))
    classes = materialize(measured.where(F.col("_key").isNotNull() & F.col("cls").isNotNull())
                          .groupBy("cls").agg(F.min("_key").alias("rep"), F.first("n").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = int(-(-total // SIEVE)) or 1
    keyed = rows.where(F.col("_key").isNotNull())
    packed = keyed.select("_text").mapInArrow(_send(ngram, buckets), PACKED)
    replies = packed.groupBy("bucket").applyInPandas(_reply(buckets), "dest long, ids binary, counts binary")
    shared = replies.groupBy("dest").applyInPandas(_total, "cls long, shared long")
    able = materialize(shared.join(classes, "cls").where(100 * F.col("shared") >= percent * F.col("n")).select("cls", "rep", "n"))

    texts = keyed.where(may_hold(able, "rep")(F.col("_key"))).join(able, F.col("_key") == F.col("rep")).select("cls", "_text")
    sets = materialize(texts.mapInArrow(_wanted(ngram), "cls long, set array<long>").dropDuplicates(["cls"]))
    posts = sets.select("cls", F.explode("set").alias("gram"))
    times = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    own = posts.join(times, "gram").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("posts"))
    matrix = own.join(able.select("cls", "n"), "cls").where(100 * F.size("posts") >= percent * F.col("n"))
    matrix = materialize(matrix.select("cls", "n", F.col("posts.gram").alias("grams"),
                                       (F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["times"]) / F.size("posts")).alias("weight")))

    prefix = F.size("grams") - F.floor((percent * F.col("n") + 99) / 100).cast("int") + 1  # less what no other class has
    rare = matrix.select("cls", F.explode(F.slice("grams", F.lit(1), prefix)).alias("gram"))
    heads = rare.groupBy("gram").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    ties = rare.join(heads, "gram").where("cls <> head").select(F.col("cls").alias("u"), F.col("head").alias("v")).distinct()
    tied = components(ties)
    placed = matrix.join(tied.withColumnRenamed("node", "cls"), "cls")
    size = placed.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("grams")).alias("tokens"))
    placed = materialize(placed.join(size, "root"))
    large = (F.col("members") > most_rows) | (F.col("tokens") > most_tokens)
    bulk = placed.where(~large).agg(F.sum(F.size("grams"))).first()[0] or 0
    small = placed.where(~large).withColumns({"side": F.lit(0), "task": F.pmod(F.xxhash64("root"), F.lit(max(1, -(-4 * bulk // most_tokens))))})
    links = materialize(small.groupBy("task").applyInPandas(_multiply(percent, ["root"]), LINK))
    if not placed.where(large).isEmpty():
        links = links.unionByName(_large_links(placed.where(large), percent, most_rows, most_tokens))

    joined = components(links).join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    of = joined.join(least, "root").select(F.col("node").alias("cls"), "least").unionByName(
        classes.join(joined.select(F.col("node").alias("cls")), "cls", "left_anti").select("cls", F.col("rep").alias("least")))
    return (measured.withColumn("cls", F.when(F.col("_key").isNotNull(), F.col("cls"))).join(of, "cls", "left")
            .select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "_key").alias("component_id")))
