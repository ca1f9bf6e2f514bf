"""Pair features: set algebra over attributes and fingerprints.

Per-entity sets are built once (one row per entity) and joined to pairs, with
a number for each name, since the sets of an end travel with each of its pairs;
all set algebra is array expressions inside whole-stage codegen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pairgrade.functions.hashing import hex_to_long, keyed_md5
from pairgrade.functions.ordering import add_rank, hash_bucket
from pairgrade.operators.splits import membership_flags
from pairgrade.session import materialize

# Families of attribute names.
CYP_PREFIX = "Cytochrome P450"
PGP_NAMES = ["P-glycoprotein 1", "Multidrug resistance protein 1", "P-glycoprotein", "MDR1"]
OATP1B1_NAMES = ["Solute carrier organic anion transporter family member 1B1", "OATP1B1"]

FP_BITS = 2048


# ---------------------------------------------------------------- entity side

def action_names(attrs: Column, action: str) -> Column:
    """Names carrying ``action`` in a decoded array<struct<name, actions>>."""
    return F.array_distinct(F.transform(
        F.filter(attrs, lambda a: F.array_contains(a["actions"], action)), lambda a: a["name"]))


def family(names: Column, prefix: str) -> Column:
    return F.filter(names, lambda n: n.startswith(prefix))


def in_family(names: Column, members: list[str]) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(m) for m in members]))


_ACTIONS = {"enzyme": ("substrate", "inhibitor", "inducer"),
            "transporter": ("substrate", "inhibitor", "inducer"),
            "target": ("agonist", "antagonist", "inhibitor")}
_SETS = {"cyp": _ACTIONS["enzyme"], "transporter": _ACTIONS["transporter"], "target": _ACTIONS["target"]}


def entity_sets(attrs: DataFrame) -> DataFrame:
    """One row per entity with a name set per (kind, action) and per kind.

    Columns are ``<kind>_<action>`` and ``<kind>_all``.  Sets hold distinct
    names, so their size is bounded by the attribute vocabulary whatever the
    number of rows of an entity; repeats are merged before the shuffle.
    """
    aggs = []
    for kind, actions in _ACTIONS.items():
        is_kind = F.col("kind") == kind
        for act in actions:
            aggs.append(F.collect_set(F.when(is_kind & (F.col("action") == act), F.col("name")))
                        .alias(f"{kind}_{act}"))
        aggs.append(F.collect_set(F.when(is_kind, F.col("name"))).alias(f"{kind}_all"))
    return attrs.groupBy("entity_id").agg(*aggs)


def numbered(entities: DataFrame) -> DataFrame:
    """``entities`` (a row per entity) with an integer for each name in their array columns, the same for equal names.

    Names are ranked by hash, so that no task sees them all; sets stay sets."""
    held = materialize(entities)
    sets = [f.name for f in held.schema if isinstance(f.dataType, T.ArrayType)]
    members = lambda i, c: F.transform(c, lambda n: F.struct(F.lit(i).alias("which"), n.alias("name")))
    every = F.flatten(F.array(*[members(i, c) for i, c in enumerate(sets)]))
    rows = held.select("entity_id", F.explode_outer(every).alias("r")).select("entity_id", "r.*")
    names = held.select(F.explode(F.array_distinct(F.concat(*sets))).alias("name")).distinct().withColumn("__h", keyed_md5("name", F.col("name")))
    codes = materialize(add_rank(names, [], ["__h", "name"], hash_bucket("__h"), "code").select("name", F.col("code").cast("int")))
    coded = rows.join(codes, "name", "left").groupBy("entity_id").agg(*[F.collect_list(F.when(F.col("which") == i, F.col("code"))).alias(c) for i, c in enumerate(sets)])
    rest = [c for c in held.columns if c not in sets and c != "entity_id"]
    return held.select("entity_id", *rest).join(coded, "entity_id").select(*held.columns)


def fingerprints(bits: DataFrame) -> DataFrame:
    """Sorted on-bit array per entity (never longer than the bit width)."""
    return bits.groupBy("entity_id").agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def hashed_fingerprint(df: DataFrame, tokens: Column, n_bits: int = FP_BITS) -> DataFrame:
    """On-bits of hashed tokens: the first 8 hex digits of md5 modulo width."""
    bits = F.transform(F.array_distinct(tokens),
                       lambda t: hex_to_long(F.substring(F.md5(t), 1, 8)) % n_bits)
    return df.withColumn("bits", F.array_sort(F.array_distinct(bits)))


# ------------------------------------------------------------------ pair side

def pair_lookup(pairs: DataFrame, entities: DataFrame, suffixes=("_a", "_b")) -> DataFrame:
    """Attach both endpoints' columns; a pair with a missing end is dropped.

    Plain equi joins on unique entity keys.  Spark broadcasts the entity side
    by its measured size; otherwise AQE splits the skewed partitions of an
    entity that occurs in a large share of the pairs.
    """
    out = pairs
    for side, sfx in zip(("a", "b"), suffixes):
        e = entities.select(F.col("entity_id").alias(side),
                            *[F.col(c).alias(c + sfx) for c in entities.columns if c != "entity_id"])
        out = out.join(e, side)
    return out


def pair_skipped(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs for which at least one end is unknown."""
    ids = entities.select("entity_id").distinct()
    return membership_flags(pairs, ids).where(~(F.col("in_a") & F.col("in_b"))).select(*pairs.columns)


def tanimoto(x: Column, y: Column) -> Column:
    inter = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def fp_and(x: Column, y: Column) -> Column:
    return F.array_sort(F.array_intersect(x, y))


def fp_xor(x: Column, y: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(x, y), F.array_except(y, x)))


def _jaccard(x: Column, y: Column) -> Column:
    inter = F.size(F.array_intersect(x, y))
    return inter / F.greatest(F.size(x) + F.size(y) - inter, F.lit(1))


def _flag(cond: Column) -> Column:
    return cond.cast("double")


def _crossed(pa: Column, pb: Column, qa: Column, qb: Column) -> Column:
    """A name that one side has in role p and the other side in role q."""
    return F.arrays_overlap(pa, qb) | F.arrays_overlap(pb, qa)


def bio_sets(sets: DataFrame) -> DataFrame:
    """What the 24 features need of an entity: the enzyme family is filtered
    and fixed-name families are tested once per entity, not once per pair.

    ``<kind>_rest`` holds the names of a kind without an action of its own set, so that no name travels twice; all names
    of a kind are its actions' and these; of targets ``target_n``."""
    cols = []
    for short, kind in (("cyp", "enzyme"), ("transporter", "transporter"), ("target", "target")):
        names = {w: F.col(f"{kind}_{w}") if short == kind else family(F.col(f"{kind}_{w}"), CYP_PREFIX) for w in (*_ACTIONS[kind], "all")}
        cols += [names[w].alias(f"{short}_{w}") for w in _ACTIONS[kind]]
        cols += [F.array_except(names["all"], F.concat(*[names[w] for w in _ACTIONS[kind]])).alias(f"{short}_rest")]
    cols.append(F.size("target_all").alias("target_n"))
    cols += [in_family(F.col(f"transporter_{w}"), PGP_NAMES).alias(f"pgp_{w}") for w in ("substrate", "inhibitor", "all")]
    cols.append(in_family(F.col("transporter_all"), OATP1B1_NAMES).alias("oatp_all"))
    return sets.select("entity_id", *cols)


def bio_entities(sets: DataFrame) -> DataFrame:
    """One row per entity with what ``bio_columns`` reads, names as numbers."""
    return numbered(bio_sets(sets)).hint("shuffle_hash")  # unique: pairs are not sorted for the join


def bio_pair_features(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """24 symmetric features ``f00`` .. ``f23``: enzymes, transporters, targets."""
    return pair_lookup(pairs, bio_entities(sets)).select(*pairs.columns, *bio_columns())


def bio_columns() -> list[Column]:
    """The features of a pair whose ends' ``bio_entities`` columns are attached."""
    def two(kind, what):
        if what == "all" and kind in _SETS:  # may repeat a name
            return tuple(F.concat(*[F.col(f"{kind}_{w}_{side}") for w in (*_SETS[kind], "rest")]) for side in "ab")
        return F.col(f"{kind}_{what}_a"), F.col(f"{kind}_{what}_b")

    def block(kind):
        sub, inh, ind, everything = (two(kind, w) for w in ("substrate", "inhibitor", "inducer", "all"))
        return sub, inh, ind, everything, _crossed(*sub, *inh), _crossed(*sub, *ind)

    sub, inh, ind, all_, si, sd = block("cyp")
    f = [_jaccard(*sub), _flag(F.arrays_overlap(*sub)), _flag(si), _flag(sd), _jaccard(*inh), _jaccard(*ind),
         F.size(F.array_intersect(*all_)).cast("double"), _flag(si | sd | F.arrays_overlap(*sub))]

    sub, inh, ind, all_, si, sd = block("transporter")
    pgp_sub, pgp_inh, pgp_all = (two("pgp", w) for w in ("substrate", "inhibitor", "all"))
    oatp = two("oatp", "all")
    f += [_jaccard(*sub), _flag(F.arrays_overlap(*sub)), _flag(si), _flag(sd),
          _flag(pgp_all[0] & pgp_all[1]), _flag((pgp_sub[0] & pgp_inh[1]) | (pgp_sub[1] & pgp_inh[0])),
          _flag(oatp[0] & oatp[1]), F.size(F.array_intersect(*all_)).cast("double")]

    ago, ant, inh, all_ = (two("target", w) for w in ("agonist", "antagonist", "inhibitor", "all"))
    both = F.size(F.array_intersect(*all_))
    f += [both / F.greatest(F.col("target_n_a") + F.col("target_n_b") - both, F.lit(1)), _flag(F.arrays_overlap(*all_)), _jaccard(*ago), _jaccard(*ant), _jaccard(*inh),
          _flag(_crossed(*ago, *ant)), _flag(_crossed(*ago, *inh)),
          both.cast("double")]
    return [c.alias(f"f{i:02d}") for i, c in enumerate(f)]


N_BIO = 24


def attr_disjoint(df: DataFrame, sets: DataFrame) -> DataFrame:
    """Keep pairs that share no enzyme name and no target name."""
    e = sets.select("entity_id", "enzyme_all", "target_all")
    cols = df.columns
    out = df
    for side in ("a", "b"):
        out = out.join(e.select(F.col("entity_id").alias(side), F.col("enzyme_all").alias(f"__e{side}"),
                                F.col("target_all").alias(f"__t{side}")), side, "left")
    shares = (F.coalesce(F.arrays_overlap("__ea", "__eb"), F.lit(False))
              | F.coalesce(F.arrays_overlap("__ta", "__tb"), F.lit(False)))
    return out.where(~shares).select(*cols)


# ------------------------------------------------- all entities x reference set

def _pack(fp: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of at most ``block_rows`` entities: block, ids, and their bits one after the other with the sizes."""
    h = fp.withColumn("__h", keyed_md5("block", F.col("entity_id")))
    ranked = add_rank(h, [], ["__h", "entity_id"], hash_bucket("__h"), "__rn")
    rows = (ranked.groupBy(F.floor((F.col("__rn") - 1) / block_rows).alias("block"))
            .agg(F.collect_list(F.struct("entity_id", "bits")).alias("rows")))  # <= block_rows
    return rows.select("block", F.col("rows.entity_id").alias("ids"), F.transform("rows", lambda r: F.size(r["bits"])).alias("sizes"),
                       F.flatten("rows.bits").cast("array<smallint>").alias("bits"))


def _dense(block: pd.DataFrame) -> np.ndarray:
    sizes = np.asarray(block["sizes"].iloc[0], np.int64)
    m = np.zeros((len(sizes), FP_BITS), dtype=np.float32)
    m[np.repeat(np.arange(len(sizes)), sizes), np.asarray(block["bits"].iloc[0], np.int64)] = 1.0
    return m


def _tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Similarities of a block of entities and a block of the reference, as one row."""
    a, b = _dense(left), _dense(right)
    inter = a @ b.T
    union = np.maximum(a.sum(1)[:, None] + b.sum(1)[None, :] - inter, 1e-8)
    sims = inter.astype(np.float64) / union.astype(np.float64)
    return pd.DataFrame({"block": right["block"], "ids": left["ids"], "ref_ids": right["ids"], "m": [list(sims)]})


def similarity_cross(fp: DataFrame, reference: DataFrame, block_rows: int = 256) -> DataFrame:
    """Tanimoto of every entity to every reference entity.

    The result is the full matrix by definition, so its size is n x m.  It is
    cut into tiles of four times ``block_rows`` by ``block_rows``: a task holds
    one at a time, whatever the number of tiles that it makes; nothing is
    broadcast and no pair rows are shuffled.
    Output: one row per (entity, reference block) with aligned arrays.
    """
    left, right = _pack(fp, 4 * block_rows), _pack(reference, block_rows)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), of.agg(F.max("block")).scalar()))
    sides = (left.withColumnRenamed("block", "lb").withColumn("block", every(right)), right.withColumn("lb", every(left)))
    a, b = (x.groupBy("lb", "block") for x in sides)
    tiles = a.cogroup(b).applyInPandas(_tile, "block long, ids array<string>, ref_ids array<string>, m array<array<double>>")
    one = tiles.select("block", "ref_ids", F.explode(F.arrays_zip("ids", "m")).alias("z"))
    return one.select(F.col("z.ids").alias("entity_id"), "block", "ref_ids", F.col("z.m").alias("sims"))


def _bit_times(fp: DataFrame, reference: DataFrame) -> Column:
    """How often each bit position is on in both tables, by position."""
    counts = fp.select("bits").unionAll(reference.select("bits")).select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("times"))
    # One number for each bit position: bounded by the width of the fingerprint.
    return materialize(counts.agg(F.map_from_entries(F.collect_list(F.struct(F.col("bit").cast("int").alias("b"), "times"))).alias("m"))
                        .select(F.transform(F.sequence(F.lit(0), F.lit(FP_BITS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("times"))).scalar()


def _rare_blocks(sets: DataFrame, order: str, digits: Column, times: Column, num: int, den: int, block_rows: int) -> DataFrame:
    """``sets`` that have bits, with n, rare (the rarest bits of the set, one of which any set that is similar enough
    shares) and block: about ``block_rows`` rows by the rarest bit, then by ``digits`` (hex) and ``order``."""
    cut = lambda n: (n - F.floor((num * n + den - 1) / den) + 1).cast("int")
    by_rarity = F.transform(F.array_sort(F.transform("bits", lambda b: F.struct(F.coalesce(F.get("__times", b.cast("int")), F.lit(0)).alias("t"), b.alias("b")))), lambda x: x["b"])
    sets = sets.where(F.size("bits") > 0).withColumn("n", F.size("bits").cast("bigint")).withColumn("__times", times)
    sets = sets.withColumn("rare", F.slice(by_rarity, F.lit(1), cut(F.col("n")))).drop("__times").withColumn("first", F.get("rare", F.lit(0)))
    bucket = F.concat(F.lpad(F.lower(F.hex("first")), 3, "0"), F.coalesce(F.substring(digits, 1, 2), F.lit("")))
    ranked = add_rank(sets, [], ["first", order], bucket, "__rn")
    return materialize(ranked.withColumn("block", F.floor((F.col("__rn") - 1) / block_rows)).drop("__rn", "first"))


def _met_blocks(left: DataFrame, right: DataFrame, num: int, den: int):
    """Pairs of blocks whose rarest bits have one in common and whose sizes allow a match, as two groupings to cogroup:
    the rows of each side, once for each pair of blocks."""
    # A row for each block and bit, at most ``FP_BITS`` a block.
    seen = lambda x, s: (x.select("block", "n", F.explode("rare").alias("bit")).groupBy("block", "bit")
                         .agg(F.min("n").alias(f"low_{s}"), F.max("n").alias(f"high_{s}")).withColumnRenamed("block", f"block_{s}"))
    fits = (den * F.col("high_l") >= num * F.col("low_r")) & (den * F.col("high_r") >= num * F.col("low_l"))
    met = materialize(seen(left, "l").join(seen(right, "r"), "bit").where(fits).select("block_l", "block_r").distinct())

    def sent(x: DataFrame, s: str):
        pairs = met.select(F.col(f"block_{s}").alias("block"), F.col("block_l").alias("lb"), F.col("block_r").alias("rb"))
        return pairs.join(x.drop("rare").withColumn("bits", F.col("bits").cast("array<smallint>")), "block").groupBy("lb", "rb")

    return sent(left, "l"), sent(right, "r")


def _shared(left: pd.DataFrame, right: pd.DataFrame, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of bits that each set of a block shares with each of another, and whether that makes them similar."""
    n = [x["n"].to_numpy(np.int64) for x in (left, right)]
    bits = [np.concatenate(x["bits"].to_numpy()).astype(np.int64) for x in (left, right)]
    used = np.intersect1d(*bits)
    sides = []
    for b, k in zip(bits, n):
        at = np.searchsorted(used, b)
        hit = np.append(used, -1)[at] == b
        m = np.zeros((len(k), len(used)), np.float32)  # never wider than ``FP_BITS``
        m[np.repeat(np.arange(len(k)), k)[hit], at[hit]] = 1
        sides.append(m)
    shared = (sides[0] @ sides[1].T).astype(np.int64)  # whole numbers up to ``FP_BITS``: exact
    return shared, (den + num) * shared >= num * (n[0][:, None] + n[1][None])


def _matches(num: int, den: int):
    """Pandas function over two blocks of entities: for each entity of the left block the similar ones of the right."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"entity_id": [], "ref_ids": [], "shared": [], "sims": []}
        if len(left) and len(right):
            shared, similar = _shared(left, right, num, den)
            n_l, n_r, refs = left["n"].to_numpy(np.int64), right["n"].to_numpy(np.int64), right["ref_id"].to_numpy()
            for i, entity in enumerate(left["entity_id"]):
                at = np.flatnonzero(similar[i])
                if len(at):
                    s = shared[i, at]
                    for c, v in zip(out, (entity, refs[at], s, s / (n_l[i] + n_r[at] - s))):
                        out[c].append(v)
        return pd.DataFrame(out, dtype=object)

    return run


def similarity_join(fp: DataFrame, reference: DataFrame, num: int = 3, den: int = 10, block_rows: int = 1024) -> DataFrame:
    """(entity_id, ref_id, shared, sim): pairs of an entity and a reference entity whose Tanimoto similarity is at
    least num / den, exactly; sets without bits are similar to nothing.

    Entities lie in blocks of about ``block_rows`` by the rarest bit of their set; two blocks meet where the rarest bits
    of their sets (of which similar sets share one) have one in common and their sizes allow a match.  A task multiplies
    the bits of one pair of blocks at a time and gives its matches, so that memory is a tile's, no bit is held by one
    task and no match is shuffled.  The result has the matches: up to the product where most entities are similar.
    """
    times = _bit_times(fp, reference)
    digits = F.md5(F.col("entity_id").cast("string"))
    left, right = (_rare_blocks(x.select("entity_id", "bits"), "entity_id", digits, times, num, den, block_rows) for x in (fp, reference))
    a, b = _met_blocks(left, right.withColumnRenamed("entity_id", "ref_id"), num, den)
    e, r = (x.schema["entity_id"].dataType.simpleString() for x in (fp, reference))
    found = a.cogroup(b).applyInPandas(_matches(num, den), f"entity_id {e}, ref_ids array<{r}>, shared array<long>, sims array<double>")
    one = found.select("entity_id", F.explode(F.arrays_zip("ref_ids", "shared", "sims")).alias("z"))
    return one.select("entity_id", F.col("z.ref_ids").alias("ref_id"), F.col("z.shared").alias("shared"), F.col("z.sims").alias("sim"))


def _links(num: int, den: int):
    """Pandas function over two blocks of classes: how many reference entities each class of the left block is similar to."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"set_id": [], "n_links": []})
        links = _shared(left, right, num, den)[1] @ right["members"].to_numpy(np.int64)
        return pd.DataFrame({"set_id": left["set_id"], "n_links": links})[links > 0]

    return run


def similarity_links(fp: DataFrame, reference: DataFrame, num: int = 3, den: int = 10, block_rows: int = 1024) -> DataFrame:
    """(entity_id, class_id, n_links): for each entity the smallest entity with an equal set, and the number of reference
    entities whose Tanimoto similarity is at least num / den, exactly: ``similarity_join`` counted, in linear size.

    Equal sets are one class and are compared once.  Classes lie in blocks of about ``block_rows`` by the rarest bit of
    their set; two blocks meet where the rarest bits of their sets (of which similar sets share one) have one in common
    and their sizes allow a match.  A task multiplies the two blocks' bits; no pair of entities is a row anywhere.  What
    is left of the square of the classes is in these products; memory is a block's.  Sets without bits are similar to
    nothing.
    """
    held = materialize(fp.select("entity_id", F.array_sort("bits").alias("bits")).withColumn("set_id", F.md5(F.array_join("bits", ","))))
    owners = held.groupBy("set_id").agg(F.min("entity_id").alias("class_id"))
    times = _bit_times(fp, reference)

    def blocks(rows: DataFrame) -> DataFrame:
        """set_id, bits, n, members, rare and block of each distinct set."""
        sets = rows.where(F.size("bits") > 0).groupBy("set_id").agg(F.first("bits").alias("bits"), F.count(F.lit(1)).alias("members"))
        return _rare_blocks(sets, "set_id", F.col("set_id"), times, num, den, block_rows)

    left = blocks(held)
    right = blocks(reference.select(F.array_sort("bits").alias("bits")).withColumn("set_id", F.md5(F.array_join("bits", ","))))
    a, b = _met_blocks(left, right, num, den)
    links = a.cogroup(b).applyInPandas(_links(num, den), "set_id string, n_links long").groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    return (held.select("entity_id", "set_id").join(owners, "set_id").join(links, "set_id", "left")
            .select("entity_id", "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")))
