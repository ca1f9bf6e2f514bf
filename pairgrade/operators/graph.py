"""Typed knowledge graph over entities and their attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from pairgrade.functions.ordering import add_rank, range_bucket
from pairgrade.operators.ingest import NO_ACTION
from pairgrade.operators.scoring import vec_sum

# Node order, relation numbers, offsets.
KINDS = ["entity", "enzyme", "transporter", "target"]
RELATIONS = {"enzyme": {"substrate": 0, "inhibitor": 1, "inducer": 2},
             "transporter": {"substrate": 3, "inhibitor": 4, "inducer": 5},
             "target": {"agonist": 6, "antagonist": 7, "inhibitor": 8}}
OTHER = {"enzyme": 9, "transporter": 10, "target": 11}
PAIR_REL_OFFSET = 12
N_FORWARD = 17


def _kind_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)])


def kg_nodes(entities: DataFrame, attrs: DataFrame) -> DataFrame:
    """Contiguous node ids: kinds in order, names sorted within a kind.

    Ranks are taken per range of names and shifted by counts, so no kind and
    no family of names is sorted in one task, and the offset table has at most
    as many rows as there are ranges; kind offsets come from the kind sizes.
    """
    names = (entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("name"))
             .unionByName(attrs.select("kind", "name")).where("name is not null").distinct())
    r = add_rank(names, ["kind"], ["name"], range_bucket(names, "name"), "__rn")
    sizes = names.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(_kind_rank(F.col("kind"))).rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select("kind", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__off"))  # four rows
    return r.join(F.broadcast(off), "kind").select(
        (F.col("__rn") - 1 + F.col("__off")).alias("id"), "kind", "name")


def relation(kind: Column, action: Column) -> Column:
    known = [F.when((kind == k) & (action == a), F.lit(r)) for k, m in RELATIONS.items() for a, r in m.items()]
    return F.coalesce(*known, *[F.when(kind == k, F.lit(r)) for k, r in OTHER.items()]).cast("bigint")


def kg_edges(attr_actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """entity -> attribute edges; every action is an edge of its own, so two
    unmapped actions of one name give two parallel 'other' edges."""
    acts = F.when(F.size("actions") == 0, F.array(F.lit(NO_ACTION))).otherwise(F.col("actions"))
    x = attr_actions.select("entity_id", "kind", "name", F.explode(acts).alias("action"))
    src = nodes.where("kind = 'entity'").select(F.col("name").alias("entity_id"), F.col("id").alias("src"))
    dst = nodes.where("kind <> 'entity'").select("kind", "name", F.col("id").alias("dst"))
    return (x.join(dst, ["kind", "name"]).join(src, "entity_id")
            .select("src", "dst", relation(F.col("kind"), F.col("action")).alias("rel")))


def id_index_join(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add node indexes of both ends; ``valid`` is false when one is unknown."""
    e = nodes.where("kind = 'entity'")
    out = pairs
    for side in ("a", "b"):
        out = out.join(e.select(F.col("name").alias(side), F.col("id").alias(f"i{side}")), side, "left")
    return out.withColumn("valid", F.col("ia").isNotNull() & F.col("ib").isNotNull())


def kg_train_graph(bio_edges: DataFrame | None, train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Attribute edges, training pairs as relation 12 + tier, reverse copies.

    Held-out pairs are removed from the training pairs by an anti join, so no
    test or validation edge can leak in.
    """
    safe = train.join(held_out.select("a", "b"), ["a", "b"], "left_anti")
    pair_edges = safe.select(F.col("ia").alias("src"), F.col("ib").alias("dst"),
                             (F.col("y") + PAIR_REL_OFFSET).cast("bigint").alias("rel"))
    fwd = pair_edges if bio_edges is None else bio_edges.unionByName(pair_edges)
    # One pass: each edge row yields its forward and its reverse copy.
    both = F.array(F.struct("src", "dst", "rel"),
                   F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("rel") + N_FORWARD).alias("rel")))
    return fwd.select(F.explode(both).alias("e")).select("e.*")


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def relational_mean(edges: DataFrame, vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """One hop: per node and relation the mean neighbour vector and degree.

    ``Summarizer.mean`` merges map-side, so a hub node is one partial vector
    per task instead of one row per edge in the shuffle.
    """
    v = vectors.select(F.col(id_col).alias("src"), array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("__v"))
    g = edges.join(v, "src").groupBy("dst", "rel").agg(
        F.count(F.lit(1)).alias("degree"), Summarizer.mean(F.col("__v")).alias("__m"))
    return g.select("dst", "rel", "degree", vector_to_array("__m").alias("mean"))


def embedding_norm(emb: DataFrame, id_col: str, vec: str, dim: int, mode: str = "PN-SI", scale: float = 1.0) -> DataFrame:
    """Centre the columns, then scale rows to unit norm (PN-SI), by the root
    mean square row norm (PN), or by that times sqrt(n) (PN-SCS)."""
    x = emb.select(id_col, F.transform(vec, lambda v: v.cast("double")).alias("__x"))
    mu = x.agg(F.array(*[F.avg(F.get("__x", i)) for i in range(dim)])).scalar()
    c = x.withColumn("__m", mu)
    c = c.select(id_col, F.zip_with("__x", "__m", lambda a, b: a - b).alias("__c"))
    sq = vec_sum(F.transform("__c", lambda v: v * v))
    if mode == "PN-SI":
        c = c.withColumn("__s", F.greatest(F.sqrt(sq), F.lit(1e-6)))
    else:
        n = F.sqrt(F.count(F.lit(1))) if mode == "PN-SCS" else F.lit(1.0)
        s = c.agg(F.greatest(F.sqrt(F.avg(sq)), F.lit(1e-6)) * n).scalar()
        c = c.withColumn("__s", s)
    return c.select(id_col, F.transform("__c", lambda v: F.lit(scale) * v / F.col("__s")).alias("normed"))


def edge_weight_topk(weighted: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """Mean edge weight per attribute node, labelled 'Kind: name', top k."""
    bio = nodes.where("kind <> 'entity'").select("id", F.concat_ws(": ", F.initcap("kind"), "name").alias("label"))
    g = (weighted.join(bio, weighted["dst"] == bio["id"]).groupBy("label")
         .agg(F.avg("weight").alias("mean_weight"), F.count(F.lit(1)).alias("n_edges")))
    return g.orderBy(F.col("mean_weight").desc(), "label").limit(k)


def importance_topk(contributions: DataFrame, k: int = 20) -> DataFrame:
    """Mean |contribution| per feature over rows and classes, top k."""
    g = contributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return g.orderBy(F.col("mean_abs").desc(), "feature").limit(k)


def waterfall(contributions: DataFrame, row: str, base: float = 0.0, k: int = 18) -> DataFrame:
    """Per row: its k largest contributions, the rest as 'other', and the
    running total.  A row has as many contributions as there are features."""
    w = Window.partitionBy(row).orderBy(F.abs("value").desc(), "feature")
    r = contributions.withColumn("__rn", F.row_number().over(w))
    label = F.when(F.col("__rn") <= k, F.col("feature").cast("string")).otherwise("other")
    g = r.groupBy(row, F.least("__rn", F.lit(k + 1)).alias("step"), label.alias("label")).agg(F.sum("value").alias("value"))
    run = Window.partitionBy(row).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("total", F.sum("value").over(run) + F.lit(base)).withColumn("step", F.col("step").cast("bigint"))


FP_BITS, N_BIO, EMB = 2048, 24, 1024


def feature_dictionary(spark, n_features: int, bio_names: Sequence[str] | None = None) -> DataFrame:
    """Feature number -> name for the pair layout (4120) or the fused one (8216)."""
    i = F.col("id")
    s = lambda prefix, start: F.concat(F.lit(prefix), (i - start).cast("string"))
    names = list(bio_names or [f"bio_{j:02d}" for j in range(N_BIO)])
    bio0, emb0 = 2 * FP_BITS, 2 * FP_BITS + N_BIO
    name = (F.when(i < FP_BITS, s("fp_prod_", 0)).when(i < bio0, s("fp_diff_", FP_BITS))
            .when(i < emb0, F.get(F.array(*[F.lit(n) for n in names]), (i - bio0).cast("int"))))
    fused = n_features >= emb0 + 4 * EMB
    if fused:
        for j, p in enumerate(("ha", "hb", "diff", "prod")):
            start = emb0 + j * EMB
            name = name.when(i < start + EMB, s(f"gnn_{p}_", start))
    name = name.otherwise(s("extra_", emb0 + 4 * EMB if fused else emb0))
    if n_features < emb0:
        name = s("f_", 0)
    return spark.range(n_features).select(i.alias("feature"), name.alias("name"))
