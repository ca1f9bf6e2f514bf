"""Registered queries: sources and sinks, fused features, models."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from pairgrade.operators import features as X, ingest as I, metrics as M, models as Md, negatives as N, pairs as P, scoring as C, splits as S
from pairgrade.operators.profile import ProfilePCA
from pairgrade.plans.q_graph import REL, _list
from pairgrade.plans.q_ingest import _E
from pairgrade.plans.registry import query
from pairgrade.session import materialize, work_dir
from pairgrade.sources import tables as Tb
from pairgrade.sources.xml_entities import scan_entities


XML_RECORDS = 50_000  # records of a file


def fresh(src) -> str:
    return f"{work_dir(src.spark)}/pairgrade/{uuid.uuid4().hex}"


# ------------------------------------------------------------ sources, sinks

def _write_xml(src) -> str:
    """The part table as entity XML: every third record holds a nested
    element of the same tag, every seventh has no primary id."""
    path = fresh(src)
    xml = f"""concat('<drug type="', case when p_type in ('ECONOMY', 'STANDARD') then 'biotech' else 'small molecule' end, '">',
      '<drugbank-id', case when p_partkey % 7 = 0 then '' else ' primary="true"' end, '>', {_E}, '</drugbank-id><drugbank-id>ALT', cast(p_partkey as string), '</drugbank-id>',
      '<name>', p_name, '</name><synonyms><synonym language="english">', p_brand, '</synonym><synonym>', p_type, '</synonym></synonyms>',
      '<atc-codes><atc-code code="', p_brand, '.1"><level>x</level></atc-code><atc-code code="', p_brand, '.2"/></atc-codes>',
      case when p_partkey % 3 = 0 then '<pathways><pathway><drugs><drug><drugbank-id>E9</drugbank-id><name>nested</name></drug></drugs></pathway></pathways>' else '' end,
      '<drug-interactions><drug-interaction><drugbank-id>', concat('E', lpad(cast(p_partkey + 1 as string), 7, '0')), '</drugbank-id><name>n</name><description>may add up</description></drug-interaction></drug-interactions>',
      '<enzymes><enzyme><name>Cytochrome P450 ', cast(p_size as string), '</name><actions><action>Substrate</action><action>inhibitor</action></actions></enzyme></enzymes></drug>')"""
    part = src.table("part")
    dealt = part.repartition(max(1, -(-part.count() // XML_RECORDS)))  # a file is read by one task
    dealt.select(F.expr(xml).alias("value")).mapInPandas(_rooted, "value string").write.text(path)
    return path


def _rooted(batches):
    """Every file gets its own root element and is well formed."""
    yield pd.DataFrame({"value": ["<entities>"]})
    yield from batches
    yield pd.DataFrame({"value": ["</entities>"]})


@query("xml_entity_scan", f"""
select {_E} as entity_id, case when p_type in ('ECONOMY', 'STANDARD') then 'biotech' else 'small molecule' end as kind, p_name as name,
  p_brand || ',' || p_type as synonyms, p_brand || '.1|' || p_brand || '.2' as codes,
  concat('E', lpad(cast(p_partkey + 1 as string), 7, '0')) as target, 'Cytochrome P450 ' || p_size || ':inhibitor,substrate' as enzymes
from part where p_partkey % 7 <> 0""")
def _(src):
    docs = scan_entities(src.spark, _write_xml(src))
    enc = I.attribute_encode(I.attribute_action_agg(I.attribute_explode(docs))).where("kind = 'enzyme'").select(
        "entity_id", F.col("encoded").alias("enzymes"))
    inter = I.interaction_explode(docs).select(F.col("id1").alias("entity_id"), F.col("id2").alias("target"))
    d = I.code_list_join(docs).select("entity_id", "kind", "name", F.array_join("synonyms", ",").alias("synonyms"),
                                      F.col("code_list").alias("codes"))
    return d.join(inter, "entity_id").join(enc, "entity_id")


@query("csv_pairs_io", "select id1, id2, description from v_pair_events")
def _(src):
    path = fresh(src)
    Tb.write_csv(src.pair_events.select("id1", "id2", "description"), path)
    return Tb.read_csv(src.spark, path, Tb.PAIR_EVENTS)


@query("id_list_scan", "select entity_id from v_held where seed = 42 and held_out")
def _(src):
    path = fresh(src)
    Tb.write_ids(S.held_out_entities(P.entity_universe(src.pairs_table), [42]).where("held_out"), path)
    return Tb.read_ids(src.spark, path)


@query("split_manifest_io", "select fold, sealed_test, count(*) as n from v_sealed group by 1, 2")
def _(src):
    path = fresh(src)
    Tb.write_csv(S.split_manifest(src.sealed), path, "gzip")
    return Tb.read_csv(src.spark, path, Tb.MANIFEST).groupBy("fold", "sealed_test").agg(F.count(F.lit(1)).alias("n"))


@query("feature_matrix_store", """
select count(*) as n, cast(24 as bigint) as width, count(distinct a || '|' || b) as n_keys from v_pairs""")
def _(src):
    path = fresh(src)
    f = X.bio_pair_features(src.pairs.select("a", "b"), src.sets)
    Tb.write_features(f, path, ["a", "b"], Md.BIO)
    back = src.spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).cast("bigint").alias("width"),
                    F.count_distinct("a", "b").alias("n_keys"))


# Fixed-point numbers and days, so that both engines write values alike; the vectors have their own checks.
def _exact(column):
    return f"cast(round({column} * 10000) as bigint)"


_DIGESTS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", _exact("c_acctbal"), "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", _exact("s_acctbal")],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", _exact("p_retailprice")],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", _exact("o_totalprice"), "cast(o_orderdate as date)", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _exact("l_quantity"), _exact("l_extendedprice"), _exact("l_discount"), _exact("l_tax"), "l_returnflag", "l_linestatus", "cast(l_shipdate as date)"],
    "events": ["event_id", "cast(ts as date)", "user_id", "event_type", _exact("value"), "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


def _field(column):
    text = f"cast({column} as string)"
    return f"coalesce(concat(cast(length({text}) as string), ':', {text}), '-')"


@query("content_hash_manifest", " union all ".join(
    f"select '{t}' as name, count(*) as n_rows, cast(sum(cast(cast('0x' || substr(sha256(concat({', '.join(map(_field, cols))})), 1, 15) as bigint) as hugeint)) as string) as digest from {t}"
    for t, cols in _DIGESTS.items()))
def _(src):
    out = None
    for t, cols in _DIGESTS.items():
        d = Tb.table_digest(src.table(t), t, cols)
        out = d if out is None else out.unionByName(d)
    return out


# Every column of every table, the times to the microsecond and the numbers to their last bit.
_COLUMNS = {
    "region": (["r_regionkey"], "r_regionkey r_name"), "nation": (["n_nationkey"], "n_nationkey n_name n_regionkey"),
    "customer": (["c_custkey"], "c_custkey c_name c_nationkey c_acctbal:f c_mktsegment"), "supplier": (["s_suppkey"], "s_suppkey s_name s_nationkey s_acctbal:f"),
    "part": (["p_partkey"], "p_partkey p_name p_brand p_type p_size p_retailprice:f"),
    "orders": (["o_orderkey"], "o_orderkey o_custkey o_orderstatus o_totalprice:f o_orderdate:t o_orderpriority"),
    "lineitem": (["l_orderkey", "l_linenumber"], "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag l_linestatus l_shipdate:t"),
    "events": (["event_id"], "event_id ts:t user_id event_type value:f props"), "documents": (["doc_id"], "doc_id text lang source n_chars"),
    "embeddings": (["vec_id"], "vec_id embedding:a label"), "pages": (["page_id"], "page_id url html"), "benchmark": (["item_id"], "item_id text"),
    "labels": (["doc_id"], "doc_id quality toxic"), "conversations": (["conv_id", "turn"], "conv_id turn role text"),
}


def _sql_float(x):
    out, rest = [f"floor({x})"], f"({x} - floor({x}))"
    for _ in range(3):
        out.append(f"floor({rest} * 2147483648)")
        rest = f"({rest} * 2147483648 - floor({rest} * 2147483648))"
    return " || '.' || ".join(f"cast(cast({o} as bigint) as string)" for o in out)


def _sql_text(column):
    name, _, kind = column.partition(":")
    if kind == "f":
        return _sql_float(f"cast({name} as double)")
    if kind == "t":
        return f"cast(epoch_us({name}) as string)"
    if kind == "a":
        one = _sql_float("cast(x as double)")
        return f"len({name}) || '[' || array_to_string(list_transform({name}, lambda x: length({one}) || ':' || {one}), '')"
    return f"cast({name} as string)"


def _sql_field(column):
    return f"coalesce(length({_sql_text(column)}) || ':' || {_sql_text(column)}, '-')"


def _sql_digests(table, source):
    keys, columns = _COLUMNS[table]
    key = " || ".join(map(_sql_field, keys))
    return [f"""select '{table}' as name, substr(md5({' || '.join(f'cast({k} as string)' for k in keys)}), 1, 1) as part, '{c.partition(":")[0]}' as "column", count(*) as n_rows,
  count(*) filter (where {c.partition(":")[0]} is null) as n_null, cast(sum(cast(cast('0x' || substr(sha256({key} || {_sql_field(c)}), 1, 15) as bigint) as hugeint)) as string) as digest
  from {source} group by 1, 2""" for c in columns.split()]


def _parts(table):
    return F.substring(F.md5(F.concat(*[F.col(k).cast("string") for k in _COLUMNS[table][0]])), 1, 1)


def _digested(src, table, rows=None):
    rows = src.table(table) if rows is None else rows
    return Tb.column_digests(rows, table, _COLUMNS[table][0], _parts(table))


@query("column_digest_manifest", " union all ".join(x for t in _COLUMNS for x in _sql_digests(t, t)))
def _(src):
    out = None
    for t in _COLUMNS:
        d = _digested(src, t)
        out = d if out is None else out.unionByName(d)
    return out


@query("snapshot_diff", """
with e as (select *, substr(md5(cast(event_id as string)), 1, 1) as part from events),
n as (select part, count(*) as old_rows, count(*) filter (where event_id % 991 <> 5) as new_rows, count(*) filter (where event_id % 97 = 0 and event_id % 991 <> 5) as moved,
  count(*) filter (where event_id % 501 = 1 and event_id % 991 <> 5) as later from e group by 1)
select 'events' as name, part, c as "column", case when old_rows <> new_rows then 'rows' else 'values' end as change, old_rows, new_rows
from n cross join (select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) as c)
where old_rows <> new_rows or (c = 'value' and moved > 0) or (c = 'ts' and later > 0)""")
def _(src):
    """Values moved by 2**-40, times by a microsecond, and rows lost; the old snapshot is merged from two halves."""
    events = src.table("events")
    moved = F.when(F.col("event_id") % 97 == 0, F.col("value") + 2.0**-40).otherwise(F.col("value"))
    later = F.when(F.col("event_id") % 501 == 1, F.col("ts") + F.expr("interval 1 microsecond")).otherwise(F.col("ts"))
    new = events.where("event_id % 991 <> 5").withColumns({"value": moved, "ts": later})
    old = Tb.merge_digests(*(_digested(src, "events", events.where(c)) for c in ("event_id % 2 = 0", "event_id % 2 <> 0")))
    return Tb.snapshot_diff(old, _digested(src, "events", new))


@query("file_manifest", """
select substr(md5(cast(doc_id as string)), 1, 2) as folder, cast(sum(length(cast(doc_id as string)) + 1) as bigint) as bytes, sha256(string_agg(cast(doc_id as string) || chr(10), '' order by doc_id)) as sha256
from documents group by 1""")
def _(src):
    """Files of ids, one for each leading pair of hash digits, by their bytes."""
    path = fresh(src)
    ids = src.table("documents").select("doc_id", F.col("doc_id").cast("string").alias("value"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2).alias("folder"))
    ids.repartition("folder").sortWithinPartitions("folder", "doc_id").select("value", "folder").write.partitionBy("folder").text(path)
    found = Tb.file_manifest(src.spark, f"{path}/folder=*/*.txt")
    return found.select(F.regexp_extract("folder", "folder=(.*)", 1).alias("folder"), "bytes", "sha256")


@query("meta_sink", """
select (select count(*) from v_pairs) as n_samples, (select count(*) from v_labelled) as n_before, cast(4120 as bigint) as feature_dim, """ + ", ".join(
    f"(select count(*) from v_pairs where y = {c}) as after_{c}" for c in range(1, 5)))
def _(src):
    path = fresh(src)
    lab = src.labelled.withColumnRenamed("tier", "y")
    Tb.write_report(Tb.class_meta(lab, src.pairs, "y", 4120), path)
    schema = "n_samples bigint, n_before bigint, feature_dim bigint, counts map<string,bigint>"
    back = src.spark.read.schema(schema).json(path)
    return back.select("n_samples", "n_before", "feature_dim", *[F.col("counts")[str(c)].alias(f"after_{c}") for c in range(1, 5)])


# ------------------------------------------------------------------- profiles

def _profile(src):
    """Components on the training entities, and all entities."""
    fp = materialize(src.fps)
    train = src.sealed.where("sealed_test = 0").select("a", "b")
    ref = materialize(fp.join(P.entity_universe(train), "entity_id", "left_semi"))
    return ProfilePCA(ref, 50, iterations=2), fp, ref


@query("ssp_pca")
def _(src):
    """Projection of all entities."""
    pca, fp, _ = _profile(src)
    return pca.transform(fp)


@query("ssp_pca_report", """
with u as (select a as e from v_sealed where sealed_test = 0 union select b from v_sealed where sealed_test = 0), r as (select count(*) as n from v_fp where entity_id in (select e from u))
select cast(unnest(range(1, cast(least(50, n) as bigint) + 1)) as bigint) as component, n as n_reference, true as is_orthonormal, true as has_its_variance, true as is_in_order from r""")
def _(src):
    """What the components must hold: unit length and right angles, projections of the reference entities that are
    centred, uncorrelated, and have the variance that the fit states, the largest first."""
    pca, _, ref = _profile(src)
    k, want = pca.k, pca.explained_variance
    flat = lambda df, c: df.select(F.posexplode(c).alias("i", "x"), "entity_id")

    def products(df, c):
        one, two = flat(df, c), flat(df, c).select(F.col("i").alias("j"), F.col("x").alias("z"), "entity_id")
        return one.join(two, "entity_id").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("s"))  # k x k

    same = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    unit = products(pca.components, "v").groupBy("i").agg(F.every(F.abs(F.col("s") - same) < 1e-6).alias("is_orthonormal"))
    scores = materialize(pca.transform(ref))
    stated = src.spark.createDataFrame([(i, float(v), bool(i == 0 or v <= want[i - 1])) for i, v in enumerate(want)], "i int, variance double, is_in_order boolean")  # a row per component
    spread = products(scores, "pc").join(stated, "i")
    held = F.abs(F.col("s") / (pca.n - 1) - same * F.col("variance")) < 1e-6 * float(want[0])
    spread = spread.groupBy("i", "is_in_order").agg(F.every(held).alias("held"))
    centred = flat(scores, "pc").groupBy("i").agg((F.abs(F.avg("x")) < 1e-6 * float(want[0]) ** 0.5).alias("centred"))
    out = unit.join(spread, "i").join(centred, "i")
    return out.select((F.col("i") + 1).cast("bigint").alias("component"), F.lit(pca.n).cast("bigint").alias("n_reference"), "is_orthonormal",
                      (F.col("held") & F.col("centred")).alias("has_its_variance"), "is_in_order")


# -------------------------------------------------------------- fused features

def _vec_ids(src):
    """The embedding of an entity: the entity number modulo the table."""
    n = src.table("embeddings").agg(F.count(F.lit(1))).scalar()
    return src.entities.select("entity_id", (F.substring("entity_id", 2, 7).cast("bigint") % n).alias("vec"))


@query("fusion_features")
def _(src):
    # What is wide comes last: pairs meet their ends before any vector of theirs is made.
    named = P.pair_caption(src.pairs, src.entities, "entity_id", "name")
    rows = Md.pair_feature_row(X.pair_lookup(named, _vec_ids(src)), src.sets, src.fps)
    ends = rows.withColumnsRenamed({"a": "id_a", "b": "id_b", "vec_a": "a", "vec_b": "b"})
    v = C.pair_vectors(ends, src.table("embeddings"), "vec_id", "embedding").drop("a", "b").withColumnsRenamed({"id_a": "a", "id_b": "b"})
    a = Md.assemble(v.withColumn("ops", C.pair_ops(F.col("h_a"), F.col("h_b"))), pair_ops="ops")
    return a.select("a", "b", "name_a", "name_b", "y", "features")


_S = [f"list_sum(list_transform(range(1, 65), lambda i: h[i] * t[i] * ({_list(REL[c])})[i]))" for c in range(5)]


@query("batch_pair_inference", f"""
with q as (select distinct l_orderkey % 600 as drug_a, (l_partkey * 7 + l_suppkey) % 600 as drug_b from lineitem),
p as (select q.*, least(drug_a, drug_b) as a, greatest(drug_a, drug_b) as b, x.embedding::double[] as h, z.embedding::double[] as t, x.vec_id is not null and z.vec_id is not null as in_index
  from q left join embeddings x on least(drug_a, drug_b) = x.vec_id left join embeddings z on greatest(drug_a, drug_b) = z.vec_id),
s as (select *, {', '.join(f'{e} as s{c}' for c, e in enumerate(_S))} from p),
e as (select *, {', '.join(f'exp(s{c} - greatest(s0, s1, s2, s3, s4)) as e{c}' for c in range(5))} from s)
select drug_a, drug_b, a as drug_a_canon, b as drug_b_canon, in_index,
  case when in_index then (case greatest(s0, s1, s2, s3, s4) when s0 then 0 when s1 then 1 when s2 then 2 when s3 then 3 else 4 end)::bigint end as dm_pred,
  {', '.join(f'round(case when in_index then e{c} / (e0 + e1 + e2 + e3 + e4) end, 5) as dm_p{c}' for c in range(5))} from e""")
def _(src):
    q = src.table("lineitem").selectExpr("l_orderkey % 600 as drug_a", "(l_partkey * 7 + l_suppkey) % 600 as drug_b").distinct()
    s = C.score_pairs(q, src.table("embeddings"), "vec_id", "embedding", {"dm": lambda a, b: C.diagonal_scores(a, b, REL)})
    return s.withColumns({f"dm_p{c}": F.round(f"dm_p{c}", 5) for c in range(5)})


def _training(src, with_fp: bool):
    """Graded pairs plus sampled negatives, with folds and features."""
    pairs, fp, sets = src.pairs_table, materialize(src.fps), materialize(src.sets)
    neg = N.negative_sampling(fp, pairs.select("a", "b"), None, pairs.count() // 10)
    rows = pairs.unionByName(neg.withColumn("y", F.lit(0).cast("bigint")))
    split = S.sealed_and_folds(materialize(rows), "y", ["a", "b"], 42)
    f = Md.pair_feature_row(split, sets, fp) if with_fp else X.bio_pair_features(split, sets)
    return materialize(Md.assemble(f, with_fp=with_fp).select("a", "b", "y", "fold", "features"))


def _tier_rows(src):
    """Graded pairs plus sampled negatives with bits and bio features; fold 1 judges, fold -1 is sealed."""
    pairs, fp, sets = src.pairs_table, materialize(src.fps), materialize(src.sets)
    neg = N.negative_sampling(fp, pairs.select("a", "b"), None, pairs.count() // 10)
    rows = pairs.unionByName(neg.withColumn("y", F.lit(0).cast("bigint")))
    split = S.sealed_and_folds(materialize(rows), "y", ["a", "b"], 42)
    return materialize(Md.tier_rows(split.select("a", "b", "y", "fold"), sets, fp).withColumn("valid", F.col("fold") == 1))


def _boosted(src):
    """Model on all rows that are not sealed, and the sealed rows.  `BOOST_ROUNDS` and the patience are the only
    settings below the published ones: a round is six jobs."""
    d = _tier_rows(src)
    learnt = d.where("fold <> -1")
    model = Md.boosted_classifier(learnt, valid="valid", rounds=BOOST_ROUNDS, patience=10, depth=6, rate=0.05)
    return model, learnt, d.where("fold = -1")


BOOST_ROUNDS = 12


@query("tree_tier_classifier")
def _(src):
    model, _, sealed = _boosted(src)
    return Md.predict_tiers(model, sealed, ["a", "b"])


_REPORT = """
select y as y_true, count(*) as n, count(*) as n_with_both_ends, count(*) as n_probabilities_sum_to_one, count(*) as n_predicted_is_largest, true as loss_as_reported
from v_tier_sealed where fold = -1 group by y"""


def _tier_report(predicted, judged, loss: float):
    """The sealed rows of each tier, and how many of them hold what every prediction must hold; and whether the loss on
    the rows that judged (a, b, y_true, p, weight) is the one that the fit reports for the rounds it kept."""
    got = judged.agg(F.sum(-F.col("weight") * F.log(F.greatest(F.get("p", F.col("y_true").cast("int")), F.lit(1e-15)))) / F.sum("weight")).first()[0]
    return predicted.groupBy("y_true").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") < F.col("b")).alias("n_with_both_ends"),
        F.count_if(F.abs(F.aggregate("p", F.lit(0.0), lambda s, x: s + x) - 1) < 1e-9).alias("n_probabilities_sum_to_one"),
        F.count_if(F.get("p", F.col("y_pred").cast("int")) == F.array_max("p")).alias("n_predicted_is_largest"),
        F.lit(abs(got - loss) < 1e-5 * max(1.0, abs(loss))).alias("loss_as_reported"))


@query("tree_tier_report", _REPORT)
def _(src):
    model, learnt, sealed = _boosted(src)
    judged = Md.predict_tiers(model, learnt.where("valid"), ["a", "b"]).withColumn("weight", F.lit(1.0))
    return _tier_report(Md.predict_tiers(model, sealed, ["a", "b"]), judged, model.losses[len(model.rounds)])


MLP_EPOCHS, MLP_BATCH, MLP_PATIENCE = 50, 2048, 10


def _perceptron(src):
    """The published layers, epochs, batch and patience on all rows that are not sealed."""
    d = _tier_rows(src)
    learnt = d.where("fold <> -1")
    model, losses = Md.mlp_weighted(learnt, valid="valid", hidden=(1024, 512, 256), epochs=MLP_EPOCHS, batch=MLP_BATCH, patience=MLP_PATIENCE)
    return model, losses, learnt, d.where("fold = -1")


@query("mlp_tier_classifier")
def _(src):
    model, _, _, sealed = _perceptron(src)
    return Md.predict_tiers(model, sealed, ["a", "b"])


@query("mlp_tier_report", _REPORT)
def _(src):
    model, losses, learnt, sealed = _perceptron(src)
    weights = M.class_weights(learnt.where("not valid"), "y").select(F.col("y").cast("bigint").alias("y_true"), "weight")  # a row per class
    judged = Md.predict_tiers(model, learnt.where("valid"), ["a", "b"]).join(F.broadcast(weights), "y_true")
    return _tier_report(Md.predict_tiers(model, sealed, ["a", "b"]), judged, min(losses))


_ASKED = "select distinct concat('E', lpad(cast(l_orderkey % 900 as string), 7, '0')) as drug_a, concat('E', lpad(cast((l_partkey * 7 + l_suppkey) % 900 as string), 7, '0')) as drug_b from {}"


@query("saved_model_inference", f"""
with q as ({_ASKED.format('lineitem')}), known as (select entity_id from v_fp where entity_id in (select entity_id from v_sets))
select drug_a, drug_b, least(drug_a, drug_b) as drug_a_canon, greatest(drug_a, drug_b) as drug_b_canon, x.entity_id is not null and z.entity_id is not null and drug_a <> drug_b as in_index,
  case when x.entity_id is not null and z.entity_id is not null and drug_a <> drug_b then 1.0::double end as forest_sum, case when x.entity_id is not null and z.entity_id is not null and drug_a <> drug_b then 1.0::double end as mlp_sum,
  case when x.entity_id is not null and z.entity_id is not null and drug_a <> drug_b then true end as forest_pred_is_largest, case when x.entity_id is not null and z.entity_id is not null and drug_a <> drug_b then true end as mlp_pred_is_largest
from q left join known x on drug_a = x.entity_id left join known z on drug_b = z.entity_id""")
def _(src):
    """Models fitted here, saved, loaded and applied to query pairs; what every grade must hold is compared."""
    d, path = _tier_rows(src).where("fold <> -1"), fresh(src)
    trees = Md.boosted_classifier(d, valid="valid", rounds=3)
    mlp, _ = Md.mlp_weighted(d, valid="valid", hidden=(64,), epochs=1, batch=8192)
    Md.save_models(src.spark, {"forest": trees, "mlp": mlp}, path)
    asked = src.spark.sql(_ASKED.format("{lineitem}"), lineitem=src.table("lineitem"))
    got = Md.score_models(asked, Md.load_models(src.spark, path), materialize(src.sets), materialize(src.fps))
    p = lambda n: [F.col(f"{n}_p{c}") for c in range(5)]
    return got.select("drug_a", "drug_b", "drug_a_canon", "drug_b_canon", "in_index", *[F.round(sum(p(n)[1:], p(n)[0]), 6).alias(f"{n}_sum") for n in ("forest", "mlp")],
                      *[(F.get(F.array(*p(n)), F.col(f"{n}_pred").cast("int")) == F.greatest(*p(n))).alias(f"{n}_pred_is_largest") for n in ("forest", "mlp")])


@query("cv_train_eval")
def _(src):
    d = _training(src, False)
    runs = Md.cv_train_eval(d, {"forest": lambda t, s: Md.tree_classifier(t, trees=5, depth=5, seed=s)}, [42], fresh(src), n_folds=5)
    return M.metrics_table(runs, ["method", "fold", "seed", "test_set"])


@query("cv_run_status", """
with t as (select count(*) as n from v_tier_sealed where fold = -1)
select method, fold, cast(42 as bigint) as seed, case when method = 'broken' then 'failed' else 'ok' end as state, case when method = 'broken' then 0 else n end as n_rows,
  case when method = 'broken' then 'ValueError: no such model' end as error, method <> 'broken' as has_metrics
from (select unnest(['broken', 'forest', 'mlp']) as method) cross join (select cast(unnest(range(1, 6)) as bigint) as fold) cross join t""")
def _(src):
    """Every method, fold and seed ends in one row; a restart repeats only what failed."""
    d = _tier_rows(src).drop("valid")

    def broken(train, valid, seed):
        raise ValueError("no such model")

    methods = {"forest": lambda t, v, s: Md.boosted_classifier(t, valid=v, rounds=1, depth=3, seed=s),
               "mlp": lambda t, v, s: Md.mlp_weighted(t, valid=v, hidden=(32,), epochs=1, batch=1 << 14, seed=s)[0]}
    path = fresh(src)
    Md.train_runs(d, methods, [42], path)
    # The restarted job knows a method more; the finished runs are not trained again.
    again = {n: broken for n in (*methods, "broken")}
    out = Md.train_runs(d, again, [42], path)
    return out.select("method", "fold", "seed", "state", "n_rows", "error", F.col("accuracy").isNotNull().alias("has_metrics"))
