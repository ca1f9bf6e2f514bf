"""Registered queries: splits, samples and data-quality gates."""

import uuid

from pyspark.sql import functions as F

from pairgrade.functions.hashing import keyed_md5
from pairgrade.operators import features as X, pairs as P, quality as Q, scoring as C, splits as S
from pairgrade.plans import views as V
from pairgrade.plans.q_ingest import _oracle_bio
from pairgrade.plans.registry import query
from pairgrade.session import materialize, work_dir
from pairgrade.sources import tables as Tb

IDS = ["a", "b"]


@query("rank_by_hash", """
select a, b, y, row_number() over (order by md5(concat_ws('|', '7', a, b)), a, b) as rank from v_pairs""")
def _(src):
    return S.rank_by_hash(src.pairs_table, 7, IDS)


@query("set_difference", """
with k as (select entity_id from v_held where seed = 42 and not held_out)
select (select count(*) from k) as n_both, (select count(*) from v_universe) - (select count(*) from k) as only_left,
  cast(0 as bigint) as only_right,
  (select min(entity_id) from v_universe where entity_id not in (select entity_id from k)) as example_left,
  cast(null as varchar) as example_right, cast((select count(*) from k) = (select count(*) from v_universe) as int) as is_equal""")
def _(src):
    u = P.entity_universe(src.pairs_table)
    k = S.held_out_entities(u, [42]).where("not held_out")
    return S.set_diff_report(u, k, ["entity_id"])


@query("stratified_cap", """
select a, b, y from (select *, row_number() over (partition by y order by md5(concat_ws('|', '42', a, b)), a, b) as rn from v_pairs)
where (y <> 1 or rn <= 1000) and (y <> 2 or rn <= 500)""")
def _(src):
    return S.stratified_cap(src.pairs_table, "y", IDS, 42, {1: 1000, 2: 500})


@query("sealed_test_split", "select a, b, y, sealed_test = 1 as in_test from v_sealed")
def _(src):
    return S.stratified_cut(src.pairs_table, "y", IDS, 42, S.ceil_share(1, 5))


@query("stratified_kfold", "select a, b, y, sealed_test, fold from v_sealed")
def _(src):
    return src.sealed


@query("cold_start_split", "select seed, a, b, y, part from v_cold")
def _(src):
    return src.cold().select("seed", "a", "b", "y", "part")


@query("membership_flags", """
select p.a, p.b, x.held_out as in_a, z.held_out as in_b from v_pairs p
join v_held x on p.a = x.entity_id and x.seed = 42 join v_held z on p.b = z.entity_id and z.seed = 42""")
def _(src):
    pairs = src.pairs_table.select("a", "b")
    held = S.held_out_entities(P.entity_universe(pairs), [42]).where("held_out")
    return S.membership_flags(pairs, held)


@query("kk_holdout", f"""
with kk as (select a, b, y from v_cold where seed = 42 and part = 'KK'),
q as ({V._quota('kk', '(n_all + 9) // 10')}),
g as (select case when min(n) < 2 or (select (count(*) + 9) // 10 from kk) < count(*) or (select count(*) - (count(*) + 9) // 10 from kk) < count(*) then 1 else 0 end as plain from q),
r as (select *, row_number() over (partition by y order by md5(concat_ws('|', '42', a, b)), a, b) as rn,
  row_number() over (order by md5(concat_ws('|', '42', a, b)), a, b) as rn_all, count(*) over () as n_all from kk)
select r.a, r.b, r.y, case when g.plain = 1 then rn_all <= (n_all + 9) // 10 else rn <= quota end as is_val
from r join q on r.y = q.y cross join g""")
def _(src):
    kk = materialize(src.cold(seeds=(42,)).where("seed = 42 and part = 'KK'").select("a", "b", "y"))
    return S.stratified_or_plain_cut(kk, "y", IDS, 42, S.ceil_share(1, 10), "is_val")


@query("stratified_subset", f"""
with q as ({V._quota('v_pairs', 'least(greatest((2 * n_all + 100) // 200, 100), n_all)')}),
r as (select *, row_number() over (partition by y order by md5(concat_ws('|', '42', a, b)), a, b) as rn from v_pairs)
select r.a, r.b, r.y from r join q on r.y = q.y where rn <= quota""")
def _(src):
    cut = S.stratified_cut(src.pairs_table, "y", IDS, 42, S.rounded_share(1, 100, at_least=100), "keep")
    return cut.where("keep").drop("keep")


@query("dev_train_val", f"""
with d as (select a, b, y from v_sealed where sealed_test = 0), q as ({V._quota('d', '(n_all + 19) // 20')}),
r as (select *, row_number() over (partition by y order by md5(concat_ws('|', '42', a, b)), a, b) as rn from d)
select r.a, r.b, r.y, rn <= quota as is_val from r join q on r.y = q.y""")
def _(src):
    dev = materialize(src.sealed.where("sealed_test = 0").select("a", "b", "y"))
    return S.stratified_cut(dev, "y", IDS, 42, S.ceil_share(1, 20), "is_val")


@query("three_way_split", f"""
with t as (select a, b, y, sealed_test from v_sealed), d as (select a, b, y from t where sealed_test = 0),
q as ({V._quota('d', '(n_all + 3) // 4')}),
r as (select *, row_number() over (partition by y order by md5(concat_ws('|', '42', a, b)), a, b) as rn from d)
select a, b, y, 'test' as part from t where sealed_test = 1
union all select r.a, r.b, r.y, case when rn <= quota then 'val' else 'train' end as part from r join q on r.y = q.y""")
def _(src):
    return S.three_way(src.pairs_table, "y", IDS, 42)


@query("split_manifest", """
select substr(sha256(a || '|' || b), 1, 32) as pair_hash, sealed_test, fold from v_sealed""")
def _(src):
    return S.split_manifest(src.sealed)


@query("split_manifest_counts", """
select 'fold ' || cast(fold as string) as split, count(*) as n from v_sealed group by 1
union all select part || ' ' || cast(seed as string) as split, count(*) as n from v_cold group by 1""")
def _(src):
    pairs = src.pairs_table
    folds = S.sealed_and_folds(pairs, "y", IDS, 42).select(F.concat_ws(" ", F.lit("fold"), "fold").alias("split"))
    cold = src.cold(pairs).select(F.concat_ws(" ", "part", "seed").alias("split"))
    return folds.unionByName(cold).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("edge_drop", """
select a, b, y from v_pairs where cast('0x' || substr(md5(concat_ws('|', '3', a, b)), 1, 8) as bigint) >= 858993459""")
def _(src):
    return S.edge_drop(src.pairs_table, IDS, 3, 0.2)


@query("bounded_sample", """
select row_id, y_true from (select *, row_number() over (order by md5(concat_ws('|', '5', cast(row_id as string))), row_id) as rn
  from (select event_id as row_id, cast(event_id * 7 + user_id * 3 as bigint) % 5 as y_true from events))
where rn <= 200 or row_id = 17""")
def _(src):
    rows = src.table("events").selectExpr("event_id as row_id", f"{V.PRED_Y} as y_true")
    return S.bounded_sample(rows, ["row_id"], 5, 200, F.col("row_id") == 17)


@query("split_recompute_check", """
select (select count(*) from v_sealed where sealed_test = 1) as n_both, cast(0 as bigint) as only_left, cast(0 as bigint) as only_right,
  cast(null as varchar) as example_left, cast(null as varchar) as example_right, 1 as is_equal""")
def _(src):
    pairs = src.pairs_table
    one = S.sealed_and_folds(pairs, "y", IDS, 42).where("sealed_test = 1")
    two = S.three_way(pairs, "y", IDS, 42).where("part = 'test'")
    return S.set_diff_report(one, two, IDS)


_ROWS = f"(select event_id as row_id, {V.PRED_Y} as y_true from events)"


@query("subset_index_remap", f"""
select row_id, y_true, row_number() over (order by md5(concat_ws('|', '11', cast(row_id as string))), row_id) - 1 as position
from {_ROWS} where y_true = 3""")
def _(src):
    rows = src.table("events").selectExpr("event_id as row_id", f"{V.PRED_Y} as y_true")
    sub = S.rank_by_hash(rows.where("y_true = 3"), 11, ["row_id"], "p")
    return sub.select("row_id", "y_true", (F.col("p") - 1).alias("position"))


@query("test_row_sample", f"""
with ids as (select o_orderkey * 3 as row_id from orders), k as (select * from {_ROWS} where row_id in (select row_id from ids))
select row_id, y_true from (select *, row_number() over (order by md5(concat_ws('|', '13', cast(row_id as string))), row_id) as rn from k) where rn <= 500""")
def _(src):
    rows = src.table("events").selectExpr("event_id as row_id", f"{V.PRED_Y} as y_true")
    ids = src.table("orders").selectExpr("o_orderkey * 3 as row_id")
    return S.bounded_sample(S.rows_by_id(rows, ids), ["row_id"], 13, 500)


# ------------------------------------------------------------------ gates

_RUN = ["method", "fold", "seed"]


@query("check_prob_rows", """
with p as (select *, cast(w0 + w1 + w2 + w3 + w4 as double) as s from v_preds)
select method, fold, seed, count(*) as n, cast(0 as bigint) as n_bad_width, cast(0 as bigint) as n_not_finite,
  round(max(abs(w0 / s + w1 / s + w2 / s + w3 / s + w4 / s - 1)), 6) as max_dev from p group by 1, 2, 3""")
def _(src):
    return Q.check_prob_rows(src.runs, _RUN).withColumn("max_dev", F.round("max_dev", 6))


@query("check_argmax", """
select method, fold, seed, count(*) as n, count(*) filter (where row_id % 97 = 0 and y_pred <> 0) as n_mismatch
from v_preds group by 1, 2, 3""")
def _(src):
    odd = src.runs.withColumn("y_pred", F.when(F.col("row_id") % 97 == 0, 0).otherwise(F.col("y_pred")))
    return Q.check_argmax(odd, _RUN)


@query("check_row_ids", """
select method, fold, seed, count(*) + count(*) filter (where row_id % 50 = 0) as n,
  count(*) filter (where row_id % 50 = 0) as n_repeated, count(*) filter (where row_id % 31 = 0) as n_unknown,
  count(*) filter (where row_id % 31 <> 0 and row_id % 29 = 0) as n_label_diff from v_preds group by 1, 2, 3""")
def _(src):
    runs = src.preds.withColumn("y_true", F.when(F.col("row_id") % 29 == 0, (F.col("y_true") + 1) % 5)
                                .otherwise(F.col("y_true")))
    runs = runs.unionByName(runs.where("row_id % 50 = 0"))
    master = src.table("events").selectExpr("event_id as row_id", f"{V.PRED_Y} as y_true").where("row_id % 31 <> 0")
    return Q.check_row_ids(runs, master, _RUN)


@query("check_same_test_set", """
with p as (select * from v_preds where not (method = 'B' and seed = 123 and row_id % 10 = 0)),
c as (select method, fold, seed, count(*) as n from p group by 1, 2, 3)
select method, fold, count(*) as n_runs, count(distinct n) as n_signatures, min(n) as min_rows, max(n) as max_rows from c group by 1, 2""")
def _(src):
    runs = src.preds.where("not (method = 'B' and seed = 123 and row_id % 10 = 0)")
    return Q.check_same_test_set(runs, _RUN, ["method", "fold"])


@query("check_recompute_sample", """
with s as (select * from (select a, b, row_number() over (order by md5(concat_ws('|', '42', a, b)), a, b) as rn from v_pairs) where rn <= 200)
select count(*) as n, cast(0 as bigint) as n_missing,
  round(max(case when substr(md5(concat_ws('|', 'err', a, b)), 1, 1) = '0' then cast(0.001 as double) else 0.0 end), 6) as max_abs_diff,
  count(*) filter (where substr(md5(concat_ws('|', 'err', a, b)), 1, 1) = '0') as n_over from s""")
def _(src):
    feats = X.pair_lookup(src.pairs.select("a", "b"), src.fps).select(
        "a", "b", X.tanimoto(F.col("bits_a"), F.col("bits_b")).alias("sim"))
    feats = materialize(feats)
    err = F.substring(keyed_md5("err", F.col("a"), F.col("b")), 1, 1) == "0"
    stored = S.bounded_sample(feats.withColumn("sim", F.col("sim") + F.when(err, 0.001).otherwise(0.0)), IDS, 42, 200)
    return Q.check_recompute(stored, feats, IDS, "sim").withColumn("max_abs_diff", F.round("max_abs_diff", 6))


@query("check_change_rate", """
with o as (select y, case when substr(md5(concat_ws('|', 'old', a, b)), 1, 1) < '4' then 2 else y end as old_y from v_pairs)
select count(*) filter (where y <> old_y) as n_changed,
  case when count(*) filter (where y <> old_y) between 9000 and 11000 then 1 else 0 end as within from o""")
def _(src):
    old = src.pairs_table.withColumn("old_y", F.when(
        F.substring(keyed_md5("old", F.col("a"), F.col("b")), 1, 1) < "4", 2).otherwise(F.col("y")))
    return Q.check_change_rate(old, "old_y", "y", 10_000)


@query("dictionary_diff", """
with l as (select p_name as phrase, min(p_size) as tier from part where p_size % 3 <> 0 group by 1),
r as (select p_name as phrase, min(p_size) as tier from part where p_size % 3 <> 1 and p_brand <> 'Brand#2' group by 1)
select coalesce(l.phrase, r.phrase) as phrase, l.tier as left_value, r.tier as right_value,
  case when r.phrase is null then 'only_left' when l.phrase is null then 'only_right' when l.tier is distinct from r.tier then 'value' else 'equal' end as status
from l full join r on l.phrase = r.phrase""")
def _(src):
    part = src.table("part")
    side = lambda cond: part.where(cond).groupBy(F.col("p_name").alias("phrase")).agg(
        F.min("p_size").alias("tier"))
    return Q.dictionary_diff(side("p_size % 3 <> 0"), side("p_size % 3 <> 1 and p_brand <> 'Brand#2'"), "phrase", "tier")


@query("feature_slices", """
select vec_id, round(list_sum(embedding[1:32]::double[]), 6) as first_sum, round(list_sum(embedding[33:48]::double[]), 6) as second_sum,
  cast(embedding[49] as double) as third_head, cast(len(embedding[49:64]) as bigint) as third_len from embeddings""")
def _(src):
    s = C.slices(src.table("embeddings"), "embedding", {"x": (0, 32), "z": (32, 16), "w": (48, 16)})
    return s.select("vec_id", F.round(C.vec_sum(F.col("x")), 6).alias("first_sum"),
                    F.round(C.vec_sum(F.col("z")), 6).alias("second_sum"),
                    F.get("w", 0).cast("double").alias("third_head"), F.size("w").cast("bigint").alias("third_len"))


_NAMES = [f"f{i:02d}" for i in range(X.N_BIO)]
_VECTORS = f"""
with f as ({_oracle_bio()}),
v as (select a, b, [{', '.join(f'cast({n} as float)' for n in _NAMES)}] as e, substr(md5(concat_ws('|', 'fault', a, b)), 1, 2) as h from f)"""


def _stored(src):
    """Bio features of all pairs as a stored table, read back; and the pairs' keys with a hash."""
    path = f"{work_dir(src.spark)}/pairgrade/{uuid.uuid4().hex}"
    Tb.write_features(X.bio_pair_features(src.pairs.select("a", "b"), src.sets), path, IDS, _NAMES)
    return src.spark.read.parquet(path)


@query("feature_audit", _VECTORS + """
select a, b, 'value' as fault, 5 as place, cast(e[6] + cast(0.5 as float) as double) as stored, cast(e[6] as double) as expected from v where h = '00'
union all select a, b, 'width', null, 23.0::double, 24.0::double from v where h = '01'
union all select a, b, 'missing', null, null, null from v where h = '02'
union all select a, b, 'duplicate', null, 2.0::double, 1.0::double from v where h = '03'
union all select a, b, 'order', null, null, null from v where h = '04' and list_reverse(e) <> e
union all select b, a, 'extra', null, null, null from v where h = '05'""")
def _(src):
    """Six kinds of faults put into the stored features of one pair in 256 each; all are found and no other."""
    h = F.substring(keyed_md5("fault", F.col("a"), F.col("b")), 1, 2)
    rows = _stored(src).withColumn("h", h)
    bad = F.when(h == "00", F.transform("features", lambda v, i: F.when(i == 5, v + F.lit(0.5).cast("float")).otherwise(v))).when(
        h == "01", F.slice("features", 1, X.N_BIO - 1)).when(h == "04", F.reverse("features")).otherwise(F.col("features"))
    stored = rows.where(h != "02").select("a", "b", bad.alias("features"))
    stored = stored.unionByName(rows.where(h == "03").select("a", "b", "features"))
    stored = stored.unionByName(rows.where(h == "05").select(F.col("b").alias("a"), F.col("a").alias("b"), "features"))
    anew = X.bio_pair_features(src.pairs.select("a", "b"), src.sets).select("a", "b", F.array(*_NAMES).alias("features"))
    return Q.audit_features(stored, anew, IDS)


@query("feature_column_audit", _VECTORS + """,
x as (select unnest(range(1, 25)) as i, unnest(e) as x from v), y as (select i, cast(round(cast(x as double) * 10000) as bigint) as v from x)
select 'f' || lpad(cast(i - 1 as string), 2, '0') as feature, count(*) as n, count(*) filter (where v <> 0) as n_nonzero, cast(sum(v) as bigint) as total,
  cast(sum(cast(v as hugeint) * v) as string) as squares, true as all_fit from y group by i""")
def _(src):
    """The stored values themselves, by column."""
    return Q.column_audit(_stored(src), _NAMES)
