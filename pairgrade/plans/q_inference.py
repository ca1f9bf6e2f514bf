"""Registered queries: resampling inference and referral policy."""

from pyspark.sql import functions as F

from pairgrade.operators import bootstrap as B, halves as H, metrics as M, referral as Rf, runs as R
from pairgrade.plans import views as V
from pairgrade.plans.q_metrics import r6, sel6
from pairgrade.plans.registry import query
from pairgrade.session import materialize

PAIR = ["fold", "seed"]
RUN = ["method", "fold", "seed"]
IND = ["method", "fold", "seed", "part"]
IN_PAIRED = ", ".join(f"'{m}'" for m in B.PAIRED_METRICS)
IN_SEVERE = ", ".join(f"'{m}'" for m in B.SEVERITY_METRICS)


@query("joint_cells", "select fold, seed, y_true, pred_a, pred_b, count(*) as n from v_aligned group by all")
def _(src):
    return B.joint_cells(src.aligned(), PAIR)


@query("hash_resample", f"select cast(rep as bigint) as rep, i, pos from v_draws where rep < {V.N_BOOT_LISTED}")
def _(src):
    """The single draws of the first replicates; all replicates are in ``hash_multiplicities``."""
    ids = src.table("events").select(F.col("event_id").alias("row_id"))
    return B.hash_resample(B.hash_positions(ids), V.N_BOOT_LISTED, 0)


@query("hash_multiplicities", """
with m as (select pos, rep, count(*) as m from v_draws group by 1, 2),
t as (select p.row_id, r.rep, coalesce(m.m, 0) as m from v_pos p cross join (select distinct rep from v_draws) r left join m on m.pos = p.pos and m.rep = r.rep)
select row_id, cast(sum(m) as bigint) as drawn, cast(count(*) filter (where m > 0) as bigint) as replicates, md5(string_agg(cast(m as string), ',' order by rep)) as times_md5 from t group by 1""")
def _(src):
    """How often each row is drawn in each replicate: sums and a digest of the whole vector."""
    ids = src.table("events").select(F.col("event_id").alias("row_id"))
    m = B.packed_multiplicities(ids, V.N_BOOT_HASH, 0, "row_id")
    return m.withColumn("t", B.times_digest(F.col("times"))).select("row_id", "t.drawn", "t.replicates", "t.times_md5")


def _multinomial(src, names):
    cells = materialize(B.joint_cells(src.aligned(), ["method_a", "method_b", *PAIR]))
    keys = ["method_a", "method_b", *PAIR]
    return B.paired_bootstrap(cells, materialize(B.multinomial_draws(cells, keys)), keys, names), cells


def _hash(src, names):
    al = materialize(src.aligned())
    keys = ["method_a", "method_b", *PAIR]
    reps = materialize(B.resampled_vectors(al, keys, V.N_BOOT_HASH))
    return B.paired_bootstrap(B.joint_cells(al, keys), reps, keys, names)


@query("paired_bootstrap")
def _(src):
    return _multinomial(src, B.PAIRED_METRICS)[0]


@query("severity_bootstrap")
def _(src):
    return _multinomial(src, B.SEVERITY_METRICS)[0]


_DETAIL = """select method_a, method_b, fold, seed, metric, round(value_a, 6) as value_a, round(value_b, 6) as value_b, round(delta, 6) as delta,
  n_finite, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, excludes_zero from v_boot_detail"""


@query("paired_bootstrap_hash", f"{_DETAIL} where metric in ({IN_PAIRED})")
def _(src):
    return r6(_hash(src, B.PAIRED_METRICS), "value_a", "value_b", "delta", "ci_low", "ci_high")


@query("severity_bootstrap_hash", f"{_DETAIL} where metric in ({IN_SEVERE})")
def _(src):
    return r6(_hash(src, B.SEVERITY_METRICS), "value_a", "value_b", "delta", "ci_low", "ci_high")


@query("bootstrap_vs_many")
def _(src):
    p = src.preds
    runs = p.select(*RUN, "split", "test_set").distinct()
    matched = R.match_runs(runs, "A")
    on = ["fold", "seed", "split", "test_set"]
    slim = p.select("method", *on, "row_id", "y_true", "y_pred")
    a = slim.where("method = 'A'")
    b = slim.join(F.broadcast(matched.select(F.col("method_b").alias("method"), *on)), ["method", *on], "left_semi")
    keys = ["method_a", "method_b", *PAIR]
    cells = materialize(B.joint_cells(R.align(a, b), keys))
    detail = B.paired_bootstrap(cells, materialize(B.multinomial_draws(cells, keys)), keys)
    t = M.hard_metrics(M.confusion_cells(a, RUN), RUN, ("macro_f1",))
    rep = M.representative_run(t).select(*PAIR, F.lit(True).alias("is_representative"))
    return detail.join(rep, PAIR, "left").withColumn("is_representative", F.coalesce("is_representative", F.lit(False)))


@query("bootstrap_summary", f"""
with m as (select median(macro_f1) as med from v_hard where method = 'A'),
r as (select fold, seed from (select h.fold, h.seed, row_number() over (order by round(abs(macro_f1 - med), 12), fold, seed) as rn from v_hard h cross join m where method = 'A') where rn = 1),
s as (select metric, count(*) as n_runs, count(*) filter (where excludes_zero) as excl0_n from v_boot_detail where metric in ({IN_PAIRED}) group by 1)
select d.method_a, d.method_b, d.metric, round(d.delta, 6) as delta, round(d.ci_low, 6) as ci_low, round(d.ci_high, 6) as ci_high, s.n_runs, s.excl0_n,
  s.excl0_n / cast(s.n_runs as double) as excl0_frac from v_boot_detail d join r using (fold, seed) join s using (metric)""")
def _(src):
    detail = materialize(_hash(src, B.PAIRED_METRICS))
    t = M.hard_metrics(M.confusion_cells(src.preds.where("method = 'A'"), RUN), RUN, ("macro_f1",))
    return r6(B.summary(detail, M.representative_run(t).select(*PAIR)), "delta", "ci_low", "ci_high")


@query("cluster_bootstrap", """
with c as (select fold, seed, count(delta) as n_finite, quantile_cont(delta, 0.025) as ci_low, quantile_cont(delta, 0.975) as ci_high,
  avg(cast(delta <= 0 as int)) as share from v_cluster_boot where metric = 'macro_f1_sev' group by 1, 2)
select p.fold, p.seed, round(p.delta, 6) as delta, n_finite, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high,
  round(share, 6) as share_not_above_0, ci_low > 0 or ci_high < 0 as excludes_zero
from v_cluster_point p join c using (fold, seed) where p.metric = 'macro_f1_sev'""")
def _(src):
    ev = src.table("events")
    n = ev.agg(F.count_distinct("user_id")).scalar()
    al = (src.aligned().where("y_true >= 1")
          .join(ev.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("a")), "row_id")
          .withColumn("b", (F.col("row_id") * 7 + 3) % n))
    al = materialize(al.select(*PAIR, "a", "b", "y_true", "pred_a", "pred_b"))
    reps = B.deltas(materialize(B.cluster_vectors(al, PAIR, V.N_BOOT_HASH)), [*PAIR, "rep"], ["macro_f1_sev"])
    point = B.deltas(B.joint_cells(al, PAIR), PAIR, ["macro_f1_sev"]).select(*PAIR, "delta")
    out = point.join(B.interval(reps, PAIR), PAIR)
    return r6(out, "delta", "ci_low", "ci_high", "share_not_above_0")


_TT = """
with d as (select a.macro_f1 - b.macro_f1 as d from v_hard a join v_hard b on a.method = 'A' and b.method = 'B' and a.fold = b.fold and a.seed = b.seed)
select 'A' as method_a, 'B' as method_b, count(*) as n, round(avg(d), 6) as mean_delta, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) as t from d"""


def _ttest(src):
    t = M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("macro_f1",))
    a = t.where("method = 'A'").select(F.col("method").alias("method_a"), *PAIR, F.col("macro_f1").alias("value_a"))
    b = t.where("method <> 'A'").select(F.col("method").alias("method_b"), *PAIR, F.col("macro_f1").alias("value_b"))
    return B.paired_t(a.join(b, PAIR), ["method_a", "method_b"])


@query("paired_ttest", _TT)
def _(src):
    return _ttest(src).withColumns({"mean_delta": F.round("mean_delta", 6), "t": F.round("t", 4)})


# Two-sided tail of the t distribution in closed form for the three degrees of freedom of four runs.
@query("paired_ttest_p", """
with d as (select a.macro_f1 - b.macro_f1 as d from v_hard a join v_hard b on a.method = 'A' and b.method = 'B' and a.fold = b.fold and a.seed = b.seed),
s as (select count(*) as n, avg(d) as mean_delta, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t from d),
p as (select *, case when n = 4 then 1 - 2 / pi() * (atan(abs(t) / sqrt(3)) + abs(t) / sqrt(3) / (1 + t * t / 3)) end as p from s)
select 'A' as method_a, 'B' as method_b, n, round(mean_delta, 6) as mean_delta, round(t, 4) as t, round(p, 8) as p,
  case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as stars from p""")
def _(src):
    return B.t_p_value(_ttest(src)).withColumns({"mean_delta": F.round("mean_delta", 6), "t": F.round("t", 4), "p": F.round("p", 8)})


# ------------------------------------------------------------ referral policy

@query("referral_decide", """
select method, fold, seed, row_id, case when r > 0.6 then 'ALERT' when r < 0.3 then 'PASSIVE' else 'REVIEW' end as decision from v_preds""")
def _(src):
    return src.preds.select(*RUN, "row_id", Rf.decide(F.col("r"), F.lit(0.3), F.lit(0.6)).alias("decision"))


@query("split_pairs_half", """
select method, fold, seed, row_id, string_agg(case when is_cal then 'c' else 'e' end, '' order by rep) as sides from v_half group by 1, 2, 3, 4""")
def _(src):
    """A letter for each repeat: calibration or evaluation."""
    rows, sides = src.pair_sides()
    return H.packed(rows.select(*RUN, "row_id"), RUN, sides)


@query("mondrian_thresholds", "select method, fold, seed, cast(rep as bigint) as rep, budget, lo, hi from v_thr")
def _(src):
    rows, sides = src.pair_sides()
    return H.thresholds(H.evaluate(rows, RUN, sides, unjudged=True), RUN)


@query("referral_metrics", f"""
select method, fold, seed, cast(rep as bigint) as rep, alpha, beta, lam_lo, lam_hi, {', '.join(V.REF_METRICS)}, exceed_miss, exceed_false_alert from v_eval""")
def _(src):
    rows, sides = src.pair_sides()
    return H.evaluate(rows, RUN, sides)


@query("referral_reference", """
select method, fold, seed, cast(rep as bigint) as rep, ref_argmax_miss, ref_argmax_false_alert, ref_thr05_miss, ref_thr05_false_alert from v_refpol""")
def _(src):
    rows, sides = src.pair_sides()
    return H.references(rows, RUN, sides)


@query("split_entities_half", """
select method, fold, seed, part, row_id, u1, u2, string_agg(case side when 'cal' then 'c' when 'eval' then 'e' else 'm' end, '' order by rep) as sides
from v_cold_assigned group by 1, 2, 3, 4, 5, 6, 7""")
def _(src):
    """A letter for each repeat: calibration, evaluation or mixed."""
    rows, sides = src.cold_sides()
    return H.packed(rows.select(*IND, "row_id", "u1", "u2"), IND, sides)


@query("crc_thresholds", "select method, fold, seed, part, cast(rep as bigint) as rep, budget, lo, hi from v_crc_thr")
def _(src):
    rows, sides = src.cold_sides()
    return H.thresholds(H.evaluate(rows.where("u2 is null"), IND, sides, "risk", unjudged=True), IND)


@query("entity_averaged_rates", """
with t as (select l.method, l.fold, l.seed, l.part, l.rep, l.budget as alpha, h.budget as beta, l.lo, h.hi from v_crc_thr l
  join v_crc_thr h on l.method = h.method and l.fold = h.fold and l.seed = h.seed and l.part = h.part and l.rep = h.rep),
e as (select method, fold, seed, part, rep, alpha, beta, u1,
  count(*) filter (where y_true >= 3 and r < lo) / nullif(cast(count(*) filter (where y_true >= 3) as double), 0) as m,
  count(*) filter (where y_true < 3 and r > hi) / nullif(cast(count(*) filter (where y_true < 3) as double), 0) as f,
  count(*) filter (where r >= lo and r <= hi) / cast(count(*) as double) as v from v_cold_eval1 join t using (method, fold, seed, part, rep) group by 1, 2, 3, 4, 5, 6, 7, 8)
select method, fold, seed, part, cast(rep as bigint) as rep, alpha, beta, round(avg(m), 6) as entity_miss, round(avg(f), 6) as entity_false_alert, round(avg(v), 6) as entity_review,
  cast(avg(m) / alpha > 1 + 1e-9 as bigint) as exceed_miss, cast(avg(f) / beta > 1 + 1e-9 as bigint) as exceed_false_alert from e group by 1, 2, 3, 4, 5, 6, 7""")
def _(src):
    rows, sides = src.cold_sides()
    t = H.evaluate(rows.where("u2 is null"), IND, sides, "risk", "entities").drop("lam_lo", "lam_hi")
    return r6(t, "entity_miss", "entity_false_alert", "entity_review")


@query("transductive_run", f"select method, fold, seed, alpha, beta, {sel6(V.REF_METRICS)} from v_trans")
def _(src):
    rows, sides = src.pair_sides()
    t = Rf.mean_over_reps(H.evaluate(rows, RUN, sides), RUN)
    return r6(t.select(*RUN, "alpha", "beta", *Rf.METRICS), *Rf.METRICS)


def _pooled(src) -> dict:
    """Thresholds of the pair-level halves, for the cold-start parts of the same run."""
    rows, sides = src.pair_sides()
    limits = H.collected(H.thresholds(H.evaluate(rows, RUN, sides, unjudged=True), RUN), RUN, sides.n_reps)
    return {(*run, part): limit for run, limit in limits.items() for part in ("S1", "S2")}


@query("inductive_run", f"""
select method, fold, seed, part, calibration, alpha, beta, {sel6(V.REF_METRICS)}, round(exceed_miss, 6) as exceed_miss, round(exceed_false_alert, 6) as exceed_false_alert from v_ind""")
def _(src):
    rows, sides = src.cold_sides()
    one = rows.where("u2 is null")
    kinds = {"pair-level": H.evaluate(rows, IND, sides), "entity-level": H.evaluate(one, IND, sides, "risk"),
             "transferred": H.evaluate(rows, IND, sides, given=_pooled(src))}
    values = [*Rf.METRICS, "exceed_miss", "exceed_false_alert"]
    out = None
    for name, found in kinds.items():
        mean = Rf.mean_over_reps(found, IND).select(*IND, F.lit(name).alias("calibration"), "alpha", "beta", *values)
        out = mean if out is None else out.unionByName(mean)
    return r6(out, *values)


@query("threshold_transfer", f"""
select method, fold, seed, part, cast(rep as bigint) as rep, alpha, beta, lam_lo, lam_hi, {', '.join(V.REF_METRICS)}, exceed_miss, exceed_false_alert from v_pooled_res""")
def _(src):
    rows, sides = src.cold_sides()
    return H.evaluate(rows, IND, sides, given=_pooled(src))


def _policy(src):
    rows, sides = src.pair_sides()
    res = Rf.mean_over_reps(H.evaluate(rows, RUN, sides), RUN)
    ref = H.references(rows, RUN, sides).groupBy(*RUN).agg(*[
        F.avg(c).alias(c) for c in ("ref_argmax_miss", "ref_argmax_false_alert", "ref_thr05_miss", "ref_thr05_false_alert")])
    return Rf.policy_long(res.drop("fold", "seed"), ["method"], ref.drop("fold", "seed"))


@query("policy_long_table", "select method, alpha, beta, metric, round(mean, 6) as mean, round(sd, 6) as sd, n_runs from v_policy_long")
def _(src):
    return r6(_policy(src), "mean", "sd")


@query("monotone_check", """
with t as (select * from v_policy_long where metric = 'review_frac'),
u as (select method, 'alpha' as direction, mean > lag(mean) over (partition by method, beta order by alpha) + 1e-12 as up from t
  union all select method, 'beta' as direction, mean > lag(mean) over (partition by method, alpha order by beta) + 1e-12 as up from t)
select method, direction, count(*) filter (where up) as n_violations from u group by 1, 2""")
def _(src):
    return Rf.monotone_violations(_policy(src), ["method"])


@query("split_size_report", """
with c as (select method, fold, seed, part, rep, count(*) filter (where side = 'cal') as cal, count(*) filter (where side = 'eval') as ev, count(*) filter (where side = 'mixed') as mixed
  from v_cold_assigned group by 1, 2, 3, 4, 5)
select method, fold, seed, part, round(avg(cal), 6) as mean_cal, round(avg(ev), 6) as mean_eval, round(avg(mixed), 6) as mean_mixed from c group by 1, 2, 3, 4""")
def _(src):
    rows, sides = src.cold_sides()
    return r6(H.sizes(rows, IND, sides), "mean_cal", "mean_eval", "mean_mixed")


@query("long_cell_lookup", """
select round(mean, 6) as mean, round(sd, 6) as sd, 'budget' as kind from v_policy_long where method = 'A' and metric = 'review_frac' and alpha = 0.01 and beta = 0.02
union all select round(mean, 6) as mean, round(sd, 6) as sd, 'reference' as kind from v_policy_long where method = 'A' and metric = 'ref_thr05_miss' and alpha is null""")
def _(src):
    t = materialize(_policy(src))
    a = R.long_cell(t, "review_frac", 0.01, 0.02, method="A").withColumn("kind", F.lit("budget"))
    b = R.long_cell(t, "ref_thr05_miss", None, None, method="A").withColumn("kind", F.lit("reference"))
    return r6(a.unionByName(b), "mean", "sd").drop("n")


@query("budget_curve", """
select method, """ + ", ".join(f"round(max(mean) filter (where alpha = {a}), 6) as a_{str(a).replace('.', '_')}" for a in (0.005, 0.01, 0.02, 0.05)) + """
from v_policy_long where metric = 'review_frac' and beta = 0.01 group by 1""")
def _(src):
    t = R.budget_curve(_policy(src), "review_frac", 0.01, [0.005, 0.01, 0.02, 0.05], ["method"])
    return r6(t, *[c for c in t.columns if c != "method"])
