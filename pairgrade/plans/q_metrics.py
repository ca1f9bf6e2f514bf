"""Registered queries: run bookkeeping and ordinal evaluation."""

from pyspark.sql import functions as F

from pairgrade.operators import metrics as M, runs as R, scoring as C
from pairgrade.plans.registry import query
from pairgrade.plans.views import METRIC_NAMES
from pairgrade.session import work_dir
from pairgrade.sources import runs as SR

RUN = ["method", "fold", "seed"]
KEYS = "method, fold, seed"


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def sel6(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def hard_long(src):
    t = M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN)
    return M.long_metrics(t, RUN, METRIC_NAMES)


# ------------------------------------------------------------ run bookkeeping

@query("run_file_scan", f"""
select {KEYS}, case when fold = 2 and seed = 123 then 'drug' else 'pair' end as split,
  case when fold = 2 and seed = 123 then 'S1' else 'test' end as test_set, count(*) as n, cast(sum(row_id) as bigint) as id_sum
from v_preds group by 1, 2, 3, 4, 5""")
def _(src):
    p = src.preds
    name = F.concat(R.run_key(F.col("method"), F.col("fold"), F.col("seed")),
                    F.when((F.col("fold") == 2) & (F.col("seed") == 123), "_S1").otherwise(""))
    import uuid
    path = f"{work_dir(src.spark)}/pairgrade/{uuid.uuid4().hex}"
    p.select(name.alias("run"), "row_id", "y_true", "y_pred").write.partitionBy("run").parquet(path)
    scanned = SR.scan_runs(src.spark, path)
    return scanned.groupBy("method", "fold", "seed", "split", "test_set").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))


@query("run_schema_compat", """
select method, fold, seed, row_id, y_true, y_pred,
  round(case when row_id % 3 = 0 then (case when y_pred = 3 then 1.0::double else 0.0::double end)
    when row_id % 3 = 1 then 0.0::double else w3 / cast(w0 + w1 + w2 + w3 + w4 as double) end, 6) as p3
from v_preds""")
def _(src):
    old = src.runs.select(
        *RUN, "row_id", F.col("y_true").alias("y_test"), "y_pred",
        F.when(F.col("row_id") % 3 == 0, F.lit(None)).when(F.col("row_id") % 3 == 1, F.slice("p", 1, 3))
        .otherwise(F.col("p")).alias("p"))
    new = SR.compat_schema(old)
    return new.select(*RUN, "row_id", "y_true", "y_pred", F.round(F.get("p", 3), 6).alias("p3"))


@query("state_json_scan", f"""
select method || '_f' || fold || '_s' || seed as run_key, {KEYS},
  case when fold = 2 then 'drug' else 'pair' end as split, case when fold = 2 then 'S1' else 'test' end as test_set,
  round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1 from v_hard where not (method = 'B' and seed = 123)""")
def _(src):
    t = M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("accuracy", "macro_f1"))
    drug = F.col("fold") == 2
    rec = F.struct("method", "fold", "seed", F.when(drug, "drug").alias("split_mode"),
                   F.when(drug, "S1").alias("test_set"),
                   F.when((F.col("method") == "B") & (F.col("seed") == 123), "out of memory").alias("error"),
                   "accuracy", "macro_f1")
    # A state file holds the runs of one method: a handful of entries.
    docs = t.groupBy("method").agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(F.struct(R.run_key(F.col("method"), F.col("fold"), F.col("seed")), rec))).alias("runs"),
        F.lit("full:pair").alias("mode"))).alias("state"))
    return r6(SR.state_runs(docs), "accuracy", "macro_f1")


_STATE = f"""
with f as (select {KEYS}, {', '.join(f"max(case when c = {c} then f1 end) as f1_c{c}" for c in range(5))} from v_class_f1 group by 1, 2, 3),
s as (select method || '_f' || fold || '_s' || seed as run_key, {KEYS}, case when fold = 2 then 'drug' else 'pair' end as split, case when fold = 2 then 'S1' else 'test' end as test_set,
  n_eval as n, {sel6([*METRIC_NAMES, 'macro_auroc', 'macro_ap', *[f'f1_c{c}' for c in range(5)]])}, round(accuracy - macro_f1, 6) as gap
  from v_hard join f using ({KEYS}) join v_ranking using ({KEYS}) where not (method = 'B' and seed = 123))"""
_STATE_COLUMNS = f"run_key, {KEYS}, split, test_set, n"


def _states(src):
    """State documents with all metrics of every run, and one that no reader knows."""
    t = M.metrics_table(src.runs_table, RUN)
    values = [*METRIC_NAMES, "macro_auroc", "macro_ap"]
    drug = F.col("fold") == 2
    rec = F.struct("method", "fold", "seed", F.when(drug, "drug").alias("split_mode"), F.when(drug, "S1").alias("test_set"),
                   F.when((F.col("method") == "B") & (F.col("seed") == 123), "out of memory").alias("error"), "n_eval",
                   *[F.round(c, 6).alias(c) for c in values], F.array(*[F.round(f"f1_c{c}", 6) for c in range(5)]).alias("per_class_f1"),
                   F.round(F.col("accuracy") - F.col("macro_f1"), 6).alias("gap"))
    return t.groupBy("method").agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(F.struct(R.run_key(F.col("method"), F.col("fold"), F.col("seed")), rec))).alias("runs"),
        F.lit("full:pair").alias("mode"))).alias("state"))


@query("state_metrics_table", f"{_STATE} select {_STATE_COLUMNS}, {', '.join([*METRIC_NAMES, 'macro_auroc', 'macro_ap', *[f'f1_c{c}' for c in range(5)]])} from s")
def _(src):
    return SR.state_table(_states(src))


@query("state_metrics_long", f"{_STATE} " + " union all ".join(
    f"select {_STATE_COLUMNS}, '{m}' as metric, {m} as value, {'false' if m == 'gap' else 'true'} as is_known from s" for m in [*METRIC_NAMES, "macro_auroc", "macro_ap", "gap"]))
def _(src):
    return SR.state_long(_states(src))


@query("runs_union_unique", f"""
with k as (select {KEYS}, case when lower(test_set) in ('test', 'holdout') then 'test' else test_set end as ts, test_set, n, split from v_runs),
u as (select *, row_number() over (partition by {KEYS}, ts order by test_set desc, split) as i from k)
select {KEYS}, test_set, n, case when fold < 3 then 'first' else 'second' end as part from u where i = 1""")
def _(src):
    r = src.run_rows.withColumn("ts", R.norm_test_set(F.col("test_set")))
    best = r.groupBy(*RUN, "ts").agg(F.max(F.struct("test_set", F.negative(F.ascii("split")).alias("k"), "n")).alias("b"))
    runs = best.select(*RUN, "b.test_set", "b.n")
    first, second = (runs.where(c).withColumn("part", F.lit(p)) for c, p in (("fold < 3", "first"), ("fold >= 3", "second")))
    return R.union_unique(first, second)


@query("runs_prefer_primary", f"""
with p as (select {KEYS}, sum(n) as n from v_runs where n_high > 0 group by {KEYS}), f as (select {KEYS}, sum(n) as n from v_runs group by {KEYS})
select {KEYS}, cast(n as bigint) as n, 'recomputed' as source from p
union all select {KEYS}, cast(n as bigint) as n, 'state' as source from f anti join p using ({KEYS})""")
def _(src):
    total = lambda df, s: df.groupBy(*RUN).agg(F.sum("n").alias("n")).withColumn("source", F.lit(s))
    return R.prefer_primary(total(src.run_rows.where("n_high > 0"), "recomputed"), total(src.run_rows, "state"), RUN)


@query("run_grid_check", f"""
with have as (select {KEYS}, sum(n_high) > sum(n) / 20.0 as err from v_runs group by {KEYS}),
g as (select m as method, cast(f as bigint) as fold, cast(s as bigint) as seed from unnest(['click', 'error', 'signup', 'refund']) as a(m), unnest([1, 2, 3]) as b(f), unnest([42, 123, 2024]) as c(s))
select coalesce(g.method, h.method) as method, coalesce(g.fold, h.fold) as fold, coalesce(g.seed, h.seed) as seed,
  case when h.method is null then 'missing' when g.method is null then 'extra' when h.err then 'error' else 'ok' end as status
from g full join have h on g.method = h.method and g.fold = h.fold and g.seed = h.seed""")
def _(src):
    have = src.run_rows.groupBy(*RUN).agg(F.when(F.sum("n_high") > F.sum("n") / 20.0, "many high values").alias("error"))
    return R.grid_check(have, ["click", "error", "signup", "refund"], [1, 2, 3], [42, 123, 2024])


@query("softmax_argmax", f"""
with e as (select {KEYS}, row_id, exp(w0 / 32.0 - m) as e0, exp(w1 / 32.0 - m) as e1, exp(w2 / 32.0 - m) as e2, exp(w3 / 32.0 - m) as e3, exp(w4 / 32.0 - m) as e4, y_pred
  from (select *, greatest(w0, w1, w2, w3, w4) / 32.0 as m from v_preds))
select {KEYS}, row_id, y_pred as predicted, round(e3 / (e0 + e1 + e2 + e3 + e4), 6) as p3 from e""")
def _(src):
    x = src.preds.withColumn("x", F.array(*[F.col(f"w{c}") / 32.0 for c in range(5)]))
    p = x.withColumn("sm", C.softmax(F.col("x")))
    return p.select(*RUN, "row_id", C.argmax(F.col("sm")).alias("predicted"), F.round(F.get("sm", 3), 6).alias("p3"))


@query("severe_score", f"""
select {KEYS}, row_id, w3 / cast(w0 + w1 + w2 + w3 + w4 as double) + w4 / cast(w0 + w1 + w2 + w3 + w4 as double) as r from v_preds""")
def _(src):
    return src.runs.select(*RUN, "row_id", C.severe_score(F.col("p")).alias("r"))


@query("expected_level", f"""
select {KEYS}, row_id, w1 / s + w2 / s * 2 + w3 / s * 3 + w4 / s * 4 as expected
from (select *, cast(w0 + w1 + w2 + w3 + w4 as double) as s from v_preds)""")
def _(src):
    return src.runs.select(*RUN, "row_id", C.expected_level(F.col("p")).alias("expected"))


@query("label_display", """
select method, case method when 'click' then 'Click (ours)' when 'view' then 'View' else method end as label, cast(sum(n) as bigint) as n from v_runs group by 1, 2""")
def _(src):
    labels = src.spark.sql("select * from values ('click', 'Click (ours)'), ('view', 'View'), ('Z', 'unused') as t(method, label)")
    return R.display_label(src.run_rows.groupBy("method").agg(F.sum("n").alias("n")), labels)


_MIXED = """
with m as (select *, case when fold = 2 and seed = 123 then 'S1' when seed = 123 then 'holdout' else 'test' end as ts,
  case when fold = 2 and seed = 42 then 'drug' else 'pair' end as sp from v_preds)"""


@query("test_set_filter", _MIXED + f"""
select 'pair holdout' as subset, {KEYS}, count(*) as n from m where sp = 'pair' and ts in ('test', 'holdout') group by {KEYS}
union all select 'cold start' as subset, {KEYS}, count(*) as n from m where sp = 'drug' or ts in ('S1', 'S2') group by {KEYS}
union all select 'one run' as subset, {KEYS}, count(*) as n from m where method = 'A' and fold = 1 and seed = 42 group by {KEYS}""")
def _(src):
    m = src.preds.withColumn("test_set", F.when((F.col("fold") == 2) & (F.col("seed") == 123), "S1")
                             .when(F.col("seed") == 123, "holdout").otherwise("test"))
    m = m.withColumn("split", F.when((F.col("fold") == 2) & (F.col("seed") == 42), "drug").otherwise("pair"))
    parts = [("pair holdout", R.pair_holdout(m)), ("cold start", R.cold_start(m)),
             ("one run", R.single_run(m, "A", 1, 42))]
    out = None
    for name, df in parts:
        c = df.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).withColumn("subset", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


@query("run_key_codec", f"""
with r as (select distinct {KEYS}, case method when 'click' then 0 when 'view' then 1 else 2 end as m, case seed when 42 then 0 when 123 then 1 else 2 end as s from v_runs)
select {KEYS}, method || '_f' || fold || '_s' || seed as run_key, method || '_f' || fold || '_s' || seed || '_drug_S1' as drug_key,
  cast(m * 15 + (fold - 1) * 3 + s as bigint) as pair_id, cast(1000 + m * 6 + s * 2 as bigint) as s1_id, cast(1000 + m * 6 + s * 2 + 1 as bigint) as s2_id from r""")
def _(src):
    r = src.run_rows.select(*RUN).distinct()
    m = F.when(F.col("method") == "click", 0).when(F.col("method") == "view", 1).otherwise(2)
    key = (F.col("method"), F.col("fold"), F.col("seed"))
    return r.select(*RUN, R.run_key(*key).alias("run_key"),
                    R.run_key(*key, F.lit("drug"), F.lit("S1")).alias("drug_key"),
                    R.pair_run_id(m, F.col("fold"), F.col("seed")).alias("pair_id"),
                    R.drug_run_id(m, F.col("seed"), F.lit("S1")).alias("s1_id"),
                    R.drug_run_id(m, F.col("seed"), F.lit("S2")).alias("s2_id"))


@query("align_runs", """
select a.fold, a.seed, count(*) as n, count(*) filter (where a.y_true <> case when b.row_id % 41 = 0 then 4 - b.y_true else b.y_true end) as label_conflicts
from v_preds a join v_preds b on a.method = 'A' and b.method = 'B' and a.fold = b.fold and a.seed = b.seed and a.row_id = b.row_id
where b.row_id % 7 <> 0 group by 1, 2""")
def _(src):
    p = src.preds
    b = p.where("method = 'B' and row_id % 7 <> 0").withColumn(
        "y_true", F.when(F.col("row_id") % 41 == 0, 4 - F.col("y_true")).otherwise(F.col("y_true")))
    return R.align_report(R.align(p.where("method = 'A'"), b), ["fold", "seed"])


@query("match_runs", """
with r as (select distinct method, case when split = 'drug' then 0 else fold end as fold, seed, split,
    case when lower(test_set) in ('test', 'holdout') then 'test' else test_set end as test_set from v_runs)
select a.method as method_a, b.method as method_b, a.fold, a.seed, a.split, a.test_set
from r a join r b on a.method = 'error' and b.method <> 'error' and a.fold = b.fold and a.seed = b.seed and a.split = b.split and a.test_set = b.test_set""")
def _(src):
    return R.match_runs(src.run_rows.select(*RUN, "split", "test_set"), "error")


@query("broadcast_single_run", """
select a.fold, a.seed, count(*) as n, count(*) filter (where a.y_pred = b.y_pred) as n_agree
from v_preds a join (select * from v_preds where method = 'B' and seed = 42 and fold = 1) b on a.row_id = b.row_id and a.method = 'A' group by 1, 2""")
def _(src):
    p = src.preds
    al = R.align_single(p.where("method = 'A'"), p.where("method = 'B'"))
    return al.groupBy("fold", "seed").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_if(F.col("pred_a") == F.col("pred_b")).alias("n_agree"))


@query("stable_order", f"""
select {KEYS}, split, test_set, row_number() over (order by split, test_set, case method when 'view' then 0 when 'error' then 1 else 2 end, method, fold, seed) as position from v_runs""")
def _(src):
    return R.stable_order(src.run_rows, ["view", "error"]).select(*RUN, "split", "test_set", "position")


# ---------------------------------------------------------------- hard labels

@query("confusion_counts", f"""
select {KEYS}, y_true, y_pred, count(*) as n, count(*) / cast(sum(count(*)) over (partition by {KEYS}, y_true) as double) as share
from v_preds group by {KEYS}, y_true, y_pred""")
def _(src):
    return M.normalized_cells(M.confusion_cells(src.preds, RUN), RUN)


@query("confusion_weighted", f"""
select {KEYS}, y_true, y_pred, cast(sum(w0) as bigint) as n from v_preds group by {KEYS}, y_true, y_pred""")
def _(src):
    return M.confusion_cells(src.preds, RUN, weight="w0")


@query("accuracy_suite", f"select {KEYS}, accuracy, adjacent_acc, mae_ordinal from v_hard")
def _(src):
    return M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("accuracy", "adjacent_acc", "mae_ordinal"))


@query("f1_suite", f"""
select {KEYS}, round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1 from v_hard""")
def _(src):
    return r6(M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("macro_f1", "weighted_f1")),
              "macro_f1", "weighted_f1")


@query("risk_suite", f"select {KEYS}, high_risk_sens, high_risk_spec, severe_underestimation_rate from v_hard")
def _(src):
    return M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN,
                          ("high_risk_sens", "high_risk_spec", "severe_underestimation_rate"))


@query("qwk", f"""
with o as (select {KEYS}, y_true, y_pred, count(*) as n from v_preds group by 1, 2, 3, 4, 5),
g as (select {KEYS}, i, j from (select distinct {KEYS} from v_preds), unnest([0,1,2,3,4]) as a(i), unnest([0,1,2,3,4]) as b(j)),
t as (select {KEYS}, y_true as i, count(*) as n from v_preds group by 1, 2, 3, 4), u as (select {KEYS}, y_pred as j, count(*) as n from v_preds group by 1, 2, 3, 4),
m as (select g.*, coalesce(o.n, 0) as o, coalesce(t.n, 0) as t, coalesce(u.n, 0) as u, (g.i - g.j) * (g.i - g.j) as w from g
  left join o on g.method = o.method and g.fold = o.fold and g.seed = o.seed and g.i = o.y_true and g.j = o.y_pred
  left join t on g.method = t.method and g.fold = t.fold and g.seed = t.seed and g.i = t.i
  left join u on g.method = u.method and g.fold = u.fold and g.seed = u.seed and g.j = u.j)
select {KEYS}, round(1 - sum(w * o) / (sum(w * t * u) / cast(sum(o) as double)), 6) as qwk from m group by 1, 2, 3""")
def _(src):
    return r6(M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("qwk",)), "qwk")


@query("severity_only_metrics", f"""
with p as (select * from v_preds where y_true >= 1),
c as (select {KEYS}, c, count(*) filter (where y_true = c and y_pred = c) as tp, count(*) filter (where y_true = c) as s, count(*) filter (where y_pred = c) as q
  from p cross join (select unnest([1, 2, 3, 4]) as c) group by 1, 2, 3, 4),
f as (select {KEYS}, avg(case when s + q = 0 then 0 else 2 * tp / cast(s + q as double) end) as f from c group by 1, 2, 3),
k as (select {KEYS}, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (sum(y_true * y_true) + sum(y_pred * y_pred) - 2.0 * sum(y_true) * sum(y_pred) / count(*)) as k from p group by 1, 2, 3)
select {KEYS}, round(f, 6) as macro_f1_sev, round(k, 6) as qwk_sev from f join k using ({KEYS})""")
def _(src):
    return r6(M.severity_metrics(M.confusion_cells(src.preds, RUN), RUN), "macro_f1_sev", "qwk_sev")


@query("per_class_report", f"""
select {KEYS}, cast(c as bigint) as cls, round((n - s - q + 2 * tp) / cast(n as double), 6) as ovr_accuracy,
  round(prec, 6) as precision, round(rec, 6) as recall, round(f1, 6) as f1, s as support from v_class_f1""")
def _(src):
    return r6(M.per_class_report(M.confusion_cells(src.preds, RUN), RUN), "ovr_accuracy", "precision", "recall", "f1")


# --------------------------------------------------------------- score curves

@query("macro_auroc", f"select {KEYS}, round(macro_auroc, 6) as macro_auroc from v_ranking")
def _(src):
    return r6(M.macro_ranking(src.runs_table, RUN).select(*RUN, "macro_auroc"), "macro_auroc")


@query("macro_ap", f"select {KEYS}, round(macro_ap, 6) as macro_ap from v_ranking")
def _(src):
    return r6(M.macro_ranking(src.runs_table, RUN).select(*RUN, "macro_ap"), "macro_ap")


@query("cumulative_counts", f"""
select {KEYS}, cast(c as bigint) as cls, score, pos, neg, cast(tp as bigint) as tp, cast(fp as bigint) as fp,
  cast(n_pos as bigint) as n_pos, cast(n_neg as bigint) as n_neg from v_scores""")
def _(src):
    return M.running_curve(M.class_scores(src.runs_table, RUN), [*RUN, "cls"])


@query("metrics_table", f"""
with f as (select {KEYS}, {', '.join(f"max(case when c = {c} then f1 end) as f1_c{c}" for c in range(5))} from v_class_f1 group by 1, 2, 3)
select {KEYS}, n_eval, {sel6(METRIC_NAMES)}, {sel6([f'f1_c{c}' for c in range(5)])}, {sel6(['macro_auroc', 'macro_ap'])}
from v_hard join f using ({KEYS}) join v_ranking using ({KEYS})""")
def _(src):
    t = M.metrics_table(src.runs_table, RUN)
    return r6(t, *METRIC_NAMES, *[f"f1_c{c}" for c in range(5)], "macro_auroc", "macro_ap")


@query("metric_by_name", f"""
with o as (select *, s as pos, n - s as neg, q - tp as fp from v_class where s > 0),
k as (select {KEYS}, avg((tp * (neg - fp) + 0.5::double * (tp * fp + (pos - tp) * (neg - fp))) / (pos * neg)) as macro_auroc,
  avg((case when q = 0 then 0 else tp * (tp / cast(q as double)) end + (pos - tp) * (pos / cast(n as double))) / pos) as macro_ap from o group by {KEYS})
select {KEYS}, 'qwk' as metric, round(qwk, 6) as value from v_hard union all select {KEYS}, 'macro_f1' as metric, round(macro_f1, 6) as value from v_hard
union all select {KEYS}, 'macro_auroc' as metric, round(macro_auroc, 6) as value from k union all select {KEYS}, 'macro_ap' as metric, round(macro_ap, 6) as value from k""")
def _(src):
    rows = src.preds.select(*RUN, "y_true", "y_pred")
    t = M.hard_metrics(M.confusion_cells(rows, RUN), RUN)
    out = None
    for name in ("kappa", "macro_f1", "macro_auroc", "macro_ap"):
        m = M.metric_by_name(t, RUN, name, rows)
        out = m if out is None else out.unionByName(m)
    return r6(out, "value")


_POINTS = ", ".join(f"('t = {t:g}', {t})" for t in (0.5, 0.3, 0.2, 0.1, 0.05))
_OPER = f"""
with t as (select * from (values {_POINTS}, ('argmax', null)) as v(point, t)),
c as (select {KEYS}, point, count(*) filter (where y_true >= 3 and case when t is null then y_pred >= 3 else r >= t end) / cast(count(*) filter (where y_true >= 3) as double) as ht_sens,
  count(*) filter (where y_true in (1, 2) and case when t is null then y_pred >= 3 else r >= t end) / cast(count(*) filter (where y_true in (1, 2)) as double) as false_high
  from v_preds cross join t group by 1, 2, 3, 4)"""


@query("operating_curve", _OPER + f" select {KEYS}, point, ht_sens, false_high from c")
def _(src):
    return M.operating_curve(src.preds, RUN)


@query("operating_curve_summary", _OPER + """
select method, point, count(*) as n_runs, round(avg(ht_sens), 6) as ht_sens_mean, round(stddev_pop(ht_sens), 6) as ht_sens_sd,
  round(avg(false_high), 6) as false_high_mean, round(stddev_pop(false_high), 6) as false_high_sd from c group by 1, 2""")
def _(src):
    return r6(M.curve_summary(M.operating_curve(src.preds, RUN)),
              "ht_sens_mean", "ht_sens_sd", "false_high_mean", "false_high_sd")


_MEAN = "select method, metric, avg(value) as mean, stddev_pop(value) as sd, count(value) as n_runs from v_long group by 1, 2"


@query("mean_sd", f"select method, metric, round(mean, 6) as mean, round(sd, 6) as sd, n_runs from ({_MEAN})")
def _(src):
    return r6(M.mean_sd(hard_long(src), ["method"]), "mean", "sd")


@query("best_flag", f"""
with m as ({_MEAN}), v as (select *, case when metric in ('severe_underestimation_rate', 'mae_ordinal') then -mean else mean end as v from m)
select method, metric, round(mean, 6) as mean, abs(v - max(v) over (partition by metric)) <= 1e-12 as is_best from v""")
def _(src):
    return r6(M.best_flag(M.mean_sd(hard_long(src), ["method"])), "mean").drop("sd", "n_runs")


@query("coldstart_wide", """
with l as (select *, case when fold = 1 then 'S1' else 'S2' end as test_set from v_long)
select method, metric, """ + ", ".join(
    f"round(avg(value) filter (where test_set = '{t}'), 6) as {t}_mean, round(stddev_pop(value) filter (where test_set = '{t}'), 6) as {t}_sd, "
    f"count(value) filter (where test_set = '{t}') as {t}_n" for t in ("S1", "S2")) + " from l group by 1, 2")
def _(src):
    l = hard_long(src).withColumn("test_set", F.when(F.col("fold") == 1, "S1").otherwise("S2"))
    return r6(M.coldstart_wide(l), "S1_mean", "S1_sd", "S2_mean", "S2_sd")


@query("representative_run", f"""
with m as (select method, median(macro_f1) as med from v_hard group by 1),
r as (select h.*, row_number() over (partition by h.method order by round(abs(macro_f1 - med), 12), fold, seed) as rn from v_hard h join m on h.method = m.method)
select {KEYS}, round(macro_f1, 6) as macro_f1 from r where rn = 1""")
def _(src):
    t = M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("macro_f1",))
    return r6(M.representative_run(t), "macro_f1").drop("median")


@query("roc_pr_curve_grid", f"""
with k as (select * from v_scores where n_pos > 0 and n_neg > 0),
pts as (
  select {KEYS}, c, 'roc' as curve, fp * 100.0::double / n_neg as x, tp / n_pos::double as y, fp as o1, tp as o2 from k
  union all select distinct {KEYS}, c, 'roc', 0.0::double, 0.0::double, 0, 0 from k
  union all select {KEYS}, c, 'pr', tp * 100.0::double / n_pos, tp / (tp + fp)::double, tp, fp from k
  union all select distinct {KEYS}, c, 'pr', 0.0::double, 1.0::double, 0, 0 from k),
cell as (select {KEYS}, c, curve, ceil(x) as g, max({{'o1': o1, 'o2': o2, 'x': x, 'y': y}}) as hi, min({{'o1': o1, 'o2': o2, 'x': x, 'y': y}}) as lo from pts group by 1, 2, 3, 4, 5, 6),
grid as (select distinct {KEYS}, c, curve, unnest(range(101)) as g from pts),
lr as (select g.*, max(cell.hi) filter (where cell.g <= g.g) as l, min(cell.lo) filter (where cell.g > g.g) as r from grid g
  join cell on g.method = cell.method and g.fold = cell.fold and g.seed = cell.seed and g.c = cell.c and g.curve = cell.curve group by g.method, g.fold, g.seed, g.c, g.curve, g.g),
v as (select {KEYS}, c, curve, g, case when curve = 'roc' and g = 0 then 0.0::double when curve = 'roc' and g = 100 then 1.0::double
  when r is null or l.x = g then l.y else l.y + (r.y - l.y) / (r.x - l.x) * (g - l.x) end as value from lr)
select {KEYS}, curve, cast(g as bigint) as g, round(avg(value), 6) as value from v group by 1, 2, 3, 4, 5""")
def _(src):
    return r6(M.roc_pr_grid(src.runs_table, RUN), "value")


# ------------------------------------------------------------ weights, losses

@query("class_weights", """
with c as (select y, count(*) as n from v_pairs group by y), t as (select sum(n) as n, count(*) as k from c)
select y, 'present' as k_mode, round(t.n / cast(t.k * c.n as double), 6) as weight from c cross join t
union all
select y, 'fixed' as k_mode, round(sum(n) over () / cast(5 * n as double), 6) as weight from (
  select cast(g.y as bigint) as y, greatest(coalesce(c.n, 0), 1) as n from (select unnest([0, 1, 2, 3, 4]) as y) g left join c on g.y = c.y)""")
def _(src):
    pairs = src.pairs
    a = M.class_weights(pairs, "y").withColumn("k_mode", F.lit("present"))
    b = M.class_weights(pairs, "y", fixed_classes=5).withColumn("k_mode", F.lit("fixed"))
    return r6(a.unionByName(b), "weight")


@query("log_loss_weighted", f"""
with c as (select y_true as y, count(*) as n from v_preds where method = 'A' and fold = 1 and seed = 42 group by 1),
w as (select y, sum(n) over () / cast(count(*) over () * n as double) as w from c),
l as (select {KEYS}, y_true, [-ln(w0 / s), -ln(w1 / s), -ln(w2 / s), -ln(w3 / s), -ln(w4 / s)] as nl from (select *, cast(w0 + w1 + w2 + w3 + w4 as double) as s from v_preds)),
e as (select l.*, w.w as wy, nl[y_true + 1] as nll, (select sum(w.w * nl[w.y + 1]) from w) as every from l join w on l.y_true = w.y),
f as (select *, 0.9 * nll * wy + 0.1 / 5 * every as ce from e)
select {KEYS}, round(sum(wy * nll) / sum(wy), 6) as cross_entropy, round(sum(pow(1 - exp(-ce), 2) * ce * wy) / sum(wy), 6) as focal_loss from f group by 1, 2, 3""")
def _(src):
    w = M.class_weights(src.preds.where("method = 'A' and fold = 1 and seed = 42"), "y_true")
    return r6(M.log_loss(src.runs, w, RUN), "cross_entropy", "focal_loss")


@query("best_config", """
select method, fold, seed, round(macro_f1, 6) as macro_f1 from (
  select *, row_number() over (partition by method order by macro_f1 desc, fold desc, seed desc) as rn from v_hard where not (fold = 1 and seed = 42)) where rn = 1""")
def _(src):
    t = M.hard_metrics(M.confusion_cells(src.preds, RUN), RUN, ("macro_f1",))
    t = t.withColumn("error", F.when((F.col("fold") == 1) & (F.col("seed") == 42), "out of memory"))
    return r6(R.best_config(t, ["method"], "macro_f1"), "macro_f1")


@query("exact_percentile", f"""
select {KEYS}, round(quantile_cont(r, 0.025), 6) as p_low, round(quantile_cont(r, 0.5), 6) as p_mid, round(quantile_cont(r, 0.975), 6) as p_high
from v_preds group by 1, 2, 3""")
def _(src):
    from pairgrade.functions.ordering import exact_quantile, unit_bucket
    q = exact_quantile(src.preds, RUN, "r", unit_bucket("r"), [0.025, 0.5, 0.975], ["p_low", "p_mid", "p_high"])
    return r6(q, "p_low", "p_mid", "p_high")


@query("rank_average", f"""
with c as (select {KEYS}, w0, count(*) as n from v_preds group by 1, 2, 3, 4)
select {KEYS}, w0, n, cast(sum(n) over (partition by {KEYS} order by w0) - (n - 1) / 2.0 as double) as rank from c""")
def _(src):
    from pairgrade.functions.ordering import width_bucket
    c = src.preds.groupBy(*RUN, "w0").agg(F.count(F.lit(1)).alias("n"))
    return M.average_ranks(c, RUN, "w0", width_bucket("w0", 16))


@query("topk_rows", f"select {KEYS}, row_id, r from v_preds order by r desc, method, fold, seed, row_id limit 20")
def _(src):
    rows = src.preds.select(*RUN, "row_id", "r")
    return M.topk_rows(rows, [F.col("r").desc(), *[F.col(c) for c in (*RUN, "row_id")]])
