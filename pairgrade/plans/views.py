"""Stand-in views over the test tables, as SQL both engines read.

Parts play entities, suppliers their attributes, the return flag the action,
line items the interactions, events the predicted rows and users the clusters.
Every view is linear in its base table: no self join.
"""

_HEX = "0123456789abcdef"


def _nib(expr: str, k: int) -> str:
    """Value 0..15 of the k-th hex digit."""
    return f"(instr('{_HEX}', substr({expr}, {k}, 1)) - 1)"


_ENT = "concat('E', lpad(cast({0} as string), 7, '0'))"
_DIR = "md5(concat_ws('|', a, b))"
_UND = "md5(concat_ws('|', least(a, b), greatest(a, b)))"
_WH = "h"


def _weight(c: int) -> str:
    return (f"cast(1 + 16 * {_nib(_WH, 2 * c + 1)} + {_nib(_WH, 2 * c + 2)}"
            f" + case when y_true = {c} then bonus else 0 end as bigint)")


WEIGHTS = {f"w{c}": _weight(c) for c in range(5)}
PRED_Y = "cast(event_id * 7 + user_id * 3 as bigint) % 5"
PRED_HASH = "md5(concat_ws('|', method, cast(fold as string), cast(seed as string), cast(row_id as string)))"
PRED_ARGMAX = ("cast(case greatest(w0, w1, w2, w3, w4) when w0 then 0 when w1 then 1 "
               "when w2 then 2 when w3 then 3 else 4 end as bigint)")
PRED_R = "cast(w3 + w4 as double) / cast(w0 + w1 + w2 + w3 + w4 as double)"
RUNS = [(m, bonus, f, s) for m, bonus in (("A", 160), ("B", 120)) for f in (1, 2) for s in (42, 123)]
PHRASES = [("alpha overload", 4), ("beta drift", 3), ("gamma rash", 2), ("delta drop", 2),
           ("alpha overload and beta drift", 4)]

VIEWS: dict[str, str] = {}

VIEWS["v_phrase_tier"] = (
    "select phrase, cast(tier as bigint) as tier from (values "
    + ", ".join(f"('{p}', {t})" for p, t in PHRASES) + ") as t(phrase, tier)")

_PAIR_ENDS = f"""with li as (select l_partkey as x, (l_partkey * 7 + l_suppkey * 37 + l_orderkey * 11) % (select count(*) from part) as y from lineitem),
en as (select {_ENT.format('x')} as a, {_ENT.format('y')} as b from li where x <> y)"""
_PAIR_TEXTS = f"""h as (select a, b, 16 * {_nib(_DIR, 1)} + {_nib(_DIR, 2)} as d, {_nib(_UND, 3)} as e from pr)
select a as id1, b as id2, md5(concat_ws('|', 'pos', a, b)) as ingest_pos,
  case when e = 0 then '   ' when e = 1 then concat('The risk or severity of ADVERSE effects can be increased when ', a, ' is combined with ', b, '.')
       when e in (2, 3, 4) then concat('The metabolism of ', a, ' can be decreased when combined with ', b, '.')
       when e = 5 then concat('The risk or severity of unlisted harm can be increased when ', a, ' is combined with ', b, '.')
       when e = 6 then concat('The risk or severity of alpha overload may rise with ', b, '.')
       when d % 8 = 0 then concat('The risk or severity of Alpha Overload and beta drift can be increased with ', b, '.')
       when e in (7, 8, 9) then concat('the risk or severity of  Gamma rash  can be increased with ', b, '.')
       when e = 12 and d % 8 = 1 then '\u00a0\u2003 '
       when e = 12 then concat('The risk or severity of ', '\u00a0', 'Alpha Overload', '\u2003', ' can be increased with ', b, '.')
       when e in (10, 11) then concat('The Risk or severity of beta drift can be increased with ', b, '.')
       else concat('The risk or severity of delta drop can be increased with ', b, '.') end as description
from h"""

VIEWS["v_pair_events"] = f"""
{_PAIR_ENDS},
pr as (select a, b from en union select b as a, a as b from en),
{_PAIR_TEXTS}"""

# The same rows as steps: unordered pairs once, then the events of both directions with their pair.
UNORDERED_PAIRS = f"{_PAIR_ENDS} select distinct least(a, b) as pair_a, greatest(a, b) as pair_b from en"
DIRECTED_EVENTS = f"with {_PAIR_TEXTS}".replace("select a, b, 16", "select pair_a, pair_b, a, b, 16").replace("select a as id1", "select pair_a, pair_b, a as id1").replace("from pr", "from {pr}")

VIEWS["v_attrs"] = f"""
select distinct {_ENT.format('l_partkey')} as entity_id,
  case l_linenumber % 3 when 0 then 'enzyme' when 1 then 'transporter' else 'target' end as kind,
  case when l_suppkey % 16 = 3 then 'MDR1' when l_suppkey % 16 = 5 then 'P-glycoprotein 1' when l_suppkey % 16 = 7 then 'OATP1B1'
       when l_suppkey % 2 = 0 then concat('Cytochrome P450 ', cast(l_suppkey as string)) else concat('Protein ', cast(l_suppkey as string)) end as name,
  case when l_linenumber = 7 then null when l_linenumber % 3 = 2 then (case l_returnflag when 'A' then 'agonist' when 'N' then 'antagonist' else 'inhibitor' end)
       when l_linenumber = 4 and l_suppkey % 5 = 0 then 'carrier'
       else (case l_returnflag when 'A' then 'substrate' when 'N' then 'inhibitor' else 'inducer' end) end as action
from lineitem"""

_BITKEY = "md5(concat_ws('|', cast(l_suppkey % 25 as string), l_returnflag))"
VIEWS["v_bits"] = f"""
select distinct {_ENT.format('l_partkey')} as entity_id,
  cast((256 * {_nib(_BITKEY, 1)} + 16 * {_nib(_BITKEY, 2)} + {_nib(_BITKEY, 3)}) % 2048 as bigint) as bit
from lineitem"""

_RUN_VALUES = ", ".join(f"('{m}', {b}, {f}, {s})" for m, b, f, s in RUNS)
VIEWS["v_preds"] = f"""
with base as (select event_id as row_id, user_id as cluster_id, {PRED_Y} as y_true from events),
runs as (select * from (values {_RUN_VALUES}) as t(method, bonus, fold, seed)),
w as (select method, fold, seed, row_id, cluster_id, y_true, bonus, {PRED_HASH} as h from base cross join runs),
v as (select method, fold, seed, row_id, cluster_id, y_true, {", ".join(f"{e} as {n}" for n, e in WEIGHTS.items())} from w)
select method, cast(fold as bigint) as fold, cast(seed as bigint) as seed, 'pair' as split, 'test' as test_set, row_id, cluster_id, y_true,
  {PRED_ARGMAX} as y_pred, w0, w1, w2, w3, w4, {PRED_R} as r
from v"""

# One row for each prediction run, as facts of the events: the kind of event is the method, users and days deal the
# rows to folds and seeds, and what is missing, repeated or failed is so in the table.
VIEWS["v_runs"] = """
select event_type as method, cast(user_id % 3 + 1 as bigint) as fold,
  cast(case event_id % 3 when 0 then 42 when 1 then 123 else 2024 end as bigint) as seed,
  case when user_id % 7 = 0 then 'drug' else 'pair' end as split,
  case when user_id % 7 = 0 then 'S1' when user_id % 5 = 0 then 'holdout' else 'test' end as test_set,
  count(*) as n, cast(sum(case when value > 95 then 1 else 0 end) as bigint) as n_high
from events where event_type <> 'error' or event_id % 3 < 2 group by 1, 2, 3, 4, 5"""

VIEWS["v_ext"] = f"""
select d.doc_id as row_id, d.lang, case when l.doc_id is null then 'Unknown' when l.toxic = 1 then 'Major' when l.quality = 0 then 'Moderate' else 'Minor' end as ext_level,
  cast({_nib("md5(concat_ws('|', 'ext', cast(d.doc_id as string)))", 1)} % 5 as bigint) as y_pred,
  cast({_nib("md5(concat_ws('|', 'ext', cast(d.doc_id as string)))", 2)} as bigint) as hx
from documents d left join labels l on d.doc_id = l.doc_id"""

VIEWS["v_names"] = f"""
select {_ENT.format('p_partkey')} as entity_id, concat(p_name, ' ', cast(p_size as string)) as primary_name,
  concat(upper(p_name), '-', p_brand, '/', p_type, ' ', cast(p_partkey as string)) as alias
from part"""

# Oracle-side only: labelled events and the deduplicated, graded pair table.
VIEWS["v_labelled"] = r"""
with x as (select id1, id2, ingest_pos, description,
    regexp_extract(description, 'the risk or severity of (.+?) can be', 1, 'i') as ph from v_pair_events),
y as (select x.*, lower(regexp_replace(ph, '^[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')) as phrase from x)
select y.id1, y.id2, y.ingest_pos, y.description,
  cast(case when regexp_replace(y.description, '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g') = '' then 1
       when regexp_matches(y.description, 'the risk or severity of adverse (effects|events)', 'i') then 1
       when not regexp_matches(y.description, 'the risk or severity of', 'i') then 1
       else coalesce(p.tier, 3) end as bigint) as tier
from y left join v_phrase_tier p on y.ph <> '' and y.phrase = p.phrase"""

VIEWS["v_pairs"] = """
select a, b, y from (
  select least(id1, id2) as a, greatest(id1, id2) as b, tier as y,
    row_number() over (partition by least(id1, id2), greatest(id1, id2) order by ingest_pos) as rn
  from v_labelled) where rn = 1"""

VIEWS["v_entities"] = f"select {_ENT.format('p_partkey')} as entity_id, p_name as name from part"

# Messy long attributes (case, blanks, missing) for the ingest aggregation.
VIEWS["v_raw_attrs"] = f"""
select {_ENT.format('l_partkey')} as entity_id,
  case l_linenumber % 3 when 0 then 'enzyme' when 1 then 'transporter' else 'target' end as kind,
  case when l_suppkey % 11 = 0 then null when l_suppkey % 11 = 1 then '  ' else concat(' Protein ', cast(l_suppkey % 40 as string), ' ') end as name,
  case when l_linenumber = 7 then null when l_linenumber = 6 then ' ' when l_returnflag = 'A' then ' Substrate' when l_returnflag = 'N' then 'INHIBITOR ' else 'inducer' end as action
from lineitem"""

# Oracle-side only: decoded attributes, per-entity sets, fingerprints.
VIEWS["v_attr_enc"] = """
with g as (select entity_id, kind, name, list_sort(list(distinct action) filter (where action is not null)) as acts from v_attrs group by 1, 2, 3)
select entity_id, kind, string_agg(case when acts is null or len(acts) = 0 then name else name || ':' || array_to_string(acts, ',') end, '|' order by name) as encoded
from g group by 1, 2"""


def _set(cond: str, name: str) -> str:
    return f"coalesce(list_sort(list(distinct name) filter (where {cond})), []) as {name}"


_SET_COLS = []
for _k, _acts in (("enzyme", ("substrate", "inhibitor", "inducer")),
                  ("transporter", ("substrate", "inhibitor", "inducer")),
                  ("target", ("agonist", "antagonist", "inhibitor"))):
    for _a in _acts:
        _SET_COLS.append(_set(f"kind = '{_k}' and action = '{_a}'", f"{_k}_{_a}"))
    _SET_COLS.append(_set(f"kind = '{_k}'", f"{_k}_all"))
for _w in ("substrate", "inhibitor", "inducer"):
    _SET_COLS.append(_set(f"kind = 'enzyme' and name like 'Cytochrome P450%' and action = '{_w}'", f"cyp_{_w}"))
_SET_COLS.append(_set("kind = 'enzyme' and name like 'Cytochrome P450%'", "cyp_all"))
VIEWS["v_sets"] = f"select entity_id, {', '.join(_SET_COLS)} from v_attrs group by entity_id"
VIEWS["v_fp"] = "select entity_id, list_sort(list(distinct bit)) as bits from v_bits group by entity_id"


def _quota(src: str, take: str) -> str:
    """Largest-remainder quotas per class over ``src(y)``; ``take`` uses n_all."""
    return f"""
with c as (select y, count(*) as n from {src} group by y),
t as (select y, n, sum(n) over () as n_all from c),
u as (select y, n, n_all, cast({take} as bigint) as take from t),
q as (select y, n, n_all, take, (n * take) // n_all as base, (n * take) % n_all as rem from u),
r as (select *, row_number() over (order by rem desc, y) as k, take - sum(base) over () as short from q)
select y, n, cast(base + case when k <= short then 1 else 0 end as bigint) as quota from r"""


VIEWS["v_quota20"] = _quota("v_pairs", "(n_all + 4) // 5")


def _sealed(rows: str, quota: str) -> str:
    return f"""
with q as (select *, coalesce(sum(n - quota) over (order by y rows between unbounded preceding and 1 preceding), 0) as before from {quota}),
r as (select p.a, p.b, p.y, row_number() over (partition by p.y order by md5(concat_ws('|', '42', p.a, p.b)), p.a, p.b) as rn from {rows} p)
select r.a, r.b, r.y, cast(case when rn <= quota then 1 else 0 end as bigint) as sealed_test,
  cast(case when rn <= quota then -1 else (rn - quota - 1 + before) % 5 + 1 end as bigint) as fold
from r join q on r.y = q.y"""


VIEWS["v_sealed"] = _sealed("v_pairs", "v_quota20")
VIEWS["v_universe"] = "select a as entity_id from v_pairs union select b as entity_id from v_pairs"
VIEWS["v_held"] = """
with s as (select unnest([42, 123, 2024]) as seed),
r as (select s.seed, u.entity_id, row_number() over (partition by s.seed order by md5(concat_ws('|', cast(s.seed as string), u.entity_id)), u.entity_id) as rn,
  count(*) over (partition by s.seed) as n from s, v_universe u)
select cast(seed as bigint) as seed, entity_id, rn <= (2 * n + 5) // 10 as held_out from r"""
VIEWS["v_cold"] = """
select s.seed, p.a, p.b, p.y, case when x.held_out and z.held_out then 'S2' when x.held_out or z.held_out then 'S1' else 'KK' end as part
from v_pairs p join v_held x on p.a = x.entity_id join v_held z on p.b = z.entity_id and x.seed = z.seed
join (select distinct seed from v_held) s on s.seed = x.seed"""

# Oracle-side only: row-level formulations of the metrics.
_RUN = "method, fold, seed"
VIEWS["v_class"] = f"""
select {_RUN}, c, count(*) filter (where y_true = c and y_pred = c) as tp, count(*) filter (where y_true = c) as s,
  count(*) filter (where y_pred = c) as q, count(*) as n
from v_preds cross join (select unnest([0, 1, 2, 3, 4]) as c) group by 1, 2, 3, 4"""
VIEWS["v_class_f1"] = f"""
select *, case when s + q = 0 then 0.0::double else 2 * tp / cast(s + q as double) end as f1,
  case when q = 0 then 0.0::double else tp / cast(q as double) end as prec, case when s = 0 then 0.0::double else tp / cast(s as double) end as rec from v_class"""
VIEWS["v_hard"] = f"""
with a as (select {_RUN}, count(*) as n_eval, count(*) filter (where y_true = y_pred) / cast(count(*) as double) as accuracy,
    count(*) filter (where abs(y_true - y_pred) <= 1) / cast(count(*) as double) as adjacent_acc,
    cast(sum(abs(y_true - y_pred)) as bigint) / cast(count(*) as double) as mae_ordinal,
    count(*) filter (where y_true >= 3 and y_pred >= 3) / cast(count(*) filter (where y_true >= 3) as double) as high_risk_sens,
    count(*) filter (where y_true < 3 and y_pred < 3) / cast(count(*) filter (where y_true < 3) as double) as high_risk_spec,
    count(*) filter (where y_true >= 3 and y_pred <= 1) / cast(count(*) filter (where y_true >= 3) as double) as severe_underestimation_rate,
    1 - sum((y_true - y_pred) * (y_true - y_pred)) / (sum(y_true * y_true) + sum(y_pred * y_pred) - 2.0 * sum(y_true) * sum(y_pred) / count(*)) as qwk
  from v_preds group by 1, 2, 3),
f as (select {_RUN}, avg(f1) as macro_f1, sum(f1 * s) / sum(s) as weighted_f1 from v_class_f1 group by 1, 2, 3)
select * from a join f using ({_RUN})"""
VIEWS["v_scores"] = f"""
with x as (select {_RUN}, c, y_true = c as hit, (case c when 0 then w0 when 1 then w1 when 2 then w2 when 3 then w3 else w4 end) / cast(w0 + w1 + w2 + w3 + w4 as double) as score
  from v_preds cross join (select unnest([0, 1, 2, 3, 4]) as c)),
g as (select {_RUN}, c, score, count(*) filter (where hit) as pos, count(*) filter (where not hit) as neg from x group by 1, 2, 3, 4, 5)
select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over v as n_pos, sum(neg) over v as n_neg from g
window w as (partition by {_RUN}, c order by score desc), v as (partition by {_RUN}, c)"""
VIEWS["v_ranking"] = f"""
with k as (select {_RUN}, c, sum(neg * (tp - pos / 2.0)) / (max(n_pos) * max(n_neg)) as auroc,
  sum(pos * (tp / cast(tp + fp as double))) / max(n_pos) as ap from v_scores group by 1, 2, 3, 4)
select {_RUN}, avg(auroc) as macro_auroc, avg(ap) as macro_ap from k group by 1, 2, 3"""
METRIC_NAMES = ["accuracy", "macro_f1", "weighted_f1", "adjacent_acc", "high_risk_sens", "high_risk_spec",
                "severe_underestimation_rate", "qwk", "mae_ordinal"]
VIEWS["v_long"] = " union all ".join(
    f"select {_RUN}, '{m}' as metric, {m} as value from v_hard" for m in METRIC_NAMES)

# Resampling and referral (oracle side).
N_BOOT_HASH, N_BOOT_LISTED = 1000, 20
VIEWS["v_aligned"] = """
select a.fold, a.seed, a.row_id, a.y_true, a.y_pred as pred_a, b.y_pred as pred_b
from v_preds a join v_preds b on a.method = 'A' and b.method = 'B' and a.fold = b.fold and a.seed = b.seed and a.row_id = b.row_id"""
VIEWS["v_pos"] = """
select event_id as row_id, row_number() over (order by md5(cast(event_id as string)), event_id) - 1 as pos, count(*) over () as n from events"""
VIEWS["v_draws"] = f"""
select rep, pos as i, cast('0x' || substr(sha256('0|' || rep || '|' || pos), 1, 15) as bigint) % n as pos
from v_pos, unnest(range({N_BOOT_HASH})) as r(rep)"""


def _cell_metrics(src: str, keys: str) -> str:
    """Metrics of both sides from weighted rows ``src(keys, y_true, side, p, n)``."""
    return f"""
with s as ({src}),
c as (select {keys}, side, c, coalesce(sum(n) filter (where y_true = c and p = c), 0) as tp, coalesce(sum(n) filter (where y_true = c), 0) as s, coalesce(sum(n) filter (where p = c), 0) as q,
  coalesce(sum(n) filter (where y_true >= 1 and p = c), 0) as qs
  from s cross join (select unnest([0, 1, 2, 3, 4]) as c) group by {keys}, side, c),
f as (select {keys}, side, avg(case when s + q = 0 then 0 else 2 * tp / cast(s + q as double) end) as macro_f1,
  avg(case when s + qs = 0 then 0 else 2 * tp / cast(s + qs as double) end) filter (where c >= 1) as macro_f1_sev from c group by {keys}, side),
h as (select {keys}, side, sum(n) filter (where y_true = p) / cast(sum(n) as double) as accuracy,
  1 - sum(n * (y_true - p) * (y_true - p)) / (sum(n * y_true * y_true) + sum(n * p * p) - 2.0 * sum(n * y_true) * sum(n * p) / sum(n)) as qwk,
  1 - sum(n * (y_true - p) * (y_true - p)) filter (where y_true >= 1) / (sum(n * y_true * y_true) filter (where y_true >= 1) + sum(n * p * p) filter (where y_true >= 1)
    - 2.0 * sum(n * y_true) filter (where y_true >= 1) * sum(n * p) filter (where y_true >= 1) / sum(n) filter (where y_true >= 1)) as qwk_sev,
  sum(n) filter (where y_true >= 3 and p >= 3) / cast(sum(n) filter (where y_true >= 3) as double) as high_risk_sens,
  sum(n * abs(y_true - p)) / cast(sum(n) as double) as mae_ordinal from s group by {keys}, side),
m as (select * from f join h using ({keys}, side)),
l as (unpivot m on macro_f1, accuracy, qwk, high_risk_sens, mae_ordinal, macro_f1_sev, qwk_sev into name metric value value)
select {keys}, metric, max(case when side = 'a' then value end) as value_a, max(case when side = 'b' then value end) as value_b,
  max(case when side = 'a' then value end) - max(case when side = 'b' then value end) as delta from l group by {keys}, metric"""


def _sides(src: str, keys: str, n: str) -> str:
    return (f"select {keys}, 'a' as side, y_true, pred_a as p, {n} as n from {src} union all "
            f"select {keys}, 'b' as side, y_true, pred_b as p, {n} as n from {src}")


VIEWS["v_point"] = _cell_metrics(_sides("v_aligned", "fold, seed", "1"), "fold, seed")
VIEWS["v_resampled"] = """
select a.fold, a.seed, m.rep, a.y_true, a.pred_a, a.pred_b, sum(m.m) as m from v_aligned a
join (select p.row_id, d.rep, count(*) as m from v_draws d join v_pos p on d.pos = p.pos group by 1, 2) m on a.row_id = m.row_id
group by 1, 2, 3, 4, 5, 6"""
VIEWS["v_boot"] = _cell_metrics(_sides("v_resampled", "fold, seed, rep", "m"), "fold, seed, rep")
VIEWS["v_ci"] = """
select fold, seed, metric, count(delta) as n_finite, quantile_cont(delta, 0.025) as ci_low, quantile_cont(delta, 0.975) as ci_high,
  avg(cast(delta <= 0 as int)) as share_not_above_0 from v_boot group by 1, 2, 3"""
VIEWS["v_boot_detail"] = """
select 'A' as method_a, 'B' as method_b, p.fold, p.seed, p.metric, p.value_a, p.value_b, p.delta, c.n_finite, c.ci_low, c.ci_high,
  c.ci_low > 0 or c.ci_high < 0 as excludes_zero from v_point p join v_ci c using (fold, seed, metric)"""

_PAIR_B = "(row_id * 7 + 3) % (select count(distinct user_id) from events)"
VIEWS["v_cluster_rows"] = f"""
select fold, seed, e.user_id as a, (row_id * 7 + 3) % (select count(distinct user_id) from events) as b, y_true, pred_a, pred_b
from v_aligned join events e on e.event_id = row_id where y_true >= 1"""
VIEWS["v_cluster_pos"] = """
with u as (select a as entity_id from v_cluster_rows union select b as entity_id from v_cluster_rows)
select entity_id, row_number() over (order by md5(cast(entity_id as string)), entity_id) - 1 as pos, count(*) over () as n from u"""
VIEWS["v_cluster_mult"] = f"""
with d as (select rep, cast('0x' || substr(sha256('0|' || rep || '|' || pos), 1, 15) as bigint) % n as pos from v_cluster_pos, unnest(range({N_BOOT_HASH})) as r(rep))
select d.rep, p.entity_id, count(*) as m from d join v_cluster_pos p on d.pos = p.pos group by 1, 2"""
VIEWS["v_cluster_resampled"] = """
select r.fold, r.seed, x.rep, r.y_true, r.pred_a, r.pred_b, sum(x.m * z.m) as m from v_cluster_rows r
join v_cluster_mult x on r.a = x.entity_id join v_cluster_mult z on r.b = z.entity_id and x.rep = z.rep group by 1, 2, 3, 4, 5, 6"""
VIEWS["v_cluster_boot"] = _cell_metrics(_sides("v_cluster_resampled", "fold, seed, rep", "m"), "fold, seed, rep")
VIEWS["v_cluster_point"] = _cell_metrics(_sides("v_cluster_rows", "fold, seed", "1"), "fold, seed")

N_REPS = 100
BUDGET_VALUES = "(0, 1, 200, 0.005::double), (1, 1, 100, 0.01::double), (2, 1, 50, 0.02::double), (3, 1, 20, 0.05::double)"
VIEWS["v_budget"] = f"select * from (values {BUDGET_VALUES}) as t(level, num, den, budget)"
VIEWS["v_half"] = f"""
select *, rn <= n // 2 as is_cal from (
  select method, fold, seed, rep, row_id, y_true, y_pred, r, row_number() over (partition by method, fold, seed, rep
    order by md5(concat_ws('|', method, cast(fold as string), cast(seed as string), cast(rep as string), cast(row_id as string))), row_id) as rn,
    count(*) over (partition by method, fold, seed, rep) as n
  from v_preds, unnest(range({N_REPS})) as u(rep))"""
VIEWS["v_cold_rows"] = f"""
select method, fold, seed, case when row_id % 3 = 0 then 'S2' else 'S1' end as part, row_id, cluster_id as u1,
  case when row_id % 3 = 0 then {_PAIR_B} end as u2, y_true, y_pred, r from v_preds"""
VIEWS["v_cold_half"] = f"""
with u as (select method, fold, seed, part, u1 as entity_id from v_cold_rows union select method, fold, seed, part, u2 from v_cold_rows where u2 is not null),
k as (select method, fold, seed, part, rep, entity_id, row_number() over (partition by method, fold, seed, part, rep
    order by md5(concat_ws('|', method, cast(fold as string), cast(seed as string), part, cast(rep as string), cast(entity_id as string))), entity_id) as rn,
  count(*) over (partition by method, fold, seed, part, rep) as n from u, unnest(range({N_REPS})) as t(rep))
select method, fold, seed, part, rep, entity_id, rn <= n // 2 as in_a from k"""
VIEWS["v_cold_assigned"] = """
select r.*, h.rep, case when h.in_a and coalesce(g.in_a, h.in_a) then 'cal' when not h.in_a and not coalesce(g.in_a, h.in_a) then 'eval' else 'mixed' end as side
from v_cold_rows r join v_cold_half h on r.method = h.method and r.fold = h.fold and r.seed = h.seed and r.part = h.part and r.u1 = h.entity_id
left join v_cold_half g on r.method = g.method and r.fold = g.fold and r.seed = g.seed and r.part = g.part and h.rep = g.rep and r.u2 = g.entity_id
where r.u2 is null or g.entity_id is not null"""


def _mondrian(src: str, keys: str) -> str:
    return f"""
with c as (select {keys}, r, case when y_true >= 3 then 'sev' else 'non' end as cls from {src}),
o as (select *, row_number() over (partition by {keys}, cls order by r) as rn, count(*) over (partition by {keys}, cls) as n from c),
g as (select distinct {keys} from c),
ns as (select distinct {keys}, cls, n from o),
k as (select g.*, b.level, b.budget, b.num, b.den, coalesce(s.n, 0) as n_s, coalesce(t.n, 0) as n_ns from g cross join v_budget b
  left join (select * from ns where cls = 'sev') s using ({keys}) left join (select * from ns where cls = 'non') t using ({keys}))
select {', '.join('k.' + x.strip() for x in keys.split(','))}, k.level, k.budget,
  coalesce(max(o.r) filter (where o.cls = 'sev' and o.rn = (k.num * (k.n_s + 1)) // k.den), '-infinity'::double) as lo,
  coalesce(max(o.r) filter (where o.cls = 'non' and o.rn = ((k.den - k.num) * (k.n_ns + 1) + k.den - 1) // k.den), 'infinity'::double) as hi
from k join o using ({keys}) group by all"""


def _crc(src: str, keys: str) -> str:
    return f"""
with c as (select {keys}, u1, r, case when y_true >= 3 then 'sev' else 'non' end as cls from {src} where u2 is null),
e as (select {keys}, cls, u1, count(*) as ec from c group by all),
n as (select {keys}, cls, count(*) as n from e group by all),
w as (select {keys}, cls, r, sum(1.0::double / ec) as w from c join e using ({keys}, cls, u1) group by all),
g as (select {keys}, cls, r, sum(w) over (partition by {keys}, cls order by r) as g from w),
t as (select {keys}, cls, level, budget, n.n, num * (n + 1) - den as numer,
  min(r) filter (where g * den > num * (n + 1) - den + 1e-6) as lo, min(r) filter (where g * den >= n * den - (num * (n + 1) - den) - 1e-6) as hi
  from g join n using ({keys}, cls) cross join v_budget group by {keys}, cls, level, budget, n.n, num, den),
v as (select *, case when cls = 'sev' then (case when numer < 0 then '-infinity'::double else coalesce(lo, 'infinity'::double) end)
  else (case when numer < 0 then 'infinity'::double else coalesce(hi, 'infinity'::double) end) end as lam from t)
select {keys}, level, budget, coalesce(max(lam) filter (where cls = 'sev'), '-infinity'::double) as lo, coalesce(max(lam) filter (where cls = 'non'), 'infinity'::double) as hi
from v group by {keys}, level, budget"""


def _evaluate(src: str, thr: str, keys: str) -> str:
    return f"""
with t as (select l.*, h.hi as hi2, h.budget as beta, b.num as an, b.den as ad, b2.num as bn, b2.den as bd from (select {keys}, level, budget as alpha, lo from {thr}) l
  join (select {keys}, level as level2, budget, hi from {thr}) h using ({keys}) join v_budget b on l.level = b.level join v_budget b2 on h.level2 = b2.level),
d as (select {keys}, alpha, beta, lo, hi2, an, ad, bn, bd, y_true, y_pred = y_true as ok, case when r > hi2 then 'A' when r < lo then 'P' else 'R' end as d from {src} join t using ({keys}))
select {keys}, alpha, beta, min(lo) as lam_lo, min(hi2) as lam_hi,
  count(*) filter (where d = 'P' and y_true >= 3) / nullif(cast(count(*) filter (where y_true >= 3) as double), 0) as miss_sev,
  count(*) filter (where d = 'A' and y_true < 3) / nullif(cast(count(*) filter (where y_true < 3) as double), 0) as false_alert,
  count(*) filter (where d = 'R') / cast(count(*) as double) as review_frac, count(*) filter (where d = 'P') / cast(count(*) as double) as passive_frac,
  count(*) filter (where d = 'A') / cast(count(*) as double) as alert_frac,
  count(*) filter (where d = 'R' and y_true >= 3) / nullif(cast(count(*) filter (where y_true >= 3) as double), 0) as review_frac_sev,
  count(*) filter (where d = 'R' and y_true = 0) / nullif(cast(count(*) filter (where y_true = 0) as double), 0) as review_frac_tier0,
  count(*) filter (where d = 'R' and y_true >= 1) / nullif(cast(count(*) filter (where y_true >= 1) as double), 0) as review_frac_sevonly,
  count(*) filter (where d <> 'R' and ok) / nullif(cast(count(*) filter (where d <> 'R') as double), 0) as auto_acc,
  1.0::double - count(*) filter (where d = 'P' and y_true >= 3) / nullif(cast(count(*) filter (where y_true >= 3) as double), 0) as severe_sens,
  cast(count(*) filter (where d = 'P' and y_true >= 3) * min(ad) > min(an) * count(*) filter (where y_true >= 3) as bigint) as exceed_miss,
  cast(count(*) filter (where d = 'A' and y_true < 3) * min(bd) > min(bn) * count(*) filter (where y_true < 3) as bigint) as exceed_false_alert
from d group by {keys}, alpha, beta"""


REF_METRICS = ["miss_sev", "false_alert", "review_frac", "passive_frac", "alert_frac", "review_frac_sev",
               "review_frac_tier0", "review_frac_sevonly", "auto_acc", "severe_sens"]
_TK, _IK = "method, fold, seed, rep", "method, fold, seed, part, rep"
VIEWS["v_half_cal"] = "select * from v_half where is_cal"
VIEWS["v_half_eval"] = "select * from v_half where not is_cal"
VIEWS["v_thr"] = _mondrian("v_half_cal", _TK)
VIEWS["v_eval"] = _evaluate("v_half_eval", "v_thr", _TK)
VIEWS["v_cold_cal"] = "select * from v_cold_assigned where side = 'cal'"
VIEWS["v_cold_eval"] = "select * from v_cold_assigned where side = 'eval'"
VIEWS["v_cold_eval1"] = "select * from v_cold_eval where u2 is null"
VIEWS["v_cold_thr"] = _mondrian("v_cold_cal", _IK)
VIEWS["v_cold_res"] = _evaluate("v_cold_eval", "v_cold_thr", _IK)
VIEWS["v_crc_thr"] = _crc("v_cold_cal", _IK)
VIEWS["v_crc_res"] = _evaluate("v_cold_eval1", "v_crc_thr", _IK)
VIEWS["v_pooled_thr"] = """
select t.method, t.fold, t.seed, p.part, t.rep, t.level, t.budget, t.lo, t.hi from v_thr t cross join (select unnest(['S1', 'S2']) as part) p"""
VIEWS["v_pooled_res"] = _evaluate("v_cold_eval", "v_pooled_thr", _IK)
_MEANS = ", ".join(f"avg({m}) as {m}" for m in [*REF_METRICS, "exceed_miss", "exceed_false_alert"])
VIEWS["v_trans"] = f"select method, fold, seed, alpha, beta, {_MEANS} from v_eval group by 1, 2, 3, 4, 5"
VIEWS["v_ind"] = " union all ".join(
    f"select method, fold, seed, part, '{c}' as calibration, alpha, beta, {_MEANS} from {v} group by 1, 2, 3, 4, 5, 6, 7"
    for c, v in (("pair-level", "v_cold_res"), ("entity-level", "v_crc_res"), ("transferred", "v_pooled_res")))
VIEWS["v_refpol"] = """
select method, fold, seed, rep, count(*) filter (where y_true >= 3 and y_pred <= 2) / nullif(cast(count(*) filter (where y_true >= 3) as double), 0) as ref_argmax_miss,
  count(*) filter (where y_true < 3 and y_pred >= 3) / nullif(cast(count(*) filter (where y_true < 3) as double), 0) as ref_argmax_false_alert,
  count(*) filter (where y_true >= 3 and r < 0.5) / nullif(cast(count(*) filter (where y_true >= 3) as double), 0) as ref_thr05_miss,
  count(*) filter (where y_true < 3 and r >= 0.5) / nullif(cast(count(*) filter (where y_true < 3) as double), 0) as ref_thr05_false_alert
from v_half_eval group by 1, 2, 3, 4"""
_LONG = " union all ".join(f"select method, alpha, beta, '{m}' as metric, {m} as value from v_trans" for m in REF_METRICS)
_REFLONG = " union all ".join(f"select method, null::double as alpha, null::double as beta, '{m}' as metric, avg({m}) as value from v_refpol group by method, fold, seed"
                              for m in ("ref_argmax_miss", "ref_argmax_false_alert", "ref_thr05_miss", "ref_thr05_false_alert"))
VIEWS["v_policy_long"] = f"""
select method, alpha, beta, metric, avg(value) as mean, stddev_pop(value) as sd, count(*) as n_runs from ({_LONG} union all {_REFLONG}) group by 1, 2, 3, 4"""

# Training rows of the tier models: pairs and plain negatives, sealed and dealt.
VIEWS["v_negatives"] = """
with idx as (select entity_id, row_number() over (order by md5(entity_id), entity_id) - 1 as i from v_fp),
k as (select (select count(*) from v_pairs) // 10 as n_neg, (select count(*) from v_fp) as n_ent),
t as (select unnest(range(15 * n_neg)) as id, n_ent from k),
d as (select cast('0x' || substr(md5(concat_ws('|', '42', 'i', cast(id as string))), 1, 15) as bigint) % n_ent as i,
  cast('0x' || substr(md5(concat_ws('|', '42', 'j', cast(id as string))), 1, 15) as bigint) % (n_ent - 1) as j0 from t),
e as (select i, j0 + case when j0 >= i then 1 else 0 end as j from d),
c as (select distinct least(x.entity_id, z.entity_id) as a, greatest(x.entity_id, z.entity_id) as b
  from e join idx x on e.i = x.i join idx z on e.j = z.i),
f as (select c.a, c.b from c join v_fp x on c.a = x.entity_id join v_fp z on c.b = z.entity_id
  where not exists (select 1 from v_pairs p where p.a = c.a and p.b = c.b)
  and len(list_intersect(x.bits, z.bits)) / cast(len(x.bits) + len(z.bits) - len(list_intersect(x.bits, z.bits)) as double) < 0.3)
select a, b from (select a, b, row_number() over (order by md5(concat_ws('|', '42', 'cut', a, b)), a, b) as rn from f), k where rn <= n_neg"""
VIEWS["v_tier_rows"] = "select a, b, y from v_pairs union all select a, b, 0 as y from v_negatives"
VIEWS["v_tier_quota"] = _quota("v_tier_rows", "(n_all + 4) // 5")
VIEWS["v_tier_sealed"] = _sealed("v_tier_rows", "v_tier_quota")
