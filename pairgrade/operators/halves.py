"""Repeated random halves as packed vectors, and the interval cells that every referral figure follows from.

R repeats of a split are not R copies of the rows.  A row's sides in all repeats are one vector, made where the row
is read from the hashes of (run, repeat, id) and one cut for each run and repeat.  Rows are counted into cells: one for
each run, interval of the score, true tier and whether the prediction is right, with a vector of counts for each side.
Thresholds and all budget pairs follow from running sums of the cells of a run.  Only intervals that hold a threshold
are counted again: in narrower intervals if they hold many rows, then by the exact score.

* A cut is the k-th smallest hash.  It lies near the k/n quantile of a uniform order, so only the hashes of a window of
  six standard deviations are gathered, about six times the root of n, and widened if the cut is outside.
* Intervals are buckets of equal log-odds.  The rows of one lie together, so that its cells are counted in few tasks;
  where a threshold lies in one with more than ``CELL_ROWS`` rows, narrower ones follow.
* Vectors are cut in blocks of ``REP_BLOCK`` repeats: a task holds the cells of a run for one block.
* Sums are integers, so that results do not depend on the order of addition.

Runs and repeats are experiment dimensions: what has one row for each of them goes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pairgrade.functions.hashing import md5_leading
from pairgrade.functions.ordering import unit_bucket
from pairgrade.operators.referral import BUDGETS, INF, METRICS, SEVERE, budget
from pairgrade.session import materialize

CELL_ROWS, TASK_DRAWS, REP_BLOCK, DEALT, SLOTS = 4096, 2_000_000, 10, 8, 16
NARROW = 1 << 40  # the number of the narrower interval at even odds
UNIT = 1 << 43  # a calibration entity's weight


def _key(values: Sequence) -> tuple:
    """A run's key as plain values."""
    return tuple(v.item() if isinstance(v, np.generic) else v for v in values)


def _draws(run: tuple, n_reps: int, ids: Sequence) -> np.ndarray:
    """Leading 64 bits of md5 'run...|repeat|id' for each id and repeat."""
    head = "|".join(map(str, run))
    heads = [f"{head}|{rep}|".encode() for rep in range(n_reps)]
    return md5_leading(heads, [str(i).encode() for i in ids])


def _dealt(rows: DataFrame, run_cols: Sequence[str], n_reps: int, by: str, *near: str, ways: int = 64) -> DataFrame:
    """Narrow rows dealt over tasks by the draws they stand for, however the input is split; those alike in `near` in
    at most `ways` tasks for each run."""
    n = rows.count()
    return rows.repartition(max(1, -(-n * n_reps // TASK_DRAWS)), *run_cols, *near, F.xxhash64(by) % ways)


def half_cuts(ids: DataFrame, run_cols: Sequence[str], n_reps: int, id_col: str) -> dict[tuple, np.ndarray]:
    """For each run the hash of the last of the first floor(n / 2) ids in hash order, by repeat; ids are distinct.

    A run of a single id has no first half: its cuts are 0, below every hash but 0."""
    run_cols = list(run_cols)
    sizes = {_key([r[c] for c in run_cols]): r["n"] for r in ids.groupBy(*run_cols).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = _dealt(ids.select(*run_cols, F.col(id_col).cast("string").alias("__id")), run_cols, n_reps, "__id")
    cuts = {run: np.zeros(n_reps, np.uint64) for run, n in sizes.items() if n < 2}
    width = 6.0
    while open_runs := {run: n for run, n in sizes.items() if run not in cuts}:
        window = {run: [min(int(max(0.5 + s * (width * 0.5 / n**0.5 + 2 / n), 0.0) * 2**64), 2**64 - 1) for s in (-1, 1)] for run, n in open_runs.items()}

        def gather(batches, window=window):
            for b in batches:
                out = []
                for run, g in b.groupby(run_cols, sort=False):
                    run = _key(run)
                    if run not in window:
                        continue
                    h = _draws(run, n_reps, g["__id"])
                    lo, hi = (np.uint64(x) for x in window[run])
                    below, inside = (h < lo).sum(0), (h >= lo) & (h <= hi)
                    out += [(*run, rep, int(below[rep]), h[inside[:, rep], rep].tobytes()) for rep in range(n_reps)]
                yield pd.DataFrame(out, columns=[*run_cols, "rep", "below", "hashes"])

        def pick(g: pd.DataFrame) -> pd.DataFrame:
            run = _key(g[run_cols].iloc[0])
            near = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in g["hashes"]]))
            at = sizes[run] // 2 - int(g["below"].sum()) - 1
            cut = int(near[at].view(np.int64)) if 0 <= at < len(near) else None
            return pd.DataFrame([(*run, int(g["rep"].iloc[0]), cut is not None, cut or 0)], columns=[*run_cols, "rep", "found", "cut"])

        fields = ids.select(*run_cols).schema
        typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        found = (rows.mapInPandas(gather, f"{typed}, rep int, below long, hashes binary").groupBy(*run_cols, "rep")
                 .applyInPandas(pick, f"{typed}, rep int, found boolean, cut long")).collect()
        for run in open_runs:
            got = {r["rep"]: r["cut"] for r in found if _key([r[c] for c in run_cols]) == run and r["found"]}
            if len(got) == n_reps:
                cuts[run] = np.array([got[rep] for rep in range(n_reps)], np.int64).view(np.uint64)
        width *= 8
    return cuts


class Sides:
    """Calibration and evaluation side of rows in every repeat.

    With one id column a row is calibration where its id is in the first half; with two, a row with only the first goes
    with that id, one with both needs both on the same side and is on neither where they differ."""

    def __init__(self, cuts: dict[tuple, np.ndarray], n_reps: int, ids: Sequence[str]):
        self.cuts, self.n_reps, self.ids = cuts, n_reps, list(ids)

    def with_texts(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"__{c}": F.col(c).cast("string") for c in self.ids})

    def of(self, run: tuple, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        cal = ev = None
        for c in self.ids:
            column = rows[f"__{c}"].to_numpy(object)
            absent = pd.isna(column)
            known, at = np.unique(column[~absent].astype(str), return_inverse=True)
            first = np.ones((len(rows), self.n_reps), bool)
            first[~absent] = (_draws(run, self.n_reps, known) <= self.cuts[run])[at] if len(known) else True
            second = ~first
            second[absent] = True
            cal, ev = (first, second) if cal is None else (cal & first, ev & second)
        return cal, ev


_BY = ["bucket", "r", "y", "ok"]


def _merge(keys: pd.DataFrame, sums: np.ndarray, by: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    code = keys.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
    low = keys["low"].to_numpy()[order]
    out = keys.iloc[order[first]].assign(low=np.minimum.reduceat(low, first))
    return out, np.add.reduceat(sums[order], first, axis=0)


def cells(rows: DataFrame, run_cols: Sequence[str], sides: Sides, exact: bool, weights: Sequence[str] = ()) -> DataFrame:
    """Cells of `rows` (run, ids, bucket, r, y_true, y_pred, weights): run, bucket, r (null unless `exact`), y, ok, low
    (the least score), block and sums, for both sides the count and the sum of each weight in every repeat of the block."""
    run_cols, measures = list(run_cols), 1 + len(weights)
    by = [*run_cols, *_BY]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*run_cols).schema)
    schema = f"{typed}, bucket long, r double, y long, ok boolean, low double, block int, sums binary"

    def rows_of(keys: pd.DataFrame, sums: np.ndarray, block: int) -> pd.DataFrame:
        return keys.assign(block=block, sums=[s.tobytes() for s in sums])[[*by, "low", "block", "sums"]]

    def count(batches):
        held: list[tuple[pd.DataFrame, np.ndarray]] = []
        for b in batches:
            for run, g in b.groupby(run_cols, sort=False):
                both = sides.of(_key(run), g)
                values = [np.ones(len(g), np.int64), *(g[w].to_numpy(np.int64) for w in weights)]
                vectors = np.stack([side * v[:, None] for side in both for v in values], 1)  # row, side and measure, repeat
                keys = g[[*run_cols, "bucket", "r", "y_true"]].rename(columns={"y_true": "y"}).assign(ok=(g["y_true"] == g["y_pred"]).to_numpy(), low=g["r"].to_numpy())
                if not exact:
                    keys["r"] = np.nan
                held.append(_merge(keys, vectors, by))
            if len(held) > 64:
                held = [_merge(pd.concat([k for k, _ in held]), np.concatenate([s for _, s in held]), by)]
        if held:
            keys, sums = _merge(pd.concat([k for k, _ in held]), np.concatenate([s for _, s in held]), by)
            for block, lo in enumerate(range(0, sides.n_reps, REP_BLOCK)):
                yield rows_of(keys, sums[:, :, lo:lo + REP_BLOCK], block)

    def add(g: pd.DataFrame) -> pd.DataFrame:
        sums = np.stack([np.frombuffer(x, np.int64).reshape(2 * measures, -1) for x in g["sums"]])
        return rows_of(*_merge(g.drop(columns=["sums", "slot"]), sums, by), int(g["block"].iloc[0]))

    texts = [f"__{c}" for c in sides.ids]
    parts = sides.with_texts(rows).select(*run_cols, *texts, "bucket", "r", "y_true", "y_pred", *weights).mapInPandas(count, schema)
    slot = F.pmod(F.xxhash64(*run_cols, "bucket"), F.lit(SLOTS)).alias("slot")
    return parts.select("*", slot).groupBy("slot", "block").applyInPandas(add, schema)


class RunCells:
    """The cells of one run in order of the score, as arrays, for a block of repeats."""

    def __init__(self, g: pd.DataFrame, measures: int):
        g = g.sort_values(["low", "y", "ok"])
        self.low, self.y, self.ok = (g[c].to_numpy() for c in ("low", "y", "ok"))
        self.bucket = g["bucket"].to_numpy()
        self.first = int(g["block"].iloc[0]) * REP_BLOCK
        sums = np.stack([np.frombuffer(x, np.int64).reshape(2, measures, -1) for x in g["sums"]])
        self.reps = slice(self.first, self.first + sums.shape[-1])
        self.cal, self.ev = sums[:, 0], sums[:, 1]  # cell, measure, repeat

    def upto(self, values: np.ndarray) -> np.ndarray:
        """Sums of the cells before each place, for places 0 to the number of cells."""
        return np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, 0)])


def _order_thresholds(run: RunCells) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Class-conditional thresholds: (is lower, cell that holds it or -1 for each repeat, value) for each budget.

    lo = k-th smallest severe score with k = floor(alpha (n+1)), -inf if k < 1; hi = k-th smallest other score with
    k = ceil((1-beta)(n+1)), +inf if k > n."""
    out = []
    for severe in (True, False):
        mine = (run.y >= SEVERE) == severe
        total = run.upto(run.cal[:, 0] * mine[:, None])
        n = total[-1]
        for num, den in BUDGETS:
            k = num * (n + 1) // den if severe else ((den - num) * (n + 1) + den - 1) // den
            at = np.array([np.searchsorted(total[1:, j], k[j]) for j in range(len(n))])
            open_side = (k < 1) | (k > n)
            at = np.where(open_side, -1, at)
            value = np.where(open_side, -INF if severe else INF, run.low[np.maximum(at, 0)])
            out.append((severe, at, value))
    return out


def _risk_thresholds(run: RunCells) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entity-level risk control: weights (measure 1) instead of counts, every calibration entity of the class weighing
    one (measure 3 holds it once for each entity)."""
    out = []
    for severe in (True, False):
        mine = ((run.y >= SEVERE) == severe)[:, None]
        mass = run.upto(run.cal[:, 1] * mine)[1:] / UNIT
        n = (run.cal[:, 3] * mine).sum(0)
        for num, den in BUDGETS:
            numer = num * (n + 1) - den
            hit = mass * den > numer + 1e-6 if severe else mass * den >= n * den - numer - 1e-6
            hit &= (run.cal[:, 0] * mine).astype(bool).cumsum(0) > 0
            small, never = numer < 0, ~hit.any(0) if len(hit) else np.ones(len(n), bool)
            at = np.where(small | never, -1, hit.argmax(0) if len(hit) else 0)
            value = np.where(small | (n == 0), -INF if severe else INF, np.where(never, INF, run.low[np.maximum(at, 0)]))
            out.append((severe, at, value))
    return out


KINDS = {"order": _order_thresholds, "risk": _risk_thresholds}


def _wide(found: list) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([v for s, _, v in found if s]), np.stack([v for s, _, v in found if not s])


def figures(run: RunCells, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """Every figure of every repeat and budget pair, from running sums of the evaluation side; lo and hi: value by
    budget and repeat."""
    n_reps = lo.shape[1]
    groups = {"all": run.y >= 0, "sev": run.y >= SEVERE, "non": run.y < SEVERE, "t0": run.y == 0, "ge1": run.y >= 1, "cor": run.ok}
    reps = np.arange(n_reps)
    place = {i: (np.searchsorted(run.low, lo[i], "left"), np.searchsorted(run.low, hi[i], "right")) for i in range(len(BUDGETS))}
    n, b, u = {}, {}, {}
    for name, mask in groups.items():
        total = run.upto(run.ev[:, 0] * mask[:, None])
        n[name] = total[-1]
        for i, (below, within) in place.items():
            b[i, name], u[i, name] = total[below, reps], total[within, reps]
    share = lambda x, of: np.divide(x, of, out=np.full(n_reps, np.nan), where=of > 0)
    out = []
    for i, (an, ad) in enumerate(BUDGETS):
        for j, (bn, bd) in enumerate(BUDGETS):
            crossed = lo[i] > hi[j]
            p = {k: np.where(crossed, u[j, k], b[i, k]) for k in groups}
            a = {k: n[k] - u[j, k] for k in groups}
            rest = {k: n[k] - p[k] - a[k] for k in groups}
            miss, auto = share(p["sev"], n["sev"]), p["all"] + a["all"]
            over = lambda x, of, num, den: np.where(of > 0, (x * den > num * of).astype(float), np.nan)
            out.append(pd.DataFrame({
                "rep": reps, "alpha": budget(i), "beta": budget(j), "lam_lo": lo[i], "lam_hi": hi[j], "miss_sev": miss,
                "false_alert": share(a["non"], n["non"]), "review_frac": share(rest["all"], n["all"]), "passive_frac": share(p["all"], n["all"]),
                "alert_frac": share(a["all"], n["all"]), "review_frac_sev": share(rest["sev"], n["sev"]), "review_frac_tier0": share(rest["t0"], n["t0"]),
                "review_frac_sevonly": share(rest["ge1"], n["ge1"]), "auto_acc": share(p["cor"] + a["cor"], auto), "severe_sens": 1.0 - miss,
                "exceed_miss": over(p["sev"], n["sev"], an, ad), "exceed_false_alert": over(a["non"], n["non"], bn, bd)}))
    return pd.concat(out)


FIGURES = ["alpha", "beta", "lam_lo", "lam_hi", *METRICS, "exceed_miss", "exceed_false_alert"]


def entity_figures(run: RunCells, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """Rates averaged over evaluation entities: measure 1 is a row's share of its entity's rows of the class, 2 of all
    its rows; 3 and 4 hold one for each entity of the class and one for each entity."""
    n_reps = lo.shape[1]
    reps, sev = np.arange(n_reps), (run.y >= SEVERE)[:, None]
    severe, other, every = (run.upto(x) for x in (run.ev[:, 1] * sev, run.ev[:, 1] * ~sev, run.ev[:, 2]))
    n_sev, n_non, n = (run.ev[:, 3] * sev).sum(0), (run.ev[:, 3] * ~sev).sum(0), run.ev[:, 4].sum(0)
    share = lambda x, of: np.divide(x / UNIT, of, out=np.full(n_reps, np.nan), where=of > 0)
    out = []
    for i, (an, ad) in enumerate(BUDGETS):
        below = np.searchsorted(run.low, lo[i], "left")
        for j, (bn, bd) in enumerate(BUDGETS):
            within = np.searchsorted(run.low, hi[j], "right")
            miss, false = share(severe[below, reps], n_sev), share(other[-1] - other[within, reps], n_non)
            inside = np.where(within > below, every[within, reps] - every[below, reps], 0)
            over = lambda x, num, den: np.where(np.isnan(x), np.nan, (x * den > num + 1e-9).astype(float))
            out.append(pd.DataFrame({"rep": reps, "alpha": budget(i), "beta": budget(j), "lam_lo": lo[i], "lam_hi": hi[j], "entity_miss": miss, "entity_false_alert": false,
                                     "entity_review": share(inside, n), "exceed_miss": over(miss, an, ad), "exceed_false_alert": over(false, bn, bd)}))
    return pd.concat(out)


ENTITY_FIGURES = ["alpha", "beta", "lam_lo", "lam_hi", "entity_miss", "entity_false_alert", "entity_review", "exceed_miss", "exceed_false_alert"]


def entity_weights(rows: DataFrame, run_cols: Sequence[str], entity: str = "u1") -> DataFrame:
    """`rows` with what each weighs for its entity: w_class and w_all, its share of the entity's rows of its class and
    of all its rows in units, one_class and one_all, 1 on one row of each entity and class, and of each entity."""
    by = [*run_cols, entity]
    severe = (F.col("y_true") >= SEVERE).alias("__sev")
    per = rows.groupBy(*by, severe).agg(F.count(F.lit(1)).alias("__c"), F.min("row_id").alias("__first"))
    whole = per.groupBy(*by).agg(F.sum("__c").alias("__n"), F.min("__first").alias("__least"))
    out = rows.withColumn("__sev", F.col("y_true") >= SEVERE).join(per, [*by, "__sev"]).join(whole, by)
    unit = lambda c: F.round(F.lit(UNIT) / F.col(c)).cast("long")
    return out.select(*rows.columns, unit("__c").alias("w_class"), unit("__n").alias("w_all"), (F.col("row_id") == F.col("__first")).cast("long").alias("one_class"),
                      (F.col("row_id") == F.col("__least")).cast("long").alias("one_all"))


WEIGHTS = ["w_class", "w_all", "one_class", "one_all"]


def evaluate(rows: DataFrame, run_cols: Sequence[str], sides: Sides, kind: str = "order", report: str = "figures",
             given: dict | None = None, unjudged: bool = False) -> DataFrame:
    """Figures of every run, repeat and budget pair; repeats without calibration rows have none, and those without
    evaluation rows only where `unjudged`.

    rows: run, ids, r, y_true, y_pred, and row_id where entities weigh.  Thresholds are fitted on the calibration side
    (`kind`), or `given`: (lo, hi) by budget and repeat for each run.  One pass over all rows for the interval cells;
    the rows of intervals that hold a threshold are counted again in narrower ones, then by their exact scores."""
    run_cols = list(run_cols)
    weighted = kind == "risk" or report == "entities"
    weights = WEIGHTS if weighted else []
    measures = 1 + len(weights)
    by = [*run_cols, "bucket"]
    wide = (entity_weights(rows, run_cols) if weighted else rows).withColumn("bucket", unit_bucket("r").cast("long"))
    held = materialize(_dealt(wide, run_cols, sides.n_reps, sides.ids[0], "bucket", ways=DEALT))
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*run_cols).schema)

    def limits(run: RunCells, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        return tuple(v[:, run.reps] for v in given[key])

    def hit(g: pd.DataFrame) -> pd.DataFrame:
        run, key = RunCells(g, measures), _key(g[run_cols].iloc[0])
        if given is None:
            at = np.concatenate([a for _, a, _ in KINDS[kind](run)])
            found = np.unique(run.bucket[at[at >= 0]])
        else:
            place = [np.searchsorted(run.low, v[np.isfinite(v)], "right") - 1 for v in limits(run, key)]
            at = np.unique(np.concatenate(place))
            found = np.unique(run.bucket[at[at >= 0]])
        return pd.DataFrame([(*key, int(b)) for b in found], columns=by)

    def needed(counted: DataFrame) -> DataFrame:
        """Intervals that hold a threshold of some repeat; thresholds lie close, so these are few for each run."""
        return materialize(counted.groupBy(*run_cols, "block").applyInPandas(hit, f"{typed}, bucket long").distinct())

    counted = materialize(cells(held, run_cols, sides, False, weights))
    wanted = needed(counted)
    near = held.join(wanted, by, "left_semi")
    counted = counted.join(wanted, by, "left_anti")
    most = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > CELL_ROWS:
        finer = 1 << min(6, (-(-most // CELL_ROWS) - 1).bit_length())  # what is left then are ties and the end points
        near = near.withColumn("bucket", F.lit(NARROW) + unit_bucket("r", 16 * finer))
        narrow = materialize(cells(near, run_cols, sides, False, weights))
        wanted = needed(counted.select(*narrow.columns).unionByName(narrow))
        near = near.join(wanted, by, "left_semi")
        counted = counted.select(*narrow.columns).unionByName(narrow).join(wanted, by, "left_anti")
    fine = cells(near, run_cols, sides, True, weights)
    both = counted.select(*fine.columns).unionByName(fine)

    def final(g: pd.DataFrame) -> pd.DataFrame:
        run, key = RunCells(g, measures), _key(g[run_cols].iloc[0])
        lo, hi = limits(run, key) if given is not None else _wide(KINDS[kind](run))
        out = (figures if report == "figures" else entity_figures)(run, lo, hi)
        kept = (run.ev[:, 0].sum(0) > 0) | unjudged
        if given is None:
            kept &= run.cal[:, 0].sum(0) > 0
        for c, v in zip(run_cols, key):
            out[c] = v
        out = out[kept[out["rep"].to_numpy()]]
        return out.assign(rep=out["rep"] + run.first)[[*run_cols, "rep", *columns]]

    columns = FIGURES if report == "figures" else ENTITY_FIGURES
    out = both.groupBy(*run_cols, "block").applyInPandas(final, f"{typed}, rep long, " + ", ".join(f"{c} double" for c in columns))
    nan_null = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in columns if not c.startswith("exceed")]
    flags = [F.when(F.isnan(c), None).otherwise(F.col(c)).cast("long").alias(c) for c in columns if c.startswith("exceed")]
    return out.select(*run_cols, "rep", *nan_null, *flags)


def thresholds(figures_of: DataFrame, run_cols: Sequence[str]) -> DataFrame:
    """(run, rep, budget, lo, hi) from the figures: the diagonal of the budget pairs."""
    return figures_of.where("alpha = beta").select(*run_cols, "rep", F.col("alpha").alias("budget"), F.col("lam_lo").alias("lo"), F.col("lam_hi").alias("hi"))


def collected(limits: DataFrame, run_cols: Sequence[str], n_reps: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Thresholds as arrays by run: four numbers for each run and repeat on either side."""
    out: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    level = {budget(i): i for i in range(len(BUDGETS))}
    for r in limits.collect():
        lo, hi = out.setdefault(_key([r[c] for c in run_cols]), (np.full((len(BUDGETS), n_reps), -INF), np.full((len(BUDGETS), n_reps), INF)))
        lo[level[r["budget"]], r["rep"]], hi[level[r["budget"]], r["rep"]] = r["lo"], r["hi"]
    return out


def packed(rows: DataFrame, run_cols: Sequence[str], sides: Sides, out: str = "sides") -> DataFrame:
    """`rows` with a text of one letter for each repeat: c (calibration), e (evaluation) or m (neither)."""
    run_cols = list(run_cols)
    schema, own = rows.withColumn(out, F.lit("")).schema, rows.columns

    def run(batches):
        for b in batches:
            for key, g in b.groupby(run_cols, sort=False):
                cal, ev = sides.of(_key(key), g)
                letters = np.where(cal, b"c", np.where(ev, b"e", b"m")).astype("S1")
                yield g[own].assign(**{out: [x.tobytes().decode() for x in letters]})

    return sides.with_texts(rows).mapInPandas(run, schema)


def references(rows: DataFrame, run_cols: Sequence[str], sides: Sides) -> DataFrame:
    """Miss and false alert of 'argmax >= 3' and 'r >= 0.5' on the evaluation side of every run and repeat."""
    run_cols = list(run_cols)
    kind = (2 * (F.col("y_pred") >= SEVERE).cast("long") + (F.col("r") >= 0.5).cast("long")).alias("bucket")
    counted = cells(_dealt(rows.select("*", kind), run_cols, sides.n_reps, sides.ids[0]), run_cols, sides, False)
    names = ["ref_argmax_miss", "ref_argmax_false_alert", "ref_thr05_miss", "ref_thr05_false_alert"]

    def final(g: pd.DataFrame) -> pd.DataFrame:
        run = RunCells(g, 1)
        severe, taken, over = run.y >= SEVERE, run.bucket >= 2, run.bucket % 2 == 1
        out = pd.DataFrame({"rep": np.arange(run.reps.start, run.reps.stop)})
        for name, of, hit in zip(names, (severe, ~severe, severe, ~severe), (~taken, taken, ~over, over)):
            n = run.ev[of, 0].sum(0)
            out[name] = np.divide(run.ev[of & hit, 0].sum(0), n, out=np.full(len(out), np.nan), where=n > 0)
        for c, v in zip(run_cols, _key(g[run_cols].iloc[0])):
            out[c] = v
        return out[[*run_cols, "rep", *names]]

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*run_cols).schema)
    out = counted.groupBy(*run_cols, "block").applyInPandas(final, f"{typed}, rep long, " + ", ".join(f"{c} double" for c in names))
    return out.select(*run_cols, "rep", *[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in names])


def sizes(rows: DataFrame, run_cols: Sequence[str], sides: Sides) -> DataFrame:
    """Mean calibration, evaluation and mixed rows of each run over the repeats."""
    flat = rows.withColumns({"bucket": F.lit(0).cast("long"), "r": F.lit(0.0)})
    counted = cells(_dealt(flat, run_cols, sides.n_reps, sides.ids[0]), run_cols, sides, False)
    n = rows.groupBy(*run_cols).agg(F.count(F.lit(1)).alias("__n"))
    run_cols = list(run_cols)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*run_cols).schema)

    def final(g: pd.DataFrame) -> pd.DataFrame:
        run = RunCells(g, 1)
        return pd.DataFrame([(*_key(g[run_cols].iloc[0]), int(run.cal.sum()), int(run.ev.sum()))], columns=[*run_cols, "cal", "eval"])

    sums = counted.groupBy(*run_cols, "block").applyInPandas(final, f"{typed}, cal long, eval long").groupBy(*run_cols)
    out = sums.agg(*[(F.sum(c) / sides.n_reps).alias(f"mean_{c}") for c in ("cal", "eval")]).join(n, run_cols)
    return out.select(*run_cols, "mean_cal", "mean_eval", (F.col("__n") - F.col("mean_cal") - F.col("mean_eval")).alias("mean_mixed"))
