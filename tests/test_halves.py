"""Packed halves and interval cells against split rows and the policies evaluated row by row."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrade.functions.hashing import md5_leading
from pairgrade.operators import halves as H, referral as R

RUN = ["m", "seed"]


def draw(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def test_array_md5_equals_hashlib():
    heads = [f"A|1|{r}|".encode() for r in range(9, 12)] + [b"", "é|".encode(), b"x" * 54, b"y" * 70]
    tails = [str(i).encode() for i in (0, 7, 99, 100, 123456)] + [b"", "ü".encode(), b"z" * 55]
    want = [[int(hashlib.md5(h + t).hexdigest()[:16], 16) for h in heads] for t in tails]
    assert md5_leading(heads, tails).tolist() == want and md5_leading(heads, []).shape == (0, 7)


def test_no_task_holds_a_run_in_all_repeats(spark, monkeypatch):
    """Cells travel in blocks of repeats, and there are few until an interval is known to hold a threshold."""
    rows = rows_of(spark, 3000, ties=10**6)
    sides = H.Sides(H.half_cuts(rows, RUN, 25, "row_id"), 25, ["row_id"])
    made = []
    cells = H.cells
    monkeypatch.setattr(H, "cells", lambda *a: made.append(cells(*a)) or made[-1])
    monkeypatch.setattr(H, "CELL_ROWS", 8)
    assert H.evaluate(rows, RUN, sides).count() == 2 * 25 * 16
    wide, narrow, exact = (x.select("bucket", "block", "low", F.length("sums").alias("size")).toPandas() for x in made)
    assert set(wide["block"]) == {0, 1, 2} and wide["size"].max() == 2 * H.REP_BLOCK * 8
    assert len(wide[wide["block"] == 0]) < 1500 and (narrow["bucket"] > H.NARROW // 2).all() and len(exact) < 3 * 3060


def rows_of(spark, n=400, ties=40, seed=0):
    g = np.random.default_rng(seed)
    rows = []
    for m, s in (("A", 1), ("B", 2)):
        for i in range(n if m == "A" else 60):
            y = int(g.integers(0, 5))
            r = float(np.clip(np.round((y / 5 + g.normal(0, 0.25)) * ties) / ties, 0, 1))
            rows.append((m, s, i, y, int(np.clip(y + g.integers(-1, 2), 0, 4)), r, int(g.integers(0, 30)), int(g.integers(0, 30)) if i % 3 == 0 else None))
    return spark.createDataFrame(rows, "m string, seed bigint, row_id bigint, y_true bigint, y_pred bigint, r double, u1 bigint, u2 bigint")


@pytest.mark.parametrize("width", [6.0, 0.01])
def test_cuts_are_the_middle_of_the_hash_order(spark, width):
    sizes = {("A", 1): 1, ("A", 2): 2, ("B", 1): 3, ("B", 2): 500}
    ids = spark.createDataFrame([(m, s, i * 3) for (m, s), n in sizes.items() for i in range(n)], "m string, seed bigint, id bigint")
    cuts = H.half_cuts(ids, RUN, 7, "id")
    for (m, s), n in sizes.items():
        for rep in range(7):
            order = sorted(draw(m, s, rep, i * 3) for i in range(n))
            want = int(order[n // 2 - 1][:16], 16) if n > 1 else 0
            assert int(cuts[m, s][rep]) == want


def test_packed_sides(spark):
    rows = rows_of(spark, 90)
    ids = rows.select(*RUN, F.col("u1").alias("e")).union(rows.where("u2 is not null").select(*RUN, "u2")).distinct()
    sides = H.Sides(H.half_cuts(ids, RUN, 5, "e"), 5, ["u1", "u2"])
    got = H.packed(rows.select(*RUN, "row_id", "u1", "u2"), RUN, sides).collect()
    members = {k: sorted({r[c] for r in got if (r["m"], r["seed"]) == k for c in ("u1", "u2") if r[c] is not None}) for k in (("A", 1), ("B", 2))}
    for r in got:
        k = r["m"], r["seed"]
        for rep in range(5):
            order = sorted(members[k], key=lambda e: draw(*k, rep, e))
            first = set(order[:len(order) // 2])
            inside = {e in first for e in (r["u1"], r["u2"]) if e is not None}
            assert r["sides"][rep] == ("m" if len(inside) == 2 else "c" if True in inside else "e")


@pytest.mark.parametrize("ties", [20, 10**6])
@pytest.mark.parametrize("cell_rows", [4096, 4])
def test_figures_equal_rows(spark, monkeypatch, ties, cell_rows):
    monkeypatch.setattr(H, "CELL_ROWS", cell_rows)
    rows = rows_of(spark, ties=ties).withColumn("bucket", F.lit("clash"))
    sides = H.Sides(H.half_cuts(rows, RUN, 6, "row_id"), 6, ["row_id"])
    got = H.evaluate(rows.drop("bucket"), RUN, sides).toPandas()
    letters = H.packed(rows.select(*RUN, "row_id", "y_true", "y_pred", "r"), RUN, sides)
    split = letters.select("*", F.posexplode(F.split("sides", "")).alias("rep", "side")).where("side <> ''")
    keys = [*RUN, "rep"]
    want = R.referral_metrics(split.where("side = 'e'"), R.mondrian_thresholds(split.where("side = 'c'"), keys), keys).toPandas()
    order = [*keys, "alpha", "beta"]
    a, b = got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True)
    assert len(a) == len(b) == 2 * 6 * 16
    for c in (*R.METRICS, "lam_lo", "lam_hi", "exceed_miss", "exceed_false_alert"):
        assert np.array_equal(a[c].astype(float), b[c].astype(float), equal_nan=True), c
    ref = H.references(rows.drop("bucket"), RUN, sides).toPandas().sort_values(keys)
    plain = R.reference_policies(split.where("side = 'e'"), keys).toPandas().sort_values(keys)
    for c in plain.columns[3:]:
        assert np.allclose(ref[c], plain[c], equal_nan=True)


def test_entity_weights_equal_rows(spark):
    rows = rows_of(spark).where("u2 is null").drop("u2")
    ids = rows.select(*RUN, F.col("u1").alias("e")).distinct()
    sides = H.Sides(H.half_cuts(ids, RUN, 4, "e"), 4, ["u1"])
    split = (H.packed(rows, RUN, sides).select("*", F.posexplode(F.split("sides", "")).alias("rep", "side")).where("side <> ''"))
    keys = [*RUN, "rep"]
    thr = R.crc_thresholds(split.where("side = 'c'"), keys)
    want = R.entity_rates(split.where("side = 'e'"), thr, keys).toPandas()
    got = H.evaluate(rows, RUN, sides, "risk", "entities").toPandas()
    order = [*keys, "alpha", "beta"]
    a, b = got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True)
    assert len(a) == len(b)
    for c in ("entity_miss", "entity_false_alert", "entity_review", "exceed_miss", "exceed_false_alert"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c
    metrics = R.referral_metrics(split.where("side = 'e'"), thr, keys).toPandas().sort_values(order).reset_index(drop=True)
    own = H.evaluate(rows, RUN, sides, "risk").toPandas().sort_values(order).reset_index(drop=True)
    assert np.array_equal(own["lam_lo"], metrics["lam_lo"]) and np.array_equal(own["lam_hi"], metrics["lam_hi"])
    limits = H.collected(H.thresholds(own_df := H.evaluate(rows, RUN, sides, "risk"), RUN), RUN, 4)
    again = H.evaluate(rows, RUN, sides, given=limits).toPandas().sort_values(order).reset_index(drop=True)
    assert own_df.columns == [*RUN, "rep", *H.FIGURES] and np.allclose(again["review_frac"], own["review_frac"])


def test_no_rows(spark):
    rows = rows_of(spark).limit(0)
    sides = H.Sides(H.half_cuts(rows, RUN, 3, "row_id"), 3, ["row_id"])
    assert H.evaluate(rows, RUN, sides).count() == 0 and H.packed(rows, RUN, sides).count() == 0
