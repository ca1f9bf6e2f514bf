"""Boosted trees against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrade.operators import boosting as B


def make(n, seed=0):
    rng = np.random.default_rng(seed)
    bits = [sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)]
    dense = np.round(rng.normal(size=(n, 2)), 1)
    has = np.array([[f in b for f in range(12)] for b in bits])
    y = np.where(has[:, 0] ^ has[:, 1], 2, np.where(dense[:, 0] > 0.3, 1, 0))
    return bits, dense, y, rng.integers(1, 4, n).astype(float)


def frame(spark, bits, dense, y, w, valid=None):
    valid = np.zeros(len(y), bool) if valid is None else valid
    rows = [(i, -i, b, d.tolist(), int(c), float(x), bool(v)) for i, (b, d, c, x, v) in enumerate(zip(bits, dense, y, w, valid))]
    return spark.createDataFrame(rows, "a long, b long, bits array<int>, dense array<double>, y long, weight double, valid boolean")


def plain(layout, bits, dense, y, w, classes, rounds, depth, rate, l2, least):
    """Scores after growing each tree by trying every cut of every feature at every node."""
    x = layout.bins(bits, dense).astype(int)
    total = np.zeros((len(y), classes))
    for _ in range(rounds):
        g, h = (v / B.UNIT for v in B.gradients(total, y, w))
        add = np.zeros_like(total)
        for k in range(classes):
            def grow(rows, level):
                G, H = g[k][rows].sum(), h[k][rows].sum()
                best = (1e-9, None, None)
                if level < depth:
                    for f in range(layout.width):
                        for cut in range(x[:, f].max()):
                            left = rows[x[rows, f] <= cut]
                            GL, HL = g[k][left].sum(), h[k][left].sum()
                            if HL < least or H - HL < least:
                                continue
                            gain = GL**2 / (HL + l2) + (G - GL)**2 / (H - HL + l2) - G**2 / (H + l2)
                            if gain > best[0] + 1e-9:
                                best = gain, f, cut
                if best[1] is None:
                    add[rows, k] = -rate * G / (H + l2)
                else:
                    right = x[rows, best[1]] > best[2]
                    grow(rows[~right], level + 1)
                    grow(rows[right], level + 1)

            grow(np.arange(len(y)), 0)
        total += add
    return total


@pytest.fixture(scope="module")
def fitted(spark):
    bits, dense, y, w = make(300)
    df = frame(spark, bits, dense, y, w)
    options = dict(binary=12, n_dense=2, weight="weight", classes=3, rounds=3, depth=3, rate=0.3, row_share=1.0, feature_share=1.0, bins=16)
    return bits, dense, y, w, df, options, B.fit(df.repartition(3), **options)


def test_every_split_is_the_best(fitted):
    bits, dense, y, w, _, o, model = fitted
    want = plain(model.layout, bits, dense, y, w, 3, 3, 3, 0.3, 1.0, 1.0)
    assert np.allclose(model.scores(bits, dense), want, atol=1e-5)


def test_trees_do_not_depend_on_the_partitions(fitted):
    *_, df, options, model = fitted
    other = B.fit(df.orderBy("b").repartition(1), **options)
    for s, t in zip(model.rounds, other.rounds, strict=True):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all()


def test_written_scores_change_nothing(fitted, monkeypatch):
    *_, df, options, model = fitted
    monkeypatch.setattr(B, "SAVE", 1)
    other = B.fit(df.repartition(2), **options)
    for s, t in zip(model.rounds, other.rounds, strict=True):
        assert (s.feature == t.feature).all() and (s.value == t.value).all()


def test_early_stopping_learns_and_generalises(spark):
    bits, dense, y, w = make(1500, 1)
    valid = np.arange(1500) % 5 == 0
    model = B.fit(frame(spark, bits, dense, y, np.ones(1500), valid), 12, 2, classes=3, weight="weight", valid="valid", rounds=40, depth=4, rate=0.3, patience=3, seed=3)
    assert len(model.rounds) == int(np.argmin(model.losses)) and model.losses[len(model.rounds)] < 0.35 * model.losses[0]
    assert len(model.losses) <= 41
    nb, nd, ny, _ = make(800, 9)
    assert (model.scores(nb, nd).argmax(1) == ny).mean() > 0.9
    got = model.predict(frame(spark, nb[:50], nd[:50], ny[:50], np.ones(50)), ["a"]).collect()
    assert np.allclose([r["p"] for r in sorted(got)], B.softmax(model.scores(nb[:50], nd[:50])))


def test_odd_rows(spark):
    df = frame(spark, *make(40, 2))
    odd = df.withColumn("dense", F.when(F.col("a") < 5, F.array(F.lit(None).cast("double"), F.lit(float("nan")))).otherwise(F.col("dense")))
    odd = odd.withColumn("bits", F.when(F.col("a") > 30, F.lit(None)).otherwise(F.col("bits"))).withColumns({"id": F.lit("clash"), "w": F.lit(0), "k": F.lit(None)})
    model = B.fit(odd, 12, 2, classes=3, rounds=2, depth=2)
    assert len(model.rounds) == 2
    assert model.predict(odd, ["a"]).where("size(p) = 3").count() == 40
    assert B.fit(df.limit(0), 12, 2, classes=3, rounds=2).rounds == []


def test_fits_leave_no_tables(spark, monkeypatch):
    """Rows are written again every few rounds: the copies must not stay on disk."""
    import os
    from pairgrade import session
    from pairgrade.operators import perceptron as P

    home = session._tables(spark).removeprefix("file:")
    held = lambda: set(os.listdir(home)) if os.path.isdir(home) else set()
    kept = session.materialize(spark.range(5))
    before, most, write = held(), [], B.materialize

    def counted(df):
        most.append(len(held() - before))
        return write(df)

    monkeypatch.setattr(B, "materialize", counted)
    monkeypatch.setattr(B, "SAVE", 1)
    rows = frame(spark, *make(200, 3))
    model = B.fit(rows, 12, 2, classes=3, rounds=4, depth=2)
    P.fit(rows, 12, 2, hidden=(4,), classes=3, epochs=1)
    assert len(model.rounds) == 4 and len(most) == 5 and max(most) <= 1 and held() == before and kept.count() == 5
