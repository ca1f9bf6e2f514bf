"""Properties and brute-force checks of single operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pairgrade.functions.text import normalize_alias
from pairgrade.operators import (bootstrap as B, features as X, graph as G, ingest as I, label as L, mapping as Mp,
                                 metrics as M, models as Md, pairs as P, quality as Q, runs as R, scoring as C, splits as S)
from pairgrade.operators.profile import ProfilePCA
from pairgrade.plans.inputs import Inputs
from pairgrade.sources import tables as Tb
from pairgrade.sources.xml_entities import scan_entities
from tests.conftest import SF


@pytest.fixture(scope="module")
def pairs(spark):
    return Inputs(spark, SF).pairs_table


def test_tier_cascade_edges(spark):
    phrases = spark.createDataFrame([("bad rash", 2), ("line break", 4)], "phrase string, tier int")
    texts = ["", None, " \t\n", "metabolism may change", "The risk or severity of adverse effects can be increased",
             "The risk or severity of Bad Rash can be increased", "the risk or severity of \t bad rash\t can be x",
             "The risk or severity of odd thing can be increased", "The risk or severity of bad rash may rise",
             "The risk or severity of line break can be increased"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    got = [r["tier"] for r in L.tier_cascade(df, phrases).orderBy("i").collect()]
    assert got == [1, 1, 1, 1, 1, 2, 2, 3, 3, 4]


def test_pair_hash_ignores_order(spark):
    df = spark.createDataFrame([("B", "A"), ("A", "B")], "x string, y string")
    assert P.pair_hash(df, "x", "y").select("pair_hash").distinct().count() == 1


def test_normalize_alias_unicode(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ–Width® (Straße)",), ("PLAIN-Name/1.5",), (None,)], "a string")
    assert [r[0] for r in df.select(normalize_alias(F.col("a"))).collect()] == ["full width strasse", "plain name 1 5", ""]


def test_decode_attributes(spark):
    text = "CYP:Substrate, inhibitor|;nan|Bare| X : a:b | :lost"
    got = spark.createDataFrame([(text,)], "e string").select(I.decode_attributes(F.col("e")).alias("a")).first()["a"]
    assert [(a["name"], a["actions"]) for a in got] == [
        ("CYP", ["substrate", "inhibitor"]), ("Bare", ["unknown"]), ("X", ["a:b"])]


def test_xml_nested_other_type_and_missing_id(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        "<db><drug type='small molecule'><drugbank-id primary='true'>E1</drugbank-id><name>one</name>"
        "<pathways><drug><drugbank-id primary='true'>E9</drugbank-id></drug></pathways>"
        "<targets><target><name> T </name><actions><action>Agonist</action></actions></target>"
        "<target><name>T</name><actions><action>inhibitor</action></actions></target></targets></drug>"
        "<drug type='biotech'><drugbank-id primary='true'>E2</drugbank-id><name>two</name></drug>"
        "<drug type='small molecule'><drugbank-id>E3</drugbank-id><name>three</name></drug></db>")
    docs = scan_entities(spark, str(tmp_path / "x.xml"))
    assert sorted(r["entity_id"] for r in docs.collect()) == ["E1", "E2"]
    assert I.entity_type_filter(docs).count() == 1
    enc = I.attribute_encode(I.attribute_action_agg(I.attribute_explode(docs))).collect()
    assert [(r["kind"], r["encoded"]) for r in enc] == [("target", "T:agonist,inhibitor")]


def test_split_invariants(pairs):
    f = S.sealed_and_folds(pairs, "y", ["a", "b"], 42).cache()
    n = pairs.count()
    assert f.count() == n and f.where("fold = -1").count() == -(-n // 5)
    sizes = [r["count"] for r in f.where("fold <> -1").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    per_class = f.where("fold <> -1").groupBy("y", "fold").count().groupBy("y").agg(F.max("count") - F.min("count"))
    assert all(r[1] <= 1 for r in per_class.collect())


def test_cold_start_has_no_leak(pairs):
    held = S.held_out_entities(P.entity_universe(pairs), [1, 2])
    c = S.cold_start_split(pairs, held, [1, 2]).cache()
    assert c.count() == 2 * pairs.count()
    assert c.where("part = 'KK' and (in_a or in_b)").count() == 0
    assert c.where("part = 'S2' and not (in_a and in_b)").count() == 0


def test_small_class_falls_back_to_plain(spark):
    df = spark.createDataFrame([(i, 0 if i else 1) for i in range(50)], "id bigint, y bigint")
    assert S.stratified_or_plain_cut(df, "y", ["id"], 1, S.ceil_share(1, 10), "v").where("v").count() == 5


def test_features_are_symmetric(spark, pairs):
    src = Inputs(spark, SF)
    some = pairs.select("a", "b").limit(200).cache()
    f = X.bio_pair_features(some, src.sets)
    g = X.bio_pair_features(some.select(F.col("b").alias("a"), F.col("a").alias("b")), src.sets)
    cols = [f"f{i:02d}" for i in range(24)]
    g = g.select(F.col("b").alias("a"), F.col("a").alias("b"), *cols)
    assert f.select("a", "b", *cols).exceptAll(g).count() == 0


def test_cell_metrics_equal_row_metrics(spark):
    g = np.random.default_rng(3)
    y, p = g.integers(0, 5, 400), g.integers(0, 5, 400)
    df = spark.createDataFrame(pd.DataFrame({"k": "r", "y_true": y, "y_pred": p}))
    m = M.hard_metrics(M.confusion_cells(df, ["k"]), ["k"]).first()
    cm = np.zeros((5, 5))
    np.add.at(cm, (y, p), 1)
    f1 = [2 * cm[c, c] / (cm[c].sum() + cm[:, c].sum()) for c in range(5)]
    w = np.subtract.outer(np.arange(5), np.arange(5)) ** 2
    e = np.outer(cm.sum(1), cm.sum(0)) / cm.sum()
    assert m["macro_f1"] == pytest.approx(np.mean(f1)) and m["accuracy"] == pytest.approx(np.mean(y == p))
    assert m["qwk"] == pytest.approx(1 - (w * cm).sum() / (w * e).sum())


def test_absent_class_gives_null_not_zero(spark):
    df = spark.createDataFrame([("r", 0, 0), ("r", 1, 2)], "k string, y_true bigint, y_pred bigint")
    m = M.hard_metrics(M.confusion_cells(df, ["k"]), ["k"]).first()
    assert m["high_risk_sens"] is None and m["high_risk_spec"] == 1.0


def test_multinomial_bootstrap_agrees_with_row_bootstrap(spark):
    g = np.random.default_rng(5)
    n = 600
    y = g.integers(0, 5, n)
    a = np.where(g.random(n) < 0.8, y, g.integers(0, 5, n))
    b = np.where(g.random(n) < 0.6, y, g.integers(0, 5, n))
    df = spark.createDataFrame(pd.DataFrame({"k": "r", "y_true": y, "pred_a": a, "pred_b": b}))
    cells = B.joint_cells(df, ["k"])
    out = B.paired_bootstrap(cells, B.multinomial_draws(cells, ["k"], 400), ["k"], ["accuracy"]).first()
    d = (a == y).astype(float) - (b == y)
    boot = [d[g.integers(0, n, n)].mean() for _ in range(2000)]
    assert out["delta"] == pytest.approx(d.mean()) and out["n_finite"] == 400
    assert abs(out["ci_low"] - np.quantile(boot, 0.025)) < 0.02 and abs(out["ci_high"] - np.quantile(boot, 0.975)) < 0.02
    few = B.interval(B.deltas(B.multinomial_draws(cells, ["k"], 10), ["k", "rep"], ["accuracy"]), ["k", "metric"]).first()
    assert few["ci_low"] is None and few["excludes_zero"] is False


def test_t_tail():
    # Known two-sided tails of Student's t.
    assert np.allclose(B._t_two_sided(np.array([12.706, 2.776, 1.96]), np.array([1.0, 4.0, 1e4])), 0.05, atol=2e-4)


def test_salt_words(spark):
    names = ["morphine sulfate", "sodium chloride", "foo sodium hydrate", "sodium foo", "abc sodium", "plain", "hydrochloride"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(Mp.strip_salt(F.col("n"))).collect()] == [
        "morphine", "sodium chloride", "foo sodium", "sodium foo", "abc sodium", "plain", "hydrochloride"]


def test_ambiguous_name_is_not_chosen(spark):
    al = spark.createDataFrame([("E1", "Same", "x"), ("E2", "same", "y")], "entity_id string, primary_name string, alias string")
    q = spark.createDataFrame([("SAME",), ("x",)], "drug string")
    got = {r["drug"]: r["entity_id"] for r in Mp.name_to_id(q, al).collect()}
    assert got == {"SAME": None, "x": "E1"}


def test_union_unique_stops_on_repeat(spark):
    a = spark.createDataFrame([("m", 1, 42, "test")], "method string, fold bigint, seed bigint, test_set string")
    assert R.union_unique(a, a.withColumn("fold", F.lit(2).cast("bigint"))).count() == 2
    with pytest.raises(Exception, match="repeated run"):
        R.union_unique(a, a.withColumn("test_set", F.lit("holdout"))).count()


def test_change_rate_gate_stops(spark):
    df = spark.createDataFrame([(1, 2)] * 10, "o int, n int")
    assert Q.require_change_rate(Q.check_change_rate(df, "o", "n", 10)).first()["within"] == 1
    with pytest.raises(Exception, match="out of range"):
        Q.require_change_rate(Q.check_change_rate(df, "o", "n", 1000)).collect()


def test_label_lookup_miss_stops(spark):
    p = spark.createDataFrame([("A", "B", 1)], "a string, b string, y bigint")
    l = spark.createDataFrame([("A", "C", 2)], "a string, b string, tier bigint")
    with pytest.raises(Exception, match="no label for pair"):
        P.label_lookup_strict(p, l, "a", "b", "y").collect()


def test_csv_keeps_blanks_quotes_and_lines(spark, tmp_path):
    rows = [("A", "B", '  two "quotes"\nand, a line '), ("C", "D", "   ")]
    df = spark.createDataFrame(rows, Tb.PAIR_EVENTS)
    Tb.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in Tb.read_csv(spark, str(tmp_path / "c"), Tb.PAIR_EVENTS).collect()) == sorted(rows)


def test_file_manifest(spark, tmp_path):
    import hashlib
    (tmp_path / "f.bin").write_bytes(b"abc")
    r = Tb.file_manifest(spark, str(tmp_path / "*.bin")).first()
    assert (r["file"], r["bytes"], r["sha256"]) == ("f.bin", 3, hashlib.sha256(b"abc").hexdigest())


def test_train_graph_has_no_held_out_edge(spark):
    t = spark.createDataFrame([("A", "B", 0, 1, 3), ("A", "C", 0, 2, 1)], "a string, b string, ia bigint, ib bigint, y bigint")
    h = spark.createDataFrame([("A", "C")], "a string, b string")
    got = sorted(tuple(r) for r in G.kg_train_graph(None, t, h).collect())
    assert got == [(0, 1, 15), (1, 0, 32)]


def test_profile_components_match_svd(spark):
    g = np.random.default_rng(0)
    m = (g.random((60, 40)) < 0.3).astype(float)
    fp = spark.createDataFrame([(f"E{i:03d}", [int(b) for b in np.flatnonzero(m[i])]) for i in range(60)], "entity_id string, bits array<bigint>")
    inter = m @ m.T
    sims = inter / (m.sum(1)[:, None] + m.sum(1)[None] - inter)
    centred = sims - sims.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    pca = ProfilePCA(fp, 4, iterations=3, block_rows=16)
    assert np.allclose(pca.explained_variance, s[:4] ** 2 / 59, rtol=1e-3)
    got = {r["entity_id"]: np.array(r["pc"]) for r in pca.transform(fp).collect()}
    pc = np.stack([got[f"E{i:03d}"] for i in range(60)])
    want = centred @ vt[:4].T
    for j in range(3):
        assert abs(np.corrcoef(pc[:, j], want[:, j])[0, 1]) > 0.999


def test_profile_products_come_in_few_large_tiles(spark):
    """The thin matrix travels once for each block of entities: their number must not grow with the rows."""
    g = np.random.default_rng(12)
    m = g.random((150, 40)) < 0.3
    m[7] = False
    fp = spark.createDataFrame([(f"E{i:03d}", [int(b) for b in np.flatnonzero(m[i])]) for i in range(150)], "entity_id string, bits array<bigint>")
    pca = ProfilePCA(fp.where("entity_id < 'E140'"), 3, iterations=1, block_rows=2)
    assert pca.blocks.count() <= 18
    thin = g.normal(size=(140, 4))
    got = pca._product(fp, spark.createDataFrame([(f"E{i:03d}", [float(x) for x in thin[i]]) for i in range(140)], "entity_id string, v array<double>"))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r["entity_id"]: r["v"] for r in got.collect()}
    both = (m[:, None] & m[None, :140]).sum(2)
    want = both / np.maximum((m[:, None] | m[None, :140]).sum(2), 1e-8) @ thin
    assert len(got) == 150 and np.allclose([got[f"E{i:03d}"] for i in range(150)], want, atol=1e-4)


def test_draws_of_a_bucket_are_counted_at_once(spark, monkeypatch):
    """Blocks of draws grow with the rows; each must not cost a vector of the whole bucket."""
    monkeypatch.setattr(B, "DRAW_BLOCK", 7)
    draws = B._draw_blocks(spark, 60, 120, 0).toPandas()
    calls, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    times = B._times(draws, 120)
    assert len(draws) == 9 * 3 and len(calls) == 1 and (times.sum(0) == 60).all()
    ids = spark.range(60).withColumnRenamed("id", "row_id")
    pos = {r["row_id"]: r["pos"] for r in B.hash_positions(ids).collect()}
    plain = {(r["rep"], r["row_id"]): r["m"] for r in B.hash_multiplicities(ids, 120, 0).collect()}
    assert all(times[pos[i], rep] == plain.get((rep, i), 0) for i in range(60) for rep in range(120))
    rows = spark.createDataFrame([(np.array(v, ">u2").tobytes(),) for v in ([0, 3, 9], [12, 0, 300])], "times binary")
    got = [tuple(r["t"]) for r in rows.select(B.times_digest(F.col("times")).alias("t")).collect()]
    md5 = lambda x: __import__("hashlib").md5(x).hexdigest()
    assert sorted(got) == [(12, 2, md5(b"0,3,9")), (312, 2, md5(b"12,0,300"))]


def test_similarity_tiles_equal_brute_force(spark):
    g = np.random.default_rng(1)
    m = g.random((30, 50)) < 0.3
    fp = spark.createDataFrame([(f"E{i:02d}", [int(b) for b in np.flatnonzero(m[i])]) for i in range(30)], "entity_id string, bits array<bigint>")
    rows = X.similarity_cross(fp, fp.where("entity_id < 'E20'"), block_rows=8).collect()
    seen = 0
    for r in rows:
        i = int(r["entity_id"][1:])
        for ref, s in zip(r["ref_ids"], r["sims"]):
            j = int(ref[1:])
            assert s == pytest.approx((m[i] & m[j]).sum() / (m[i] | m[j]).sum())
            seen += 1
    assert seen == 30 * 20


def test_a_task_holds_one_similarity_tile(spark):
    """No Arrow batch of tiles: each is a group of its own."""
    fp = spark.createDataFrame([(f"E{i:02d}", [i % 7]) for i in range(40)], "entity_id string, bits array<bigint>")
    plan = X.similarity_cross(fp, fp, block_rows=4)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "ArrowEvalPython" not in plan
    assert X.similarity_cross(fp, fp.limit(0)).count() == 0


def test_similarity_join_equals_brute_force(spark):
    g = np.random.default_rng(3)
    m = g.random((90, 40)) < g.random((90, 1)) * 0.6
    m[:, 0] |= g.random(90) < 0.8  # a bit that most entities have
    m[10:14] = m[10]
    m[20] = False
    fp = spark.createDataFrame([(f"E{i:02d}", [int(b) for b in np.flatnonzero(m[i])]) for i in range(90)], "entity_id string, bits array<bigint>")
    ref = fp.where("entity_id < 'E60'")
    for num, den, hot in ((3, 10, 4096), (1, 2, 7), (9, 10, 1)):
        got = {(r["entity_id"], r["ref_id"]): (r["shared"], r["sim"]) for r in X.similarity_join(fp, ref, num, den, hot).collect()}
        want = {}
        for i in range(90):
            for j in range(60):
                shared, union = int((m[i] & m[j]).sum()), int((m[i] | m[j]).sum())
                if union and den * shared >= num * union:
                    want[f"E{i:02d}", f"E{j:02d}"] = shared, pytest.approx(shared / union)
        assert got == want
    rows = X.similarity_join(fp, ref, 9, 10).count()
    assert rows == len({(i, j) for i in range(90) for j in range(60) if (m[i] | m[j]).any() and 10 * (m[i] & m[j]).sum() >= 9 * (m[i] | m[j]).sum()})
    assert X.similarity_join(fp.limit(0), ref).count() == 0


def test_models_predict_and_resume(spark, tmp_path):
    g = np.random.default_rng(2)
    y = g.integers(0, 3, 300)
    pdf = pd.DataFrame(g.random((300, 24)), columns=Md.BIO)
    for c in Md.BIO[:12]:
        pdf[c] = y + 0.1 * pdf[c]
    pdf = pdf.assign(a=[f"A{i}" for i in range(300)], b="B", y=y, fold=[-1 if i % 5 == 0 else i % 2 + 1 for i in range(300)])
    d = Md.assemble(spark.createDataFrame(pdf), with_fp=False).select("a", "b", "y", "fold", "features").cache()
    path, calls = str(tmp_path / "runs"), []

    def fit(train, seed):
        calls.append(seed)
        return Md.tree_classifier(train, trees=5, depth=3, seed=seed)

    runs = Md.cv_train_eval(d, {"forest": fit}, [1], path, n_folds=2)
    assert runs.count() == 120 and len(calls) == 2
    Md.cv_train_eval(d, {"forest": fit}, [1], path, n_folds=2)
    assert len(calls) == 2  # finished runs are not fitted again
    acc = M.metrics_table(runs, ["method", "fold", "seed", "test_set"]).collect()
    assert all(r["accuracy"] > 0.9 for r in acc)


def test_unknown_ids_stay_with_null(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 1.0])], "id bigint, v array<double>")
    q = spark.createDataFrame([(2, 1), (1, 9)], "drug_a bigint, drug_b bigint")
    rel = [[c, 1.0] for c in range(5)]
    out = {r["drug_b"]: r for r in C.score_pairs(q, emb, "id", "v", {"m": lambda a, b: C.diagonal_scores(a, b, rel)}).collect()}
    assert out[1]["in_index"] and out[1]["drug_a_canon"] == 1 and out[1]["m_pred"] == 4
    assert not out[9]["in_index"] and out[9]["m_pred"] is None
    assert [r["id"] for r in C.unknown_ids(q, emb, "id").collect()] == [9]


def test_rows_without_id_take_their_place_in_the_file(spark, tmp_path):
    rows = [(c, (c * 3) % 5) for c in range(5)]
    spark.createDataFrame(rows, "y_test long, y_pred long").coalesce(1).write.parquet(str(tmp_path / "run=A_f1_s42"))
    from pairgrade.sources import runs as SR
    got = SR.compat_schema(SR.scan_runs(spark, str(tmp_path))).orderBy("row_id").collect()
    assert [(r.row_id, r.y_true, r.y_pred) for r in got] == [(i, *r) for i, r in enumerate(rows)]


def test_metric_by_name_without_probabilities(spark):
    from pairgrade.operators import metrics as M
    rows = spark.createDataFrame([("A", y, p) for y, p in ((0, 0), (1, 1), (2, 2), (2, 1))], "m string, y_true long, y_pred long")
    table = M.hard_metrics(M.confusion_cells(rows, ["m"]), ["m"])
    assert abs(M.metric_by_name(table, ["m"], "macro_auroc", rows).first().value - (1 + 5 / 6 + 3 / 4) / 3) < 1e-9
    with pytest.raises(ValueError):
        M.metric_by_name(table, ["m"], "nothing", rows)


def test_draws_reach_past_32_bits(spark):
    from pairgrade.functions.hashing import draw_index, keyed_sha256
    n = 40_000_000_000
    got = spark.range(2000).select(draw_index(keyed_sha256(F.col("id")), n).alias("d")).toPandas().d
    assert got.max() > 2**32 and 0.45 < (got > n / 2).mean() < 0.55


def test_ambiguous_names_stop_the_cascade(spark):
    from pairgrade.operators import mapping as Mp
    names = spark.createDataFrame([("E1", "abc", "x1"), ("E2", "abc", "x2"), ("E4", "other", "Abc"), ("E5", "straße", "x5")], "entity_id string, primary_name string, alias string")
    asked = spark.createDataFrame([("ABC",), ("abc page",), ("ＳＴＲＡＳＳＥ",), (None,)], "drug string")
    pages = spark.createDataFrame([("abc page", "E9"), ("ABC", "E1")], "drug string, entity_id string")
    got = {r.drug: (r.entity_id, r.method) for r in Mp.name_to_id(asked, names).collect()}
    assert got == {"ABC": (None, "ambiguous"), "abc page": (None, None), "ＳＴＲＡＳＳＥ": ("E5", "exact_primary"), None: (None, None)}
    assert {r.drug: r.entity_id for r in Mp.name_to_id(asked, names, pages=pages).collect()}["ABC"] == "E1"


def test_any_white_space_around_a_phrase(spark):
    rows = spark.createDataFrame([("The risk or severity of  Alpha  can be increased",), ("  ",)], "description string")
    tiers = spark.createDataFrame([("alpha", 4)], "phrase string, tier long")
    assert [r.tier for r in L.tier_cascade(rows, tiers).collect()] == [4, 1]


def test_packed_draws_equal_exploded_draws(spark, monkeypatch):
    monkeypatch.setattr(B, "POSITIONS", 16)
    monkeypatch.setattr(B, "DRAW_BLOCK", 30)
    monkeypatch.setattr(B, "REP_BLOCK", 3)
    g = np.random.default_rng(5)
    rows = [(k, int(i), int(g.integers(0, 12)), int(g.integers(0, 12)), int(g.integers(0, 3)), int(g.integers(0, 3)), int(g.integers(0, 3))) for k in ("x", "y") for i in range(100)]
    rows += rows[:5]  # a repeated row counts twice
    al = spark.createDataFrame(rows, "k string, row_id bigint, a bigint, b bigint, y_true bigint, pred_a bigint, pred_b bigint")
    key = lambda df: sorted(map(tuple, df.select("k", "rep", "y_true", "pred_a", "pred_b", "n").collect()))
    want = B.resampled_cells(al, B.hash_multiplicities(al.select("row_id"), 7, 0), ["k"])
    assert key(B.resampled_vectors(al, ["k"], 7)) == key(want)
    ids = al.select(F.explode(F.array("a", "b")).alias("entity_id"))
    many = B.hash_multiplicities(ids, 7, 0, id_col="entity_id")
    assert key(B.cluster_vectors(al, ["k"], 7)) == key(B.cluster_cells(al, many, ["k"]))
    packed = {r["entity_id"]: np.frombuffer(r["times"], ">u2").tolist() for r in B.packed_multiplicities(ids, 7).collect()}
    for r in many.collect():
        assert packed[r["entity_id"]][r["rep"]] == r["m"]
    assert sum(map(sum, packed.values())) == 7 * len(packed)
    assert B.resampled_vectors(al.limit(0), ["k"], 7).count() == 0 and B.cluster_vectors(al.limit(0), ["k"], 7).count() == 0


def test_saved_models_grade_queries(spark, tmp_path):
    from pairgrade.operators import boosting, perceptron

    g = np.random.default_rng(3)
    ids = [f"E{i}" for i in range(12)]
    fp = spark.createDataFrame([(e, sorted(int(b) for b in g.choice(40, 5, replace=False))) for e in ids], "entity_id string, bits array<bigint>")
    attrs = spark.createDataFrame([(e, "enzyme", f"n{i % 3}", "substrate") for i, e in enumerate(ids)], "entity_id string, kind string, name string, action string")
    sets = X.entity_sets(attrs)
    pairs = spark.createDataFrame([(ids[i], ids[j], (i + j) % 5) for i in range(12) for j in range(i + 1, 12)], "a string, b string, y bigint")
    rows = Md.tier_rows(pairs, sets, fp)
    models = {"forest": Md.boosted_classifier(rows, rounds=2, depth=2), "mlp": Md.mlp_weighted(rows, hidden=(4,), epochs=1)[0]}
    path = str(tmp_path / "models")
    Md.save_models(spark, models, path)
    loaded = Md.load_models(spark, path)
    assert list(loaded) == ["forest", "mlp"] and isinstance(loaded["forest"], boosting.BoostedTrees) and isinstance(loaded["mlp"], perceptron.Perceptron)
    with pytest.raises(KeyError):
        Md.load_models(spark, path, ["other"])
    q = spark.createDataFrame([("E3", "E1"), ("E1", "E3"), ("E1", "E99"), (None, "E1"), ("E1", "E1"), ("E3", "E1")], "drug_a string, drug_b string").withColumn("bits", F.lit("clash"))
    got = Md.score_models(q, loaded, sets, fp).collect()
    assert len(got) == 6 and sum(r["in_index"] for r in got) == 3
    plain = {r["a"]: r["p"] for r in models["forest"].predict(rows.where("a = 'E1' and b = 'E3'"), ["a"]).collect()}["E1"]
    for r in got:
        if r["in_index"]:
            assert (r["drug_a_canon"], r["drug_b_canon"]) == ("E1", "E3") and [r[f"forest_p{c}"] for c in range(5)] == pytest.approx(plain)
            assert r["forest_pred"] == int(np.argmax(plain)) and sum(r[f"mlp_p{c}"] for c in range(5)) == pytest.approx(1)
        else:
            assert r["forest_pred"] is None and r["mlp_p0"] is None


def test_runs_restart_and_every_run_has_a_status(spark, tmp_path):
    from tests.test_boosting import make

    bits, dense, y, _ = make(150, 4)
    rows = [(f"A{i}", "B", int(c), -1 if i % 5 == 0 else i % 2 + 1, b, [0.0] * 24) for i, (b, c) in enumerate(zip(bits, y))]
    d = spark.createDataFrame(rows, "a string, b string, y bigint, fold bigint, bits array<int>, dense array<double>").cache()
    calls, fail = [], {"on": True}

    def fit(train, valid, seed):
        calls.append((train.where(valid).count(), seed))
        if fail["on"] and seed == 2:
            raise RuntimeError("lost")
        return Md.boosted_classifier(train, valid=valid, rounds=1, depth=2, seed=seed)

    path = str(tmp_path / "store")
    first = {(r["fold"], r["seed"]): r for r in Md.train_runs(d, {"forest": fit}, [1, 2], path, n_folds=2).collect()}
    assert len(calls) == 4 and {k: r["state"] for k, r in first.items()} == {(1, 1): "ok", (2, 1): "ok", (1, 2): "failed", (2, 2): "failed"}
    assert first[1, 2]["error"] == "RuntimeError: lost" and first[1, 2]["accuracy"] is None and first[1, 1]["n_rows"] == 30 and first[1, 1]["accuracy"] is not None
    fail["on"] = False
    second = Md.train_runs(d, {"forest": fit}, [1, 2], path, n_folds=2).collect()
    assert len(calls) == 6 and all(r["state"] == "ok" and r["n_rows"] == 30 for r in second)


def test_cluster_vectors_travel_short_and_unsorted(spark):
    m = np.random.default_rng(1).poisson(1, (3, 1000))
    m[1, 5], m[2] = 300, 255
    raw = pd.Series([x.astype(">u2").tobytes() for x in m])
    short = B._shortened(raw)
    assert all((B._restored(x) == y).all() for x, y in zip(short, m)) and len(short[0]) < 300  # 2,000 bytes before
    assert (B._restored(B._shortened(pd.Series([b""]))[0]) == []).all()
    al = spark.createDataFrame([("x", f"e{i % 7}", f"e{i % 5}", i % 3, i % 2, i % 4) for i in range(60)], "k string, a string, b string, y_true bigint, pred_a bigint, pred_b bigint")
    ids = al.select(F.explode(F.array("a", "b")).alias("entity_id"))
    got = B.cluster_vectors(al, ["k"], 9)
    want = B.cluster_cells(al, B.hash_multiplicities(ids, 9, 0, [], "entity_id"), ["k"])
    rows = lambda d: sorted(tuple(r[c] for c in ("k", "rep", "y_true", "pred_a", "pred_b", "n")) for r in d.collect())
    assert rows(got) == rows(want)


def test_similarity_links_count_the_join_with_a_row_for_each_entity(spark):
    g = np.random.default_rng(4)
    m = g.random((120, 50)) < g.random((120, 1)) * 0.6
    m[20:60] = m[20]  # a class of 40 entities: 1,600 pairs in the join
    m[70] = False
    fp = spark.createDataFrame([(f"E{i:03d}", [int(b) for b in g.permutation(np.flatnonzero(m[i]))]) for i in range(120)], "entity_id string, bits array<bigint>")
    ref = fp.where("entity_id < 'E090'")
    equal = {}
    for i in range(120):
        equal.setdefault(m[i].tobytes(), f"E{i:03d}")
    for num, den, rows in ((3, 10, 1024), (1, 2, 7), (9, 10, 1)):
        out = X.similarity_links(fp, ref, num, den, rows)
        got = {r["entity_id"]: (r["class_id"], r["n_links"]) for r in out.collect()}
        both, union = (m[:, None] & m[None, :90]).sum(2), (m[:, None] | m[None, :90]).sum(2)
        n = ((union > 0) & (den * both >= num * union)).sum(1)
        assert got == {f"E{i:03d}": (equal[m[i].tobytes()], n[i]) for i in range(120)} and out.count() == 120
    joined = {r["entity_id"]: r["count"] for r in X.similarity_join(fp, ref, 9, 10).groupBy("entity_id").count().collect()}
    assert joined == {e: k for e, (_, k) in got.items() if k}
    assert X.similarity_links(fp.limit(0), ref).count() == 0 and X.similarity_links(fp, ref.limit(0)).agg(F.sum("n_links")).first()[0] == 0


def test_similarity_join_query_has_a_row_for_each_similar_pair(spark):
    """Not one for each entity: every pair of the product that is similar enough, and no other."""
    bits = {r["entity_id"]: set(r["bits"]) for r in Inputs(spark, SF).fps.collect()}
    got = {(r["entity_id"], r["ref_id"]): (r["shared"], r["sim"]) for r in entry.queries()["similarity_join"](spark, SF).collect()}
    refs = {e for _, e in got}
    want = {(e, r): (len(bits[e] & bits[r]), len(bits[e] & bits[r]) / len(bits[e] | bits[r])) for e in bits for r in refs}
    assert len(refs) > 1 and got == {k: v for k, v in want.items() if v[1] >= 0.3} and len(got) > len(bits)


def test_runs_are_trained_at_the_same_time(spark, tmp_path):
    import threading

    from tests.test_boosting import make

    bits, dense, y, _ = make(60, 4)
    rows = [(f"A{i}", "B", int(c), -1 if i % 5 == 0 else i % 2 + 1, b, [0.0] * 24) for i, (b, c) in enumerate(zip(bits, y))]
    d = spark.createDataFrame(rows, "a string, b string, y bigint, fold bigint, bits array<int>, dense array<double>").cache()
    both = threading.Barrier(2, timeout=60)

    def fit(train, valid, seed):
        both.wait()  # broken if one run is not begun before another ends
        return Md.boosted_classifier(train, valid=valid, rounds=1, depth=2, seed=seed)

    out = Md.train_runs(d, {"forest": fit}, [1], str(tmp_path / "store"), n_folds=2).collect()
    assert [(r["state"], r["n_rows"]) for r in out] == [("ok", 12)] * 2

    one = Md.assemble(d.select("*", *[F.get("dense", F.lit(j)).alias(c) for j, c in enumerate(Md.BIO)]), with_fp=False).select("a", "b", "y", "fold", "features").cache()

    def forest(train, seed):
        both.wait()
        return Md.tree_classifier(train, trees=1, depth=2, seed=seed)

    assert Md.cv_train_eval(one, {"forest": forest}, [1], str(tmp_path / "runs"), n_folds=2).count() == 24


def test_audit_finds_each_fault_and_no_other(spark):
    from pairgrade.operators import quality as Q

    rows = [(f"a{i}", "b", [float(i), 0.5, None if i == 9 else 2.0]) for i in range(12)]
    expected = spark.createDataFrame(rows, "a string, b string, features array<float>")
    assert Q.audit_features(expected.repartition(3), expected, ["a", "b"]).count() == 0
    bad = {r[0]: list(r[2]) for r in rows}
    bad["a1"][1] = 0.75
    bad["a2"] = bad["a2"][:2]
    bad["a3"] = [2.0, 3.0, 0.5]
    bad["a4"][0] = 4.0000001
    bad["a9"][2] = 0.0
    bad["a8"][0], bad["a8"][1] = float("nan"), -0.5
    del bad["a5"]
    stored = [(k, "b", v) for k, v in bad.items()] + [("a6", "b", bad["a6"]), ("zz", "b", [1.0, 2.0, 3.0])]
    got = {(r["a"], r["fault"], r["place"]) for r in Q.audit_features(spark.createDataFrame(stored, "a string, b string, features array<float>"), expected, ["a", "b"]).collect()}
    assert got == {("a1", "value", 1), ("a2", "width", None), ("a3", "order", None), ("a5", "missing", None), ("a6", "duplicate", None), ("a8", "value", 0), ("a8", "value", 1), ("a9", "value", 2), ("zz", "extra", None)}
    assert Q.audit_features(expected.limit(0), expected.limit(0), ["a", "b"]).count() == 0


def test_state_documents_of_any_layout(spark):
    from pairgrade.sources import runs as SR

    docs = ['{"mode": "full:drug", "runs": {"A_f1_s2": {"method": "A", "fold": 1, "seed": 2, "accuracy": 0.5, "per_class_f1": [0.1, 0.2], "n_test": 7, "new": 3, "note": "x", "nested": {"a": 1}},'
            ' "B": {"method": "B", "macro_f1": null, "test_set": "", "split_mode": "odd", "n_eval": 0}, "C": {"method": "C", "accuracy": 1, "error": "lost"},'
            ' "D": {"accuracy": 1}, "E": "text", "F": null, "G": {"method": "G", "qwk": 1}}}', '{"runs": {}}', "not json", None,
            '{"runs": {"H": {"method": "H", "macro_f1": 1, "split_mode": "pair", "fold": "3", "new": "0.25"}}}']
    df = spark.createDataFrame([(d,) for d in docs], "state string")
    got = {r["run_key"]: r for r in SR.state_table(df).collect()}
    assert got.keys() == {"A_f1_s2", "B", "H"}
    a, b, h = (got[k] for k in ("A_f1_s2", "B", "H"))
    assert (a["split"], a["test_set"], a["n"], a["accuracy"], a["f1_c1"], a["f1_c2"], a["qwk"]) == ("drug", "test", 7, 0.5, 0.2, None, None)
    assert (b["split"], b["fold"], b["n"], b["macro_f1"], b["test_set"]) == ("drug", 0, 0, None, "test") and (h["split"], h["fold"]) == ("pair", 3)
    long = {(r["run_key"], r["metric"]): (r["value"], r["is_known"]) for r in SR.state_long(df).collect()}
    assert long == {("A_f1_s2", "accuracy"): (0.5, True), ("A_f1_s2", "new"): (3.0, False), ("H", "macro_f1"): (1.0, True), ("H", "new"): (0.25, False)}


def test_pairs_carry_numbers_for_names(spark):
    long = ["Cytochrome P450 " + "x" * 500 + str(i) for i in range(6)] + ["MDR1", "OATP1B1"]
    rows = [(f"E{i}", kind, long[(i * 3 + j) % 8], action) for i in range(5) for j in range(4)
            for kind, action in (("enzyme", "substrate"), ("transporter", "inhibitor" if j % 2 else None), ("target", "agonist"))] + [("E9", "target", None, None), ("E9", "enzyme", long[0], "inducer")]
    sets = X.entity_sets(spark.createDataFrame(rows, "entity_id string, kind string, name string, action string"))
    pairs = spark.createDataFrame([(f"E{i}", f"E{j}", 1) for i in (0, 1, 2, 3, 4, 7, 9) for j in (0, 1, 2, 3, 4, 7, 9)] + [(None, "E0", 1)], "a string, b string, y int")
    found = {(r.a, r.b): r for r in X.bio_pair_features(pairs, sets).collect()}
    assert len(found) == 36  # E7 and null are unknown
    held = {r.entity_id: r for r in sets.collect()}
    for (a, b), r in found.items():
        x, z = held[a], held[b]
        cyp = [{n for n in e.enzyme_substrate if n.startswith("Cyto")} for e in (x, z)]
        assert r.f00 == len(cyp[0] & cyp[1]) / max(len(cyp[0] | cyp[1]), 1)
        assert r.f15 == len({*x.transporter_all} & {*z.transporter_all}) and r.f23 == len({*x.target_all} & {*z.target_all})
        assert r.f16 == r.f23 / max(len({*x.target_all} | {*z.target_all}), 1)
    ends = X.bio_entities(sets)
    assert all(f.dataType.elementType.simpleString() == "int" for f in ends.schema if f.dataType.typeName() == "array")
    assert ends.count() == sets.count()


def test_negative_candidates_carry_small_numbers(spark, monkeypatch):
    """Bits of two bytes and a number for each name travel with a candidate; the rows are those of the wide columns."""
    from pairgrade.operators import negatives as N

    fp = spark.createDataFrame([(f"E{i:02d}", [i % 9, 100 + i % 4, 200 + i]) for i in range(30)], "entity_id string, bits array<bigint>")
    sets = spark.createDataFrame([(f"E{i:02d}", [f"x{i % 5}"], [f"t{i % 3}"]) for i in range(30)], "entity_id string, enzyme_all array<string>, target_all array<string>")
    seen, plain = [], N.attr_disjoint
    monkeypatch.setattr(N, "attr_disjoint", lambda c, s: seen.append((s, "smallint" in c._jdf.queryExecution().analyzed().toString())) or plain(c, s))
    got = {(r["a"], r["b"]) for r in N.negative_sampling(fp, fp.limit(0).selectExpr("entity_id as a", "entity_id as b"), sets, 20).collect()}
    assert seen[0][1] and dict(seen[0][0].dtypes)["enzyme_all"] == "array<int>"
    assert len(got) == 20 and all(a < b and (int(a[1:]) - int(b[1:])) % 5 and (int(a[1:]) - int(b[1:])) % 3 for a, b in got)
