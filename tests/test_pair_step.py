"""The shared pair step, cold-start splits, skipped pairs and entity XML: one pass, bounded tasks, the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from pairgrade.operators import features as X, label as L, pairs as P, splits as S
from pairgrade.plans import q_models as Q
from pairgrade.plans.inputs import Inputs
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def made(spark, tmp_path):
    """Line items with repeats, nulls and equal ends, and 40 parts."""
    li = [(o, p, s) for o in range(6) for p in (*range(8), None) for s in (1, 2, None)]
    spark.createDataFrame(li + li[:20], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    part = spark.range(40).selectExpr("id as p_partkey", "concat('n', id) as p_name", "'Brand#1' as p_brand", "'ECONOMY' as p_type", "cast(id as int) as p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return Inputs(spark, str(tmp_path))


def test_pair_events_are_the_rows_of_the_view(made):
    want = made._sql("v_pair_events", "lineitem", "part")
    got = made.pair_events
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 0
    assert sorted(made.pairs.collect()) == sorted(P.keep_first_pair(made.labelled, "id1", "id2", "ingest_pos", {"y": "tier"}).collect())


def test_pairs_are_shuffled_once(spark):
    src = Inputs(spark, SF)
    assert plan(src.pairs).count("Exchange hashpartitioning") == 1
    slow = P.stage_distribution(src.labelled, "id1", "id2", "ingest_pos", "tier")
    fast = P.stage_distribution(src.labelled_pairs, "pair_a", "pair_b", "ingest_pos", "tier", ordered=True)
    assert sorted(fast.collect()) == sorted(slow.collect())


def test_blank_and_generic_texts_need_no_lookup(spark):
    texts = [None, "", " \t ", "The RISK or severity of adverse events", "the risk or severity of x", "the risk or severity of  Foo  can be",
             "the risk or severity of   can be", "other"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, description string")
    got = L.tier_cascade(df, spark.createDataFrame([("foo", 4)], "phrase string, tier long"))
    assert [r.tier for r in got.orderBy("i").collect()] == [1, 1, 1, 1, 3, 4, 3, 1]
    assert "\\s+" not in plan(got.select("tier")).split("regexp_extract")[0]  # no trimming of whole texts


def test_cold_start_joins_pairs_once_for_all_seeds(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", None, 3), ("a", "b", 1)], "a string, b string, y int")
    held = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", False), (2, "b", True), (2, "c", True)], "seed long, entity_id string, held_out boolean")
    got = S.cold_start_split(pairs, held, [1, 2])
    want = [(1, "a", "b", 1, "S1"), (1, "a", "b", 1, "S1"), (1, "a", "c", 2, "S1"), (1, "b", None, 3, "KK"),
            (2, "a", "b", 1, "S1"), (2, "a", "b", 1, "S1"), (2, "a", "c", 2, "S1"), (2, "b", None, 3, "S1")]
    assert sorted(map(str, (tuple(r) for r in got.select("seed", "a", "b", "y", "part").collect()))) == sorted(map(str, want))
    assert all("seed" not in line for line in plan(got).splitlines() if "Join" in line)


def test_cold_of_one_seed(spark):
    src = Inputs(spark, SF)
    one, every = src.cold(seeds=(42,)), src.cold()
    key = ["seed", "a", "b", "y", "part"]
    assert sorted(one.select(*key).collect()) == sorted(every.where("seed = 42").select(*key).collect())


def test_skipped_pairs_take_two_joins(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "x", 2), ("a", "x", 2), (None, "b", 3), ("x", "z", 4)], "a string, b string, y int")
    known = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "entity_id string")
    got = X.pair_skipped(pairs, known)
    assert got.columns == pairs.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("a", "x", 2), ("a", "x", 2), (None, "b", 3), ("x", "z", 4)]))
    assert sum("Join" in line for line in plan(X.pair_skipped(pairs, known)).splitlines()) == 2


def test_entity_xml_lies_in_files_of_bounded_size(made, monkeypatch):
    monkeypatch.setattr(Q, "XML_RECORDS", 10)
    path = Q._write_xml(made).removeprefix("file:")
    sizes = [sum(line.startswith("<drug ") for line in open(f"{path}/{f}")) for f in os.listdir(path) if f.startswith("part-")]
    assert sum(sizes) == 40 and max(sizes) <= 20
