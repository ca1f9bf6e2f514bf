"""Operators that look across rows: search, near-copies, mixing, lines, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairgrade.llm import linededup, mixing, nearcopies, topk
from pairgrade.llm.components import components
from pairgrade.llm.registry import ORACLE, QUERIES
from tests.llm import brute
from tools.check import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    cur = duck(SF).execute(ORACLE[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_branch_and_bound_is_exact():
    rng = np.random.default_rng(2)
    ids, held = np.arange(500), rng.integers(-900, 900, (500, 70))
    held[100:110] = held[100]
    got = topk.best(held[:40], ids, held.T.copy(), ids[:40], 10)
    for q, (best, score) in enumerate(got):
        full = held @ held[q]
        want = sorted((i for i in ids if i != q), key=lambda i: (-full[i], i))[:10]
        assert best.tolist() == want and score.tolist() == full[want].tolist()
    big = held[:20].astype(np.int64) << 18
    want = big @ big[0]
    assert topk.best(big[:1], ids[:20], big.T.copy(), ids[:1], 3)[0][1].tolist() == sorted(want[1:], reverse=True)[:3]


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [-1.0, 0.0005]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    vectors = df.withColumn("vector", topk.scaled(F.col("embedding")))
    got = [tuple(r) for r in topk.search(vectors, F.col("vec_id") == 0, 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1024 * 1024 + 512 * 512), (0, 2, 1, 1024 * 1024 + 512 * 512), (0, 3, 6, -1024 * 1024)]
    assert topk.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_search_stops_before_scores_overflow(spark):
    for big in (3e9, 1e17):
        df = spark.createDataFrame([(100, [big, 1.0]), (200, [big, 2.0])], "vec_id long, embedding array<double>")
        with pytest.raises(ValueError, match="64 bits"):
            topk.search(df.withColumn("vector", topk.scaled(F.col("embedding"))), F.col("vec_id") % 100 == 0, 10)
    df = spark.createDataFrame([(100, [1e6, 1.0]), (200, [1e6, 2.0])], "vec_id long, embedding array<double>")
    got = topk.search(df.withColumn("vector", topk.scaled(F.col("embedding"))), F.col("vec_id") % 100 == 0, 10).collect()
    assert {r["score"] for r in got} == {(1024 * 10**6) ** 2 + 2 * 1024**2}


def test_mixing_of_equal_keys(spark):
    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 3).alias("size"))
    other = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("b").alias("source"), F.lit(5).cast("long").alias("size"))
    out = mixing.copies(rows.union(other)).toPandas()
    assert len(out) == 50_300
    for source, part in out.groupby("source"):
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= 5
        assert (part.groupby("size")["copies"].agg(lambda c: c.max() - c.min()) <= 1).all() and part["copies"].max() <= 2
    again = mixing.copies(rows.union(other).repartition(3)).toPandas()
    key = ["source", "size", "copies"]
    assert out[key].value_counts().to_dict() == again[key].value_counts().to_dict()


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 240)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        if u != v:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _texts(rng, n):
    stock = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(stock) for _ in range(rng.choice([3, 8, 20, 60]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(stock)
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies(spark, size):
    rng = random.Random(size)
    base = [f"c{i}" for i in range(80)]
    group = [" ".join(w if rng.random() > 0.04 else f"x{rng.randrange(9999)}" for w in base) for _ in range(330)]
    texts = [None, "", " ", "one", "One", "one two", "ONE two", *_texts(rng, 60), *group, group[0].upper()]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows] + [(3, "one", "z"), (None, "one", "z")], "doc_id long, text string, kept string")
    got = [tuple(r) for r in nearcopies.near_copies(df, shingle=size).collect()]
    assert len(got) == len(rows) + 2 and (None, 1, None, True) in got
    assert {r[0]: r[1:] for r in got if r[0] is not None} == brute.near_copies(rows, size)
    assert nearcopies.near_copies(df.limit(0), shingle=size).count() == 0


def test_confirm_both_ways():
    rng = np.random.default_rng(3)
    a = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    pairs = np.argwhere(np.ones((30, 30)))
    want = [100 * len(set(a[i]) & set(a[j])) >= 55 * len(set(a[i]) | set(a[j])) for i, j in pairs]
    assert nearcopies.confirm(a, a, pairs, 55).tolist() == want
    assert nearcopies.confirm(a, a, pairs[:50], 55).tolist() == want[:50]


def test_line_dedup(spark):
    rng = random.Random(9)
    line = [f"word{i}" for i in range(40)]
    near = lambda k: " ".join(w if i % 40 >= k else f"n{rng.randrange(10**6)}" for i, w in enumerate(rng.sample(line, 40)))
    texts = [None, "", "a b", "a b\na b", "x y z\n\nx y z\nz  y x", *("\n".join(near(rng.randrange(4)) for _ in range(3)) for _ in range(60)), *_texts(rng, 40), "tail\n" + " ".join(line)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(4, texts[4], 5)], "doc_id long, text string, line int")
    want = brute.removed_lines(rows)
    assert sum(map(len, want.values())) > 100
    got = linededup.report(df).collect()
    assert len(got) == len(rows) + 1 and all(list(r.removed) == want[r.doc_id] for r in got)
    held = {i: t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]) for i, t in rows}
    out = linededup.dedup(df).collect()
    assert len(out) == len(rows) + 1 and all(r.text == held[r.doc_id] and r.line == 5 for r in out)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_settle_keeps_mass():
    rng = np.random.default_rng(4)
    size, part = rng.integers(1, 100, 500).astype(float), rng.random(500)
    for seed in range(20):
        out = mixing.settle(size, part, np.random.default_rng(seed))
        assert ((out == 0) | (out == 1)).sum() >= 499 and abs((out * size).sum() - (part * size).sum()) < 1e-6
    mean = np.mean([mixing.settle(size[:6], part[:6], np.random.default_rng(s)) for s in range(4000)], 0)
    assert np.abs(mean - part[:6]).max() < 0.05


def test_mixing_targets_and_odd_rows(spark):
    rows = [(i, "abcde"[i % 5] if i % 11 else None, i % 37) for i in range(3000)] + [(None, "a", 5), (7, "c", 0), (7, "c", 7), (7, "c", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash"))
    got = mixing.copies(df, fan=50)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.copies(df, fan=50).collect())) and got.count() == len(rows)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, total = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    open_ = set(order)
    while total > 1e-6 and open_:
        w = sum(weight[s] for s in open_)
        share = {s: total * weight[s] / w for s in open_}
        total = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                total += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    table = got.toPandas()
    table["source"] = table["source"].where(table["source"].notna(), None)
    for s in order:
        own = table[table["source"].isna() if s is None else table["source"] == s]
        assert np.allclose(own["target"], target[s]) and (own["source_size"] == sizes[s]).all()
        assert abs((own["copies"] * own["size"]).sum() - target[s]) <= 37
    assert table["copies"].between(0, 2).all()
    assert mixing.copies(df.limit(0)).count() == 0
    assert {r.copies for r in mixing.copies(df.withColumn("size", F.lit(0).cast("long")).limit(20)).collect()} == {0}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, 0), (10**6, "", "en", None, 0)], docs.schema)
    again = docs.limit(5)
    docs = docs.unionByName(odd).unionByName(again).withColumn("_copies", F.lit("clash"))
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF).persist()
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        seen.append(out)
    _, rules, lines, copies, mixed, coded = seen
    assert set(lines.select("doc_id").distinct().collect()) == set(rules.select("doc_id").distinct().collect())
    kept = {r.doc_id: r.text for r in copies.collect()}
    brute_kept = brute.near_copies([(r.doc_id, r.text) for r in lines.dropDuplicates(["doc_id"]).collect()], 5)
    assert set(kept) == {i for i, (_, _, k) in brute_kept.items() if k} and len(kept) == copies.count()
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(times) <= set(kept) and max(times.values()) <= 2
    assert coded.count() == mixed.count() and coded.agg(F.sum("n_tokens")).first()[0] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
