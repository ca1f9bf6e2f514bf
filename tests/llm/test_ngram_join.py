"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrade.llm import ngram_join
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def corpus(rng, n):
    stock = [f"w{i}" for i in range(300)]
    passage = [rng.choice(stock) for _ in range(40)]
    out = []
    for _ in range(n):
        base = [rng.choice(stock) for _ in range(rng.choice([2, 4, 9, 40, 120]))]
        if rng.random() < 0.3:
            base[len(base) // 2:] = passage[:max(1, len(base) // 2)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(stock)
            out.append(rng.choice([" ", "\n", "  "]).join(copy if rng.random() < 0.9 else map(str.upper, copy)))
    return out


def got(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df, **options).collect()}


def want(rows, percent=85):
    return {i: x[:2] for i, x in brute.near_copies(rows, 4, percent).items()}


@pytest.mark.parametrize("options", [{}, {"most_rows": 3}, {"most_tokens": 60}, {"percent": 60}])
def test_links_are_exact(spark, options):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]  # many near-copies of one text, most of them not linked with each other
    group = [" ".join(base if k == 7 else [f"x{k}" if i == (k * 11) % 56 + 2 else w for i, w in enumerate(base)]) for k in range(40)]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(corpus(rng, 80) + group)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    result = got(df, **options)
    assert result == want(rows, options.get("percent", 85))
    assert len({c for _, c in result.values()}) < len(rows) - 60


def test_product_is_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50))) for _ in range(150)]
    n = np.array([len(s) for s in sets])
    for columns in (7, 4096):
        ngram_join.COLUMNS, before = columns, ngram_join.COLUMNS
        pairs = {(int(i), int(j)) for i, j in ngram_join._tile(sets, n, sets, n, 70)}
        ngram_join.COLUMNS = before
        both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        assert pairs == {(i, j) for i in range(150) for j in range(150) if 100 * both(i, j) >= 70 * (n[i] + n[j] - both(i, j))}


def test_odd_rows(spark):
    long = " ".join(f"v{i % 700} q{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c d e"), (None, "a b c d e"), (7, long), (8, long + " end"), (6, "a b c d e"), (9, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "cls": F.lit(1.5), "rep": F.lit(None)})
    out = sorted(map(tuple, ngram_join.ngram_join(df).collect()), key=str)
    grams = brute.shingles(long, 4)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (6, 2, 6), (None, 2, None), (7, len(grams), 7), (8, len(grams) + 1, 7), (9, 1, 9)], key=str)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(docs) == want([(r["doc_id"], r["text"]) for r in docs.collect()])
