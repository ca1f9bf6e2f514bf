"""Periodic runs against a plain search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairgrade.llm import queries, runs
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def plain_runs(w, exponent=4, least=6):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, exponent * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequences():
    rng = random.Random(11)
    for size in (1, 2, 3, 6):
        for _ in range(120):
            n = rng.randrange(0, 60)
            w = [rng.randrange(size) for _ in range(n)]
            if n > 8 and rng.random() < 0.7:
                a, p = rng.randrange(n), rng.randrange(1, 6)
                w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)] + [rng.randrange(size) for _ in range(rng.randrange(4))]
            yield w
    yield [0] * 3000
    yield [0, 1] * 700 + [0, 0, 1] * 500


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 8)])
def test_runs_are_exact(exponent, least):
    for w in sequences():
        if exponent < 4 and len(w) > 200:
            continue
        got = runs.runs_of(np.array(w, np.int64), exponent, least).tolist()
        assert list(map(tuple, got)) == plain_runs(w, exponent, least), w


def test_extensions_are_exact():
    rng = random.Random(3)
    w = [rng.randrange(1, 3) for _ in range(120)]
    places, turns = runs.SuffixTree(w).tour()
    assert places.tolist() == sorted(range(121), key=lambda i: w[i:])
    ext = runs.Extension(places, turns)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(121), np.arange(121)))
    i, j = i[i != j], j[i != j]
    want = [next((k for k in range(121) if a + k >= 120 or b + k >= 120 or w[a + k] != w[b + k])) for a, b in zip(i, j)]
    assert ext.of(i, j).tolist() == want
    assert runs.SuffixTree(w).tour(True)[0].tolist() == sorted(range(121), key=lambda i: [-x for x in w[i:]])


def test_texts(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x " * 9 + "é é " * 8, "one two three " * 5]
    for w in sequences():
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\n", " \x0b"]).join(f"w{x}é" for x in w))
    long = [str(rng.randrange(50)) for _ in range(300_000)]
    long[1000:200_000] = [f"p{i % 37}" for i in range(199_000)]
    texts += [" ".join(long), " ".join(["big"] * 5 + ["z" * 1_500_000] * 4)]
    df = spark.createDataFrame([(i // 2, i, t) for i, t in enumerate(texts)], "doc_id long, i long, text string").withColumns({"runs": F.lit("clash"), "row": F.lit(1)})
    got = {r["i"]: r for r in runs.find(df.repartition(5), keep=("i", "doc_id")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = brute.words(t)
        want = plain_runs(w) if len(w) < 10_000 else [(1000, 199_000, 37)]
        assert [tuple(r) for r in got[i]["runs"]] == want
        assert got[i]["collapsed"] == collapsed(w, want)
    assert runs.find(df.limit(0)).count() == 0


def contract(doc_id, text):
    w = brute.words(text)
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(w, found)))


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {k: t for k, t in docs.items() if len(brute.words(t)) < 1500}
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.op11(spark, SF).collect()}
    assert got.keys() == docs.keys()
    assert sum(r[0] > 0 for r in got.values()) > 5
    for k, t in short.items():
        assert got[k] == contract(k, t), k
