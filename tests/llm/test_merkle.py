"""The Merkle manifest against a plain tree."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairgrade.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """Root of a list of digests, and the siblings (before, after) of each node level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for p, path in enumerate(paths):
            run, at = runs[place[p] // 16], place[p] % 16
            path.append(("".join(run[:at]), "".join(run[at + 1:])))
            place[p] //= 16
        nodes = [H("".join(r)) for r in runs]
    return (nodes[0] if nodes else None), paths


def brute(rows):
    """{(group, key, leaf): (subroot, root, path)} of (key, group, leaf) rows that are all different."""
    groups = {}
    for k, g, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(g, []).append((k, x))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: climb([x for _, x in groups[g]]) for g in names}
    root, above = climb([below[g][0] for g in names])
    return {(g, k, x): (below[g][0], root, below[g][1][i] + above[j]) for j, g in enumerate(names) for i, (k, x) in enumerate(groups[g])}


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16, 17, 1], [5000, 300, 20, 4096, 4097], [1] * 40])
def test_trees(spark, sizes):
    rows = [(i * 7 % 10007, None if g == 1 else f"g{g}é" if g % 3 else f"G{g}", H(f"{g},{i}")) for g, n in enumerate(sizes) for i in range(n)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumns({"pos": F.lit("clash"), "n": F.lit(1), "g": F.lit("x")})
    found = merkle.manifest(df.repartition(7), "doc_id", "source")
    found = found.withColumn("back", merkle.folded(F.col("path"), F.col("leaf"))).withColumn("proof", merkle.siblings(F.col("path")).cast("string"))
    got = {(r["source"], r["doc_id"], r["leaf"]): r for r in found.collect()}
    assert got.keys() == want.keys()
    for k, (subroot, root, path) in want.items():
        r = got[k]
        assert (r["subroot"], r["root"], r["back"]) == (subroot, root, root)
        assert r["proof"] == "".join(a + b for a, b in path)


def test_odd_rows(spark):
    rows = [(None, None, "A"), (None, None, "A"), (1, "", ""), (1, "", "b"), (2, "s", None), (3, "s", "x" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    leaves = df.withColumn("leaf", merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("text")))
    text = {r["text"]: r["leaf"] for r in leaves.collect()}
    assert text["A"] == H("--1:A") and text[""] == H("1:10:0:") and text[None] == H("1:21:s-") and text["x" * 2_000_000] == H("1:31:s2000000:" + "x" * 2_000_000)
    got = merkle.manifest(leaves, "doc_id", "source")
    assert got.count() == 6 and got.select("root").distinct().count() == 1 and got.select("subroot").distinct().count() == 3
    bad = got.withColumn("back", merkle.folded(F.col("path"), F.lit(H("other"))))
    assert bad.where("back = root").count() == 0
    assert merkle.manifest(leaves.limit(0), "doc_id", "source").count() == 0
