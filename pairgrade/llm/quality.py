"""Quality classifier on supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams (windows of 3 and 4
bytes) are hashed to buckets; each bucket has a learned vector; a text is the
mean vector of all its features, and a softmax layer turns it into class
probabilities.  Vectors and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled texts.  A pair of equal words
has one bucket of its own, whatever the word.

After training the layer is folded into the vectors: the log-odds of a mean of
vectors is the mean of one number for each bucket, so tasks carry
`BUCKETS` numbers and no matrix.

Edge cases: an empty or null text has no features and scores the prior (the
bias); with no label to learn from every score is 0; a sample with one class
gives that class's probability.  Repeated rows get one result each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrade.llm import flat
from pairgrade.llm.constants import ship

BUCKETS = 1 << 16
# Bound on the labelled texts that are learned from (each gives at most BUCKETS counts to the driver).
LABELLED_TEXTS = 2000
DIM, EPOCHS, RATE, SEED = 12, 6, 4.0, 17

_SHIFT = np.uint64(64 - 16)
_SAME = np.uint64(0x632BE59BD9B4E019)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets of each text's buckets) for words, word pairs and character n-grams."""
    start, end, at = flat.words(data, off)
    h = flat.hashes(data, start, end)
    out = [(_bucket(h), at)]
    if len(h):
        pair = flat.mix(h[:-1] * np.uint64(3) + h[1:])
        pair[h[:-1] == h[1:]] = _SAME
        ok = np.ones(len(h), bool)
        ok[at[1:][at[:-1] < at[1:]] - 1] = False
        first = np.flatnonzero(ok)
        out.append((_bucket(pair[first]), np.searchsorted(first, at)))
    key = data.astype(np.uint32)
    for n in (3, 4):
        if len(data) < n:
            break
        gram = key[:len(data) - n + 1].copy()
        for j in range(1, n):
            gram |= key[j:len(data) - n + 1 + j] << np.uint32(8 * j)
        bucket = _bucket((gram.astype(np.uint64) + np.uint64(n << 32)) * np.uint64(0x9E3779B97F4A7C15))
        ok = np.ones(len(gram), bool)
        for j in range(1, n):  # windows that would reach into the next text
            last = off[1:] - j
            ok[last[(last >= 0) & (last < len(gram)) & (off[1:] > off[:-1])]] = False
        short = np.flatnonzero(np.diff(off) < n)
        for i in short:
            ok[off[i]:min(off[i + 1], len(ok))] = False
        if ok.all():
            out.append((bucket, np.minimum(off, len(gram))))
        else:
            first = np.flatnonzero(ok)
            out.append((bucket[first], np.searchsorted(first, off)))
    return out


@dataclass
class Model:
    weight: np.ndarray  # one number for each bucket
    bias: float
    labels: int  # texts learned from

    def logit(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for bucket, at in features(data, off):
            total += flat.per_text(self.weight[bucket], at)
            n += np.diff(at)
        return total / np.maximum(n, 1) + self.bias


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = DIM, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (buckets, counts, class 0 or 1), one text at a time; the rate falls to 0."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), -np.inf, 0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(rows), 0
    shares = [(b, (n / n.sum()).astype(np.float32), y) for b, n, y in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(shares)):
            bucket, share, y = shares[i]
            now = rate * (1 - done / steps)
            mean = share @ vectors[bucket]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = layer.T @ g
            layer -= now * np.outer(g, mean)
            bias -= np.float32(now * 0.1) * g
            vectors[bucket] -= (now * share)[:, None] * back * np.float32(len(bucket) ** 0.5)
            done += 1
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]), len(rows))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        most: int = LABELLED_TEXTS) -> Model:
    """Learn from at most `most` labelled rows, the first by a hash of `key`; their features are counted on the
    executors from whole texts.  The sample's ids are `most` rows at most, so they are broadcast."""
    chosen = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
              .distinct().orderBy(F.xxhash64(F.lit(11), "_k"), "_k", "_y").limit(most))
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen), F.col(key) == F.col("_k")).select("_k", "_y", F.col(text).alias("_text"))

    def count(batches):
        for b in batches:
            y, k = b.column("_y"), b.column("_k")
            for lo, hi, data, off in flat.chunks(b.column("_text")):
                found = features(data, off)
                ids, ns = [], []
                for i in range(hi - lo):
                    own, n = np.unique(np.concatenate([x[a[i]:a[i + 1]] for x, a in found]), return_counts=True)
                    ids.append(own.astype(np.int32))
                    ns.append(n.astype(np.int32))
                yield pa.RecordBatch.from_arrays([k.slice(lo, hi - lo).cast(pa.string()), y.slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], ["k", "y", "ids", "ns"])

    found = rows.mapInArrow(count, "k string, y int, ids array<int>, ns array<int>").toArrow().combine_chunks()
    got = [(i.values.to_numpy(), n.values.to_numpy(), y.as_py(), k.as_py()) for k, y, i, n in zip(found["k"], found["y"], found["ids"], found["ns"], strict=True) if len(i)]
    got.sort(key=lambda x: (x[3], x[2], len(x[0])))  # rows come in no order
    return train([x[:3] for x in got])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The `keep` columns, score (probability of label 1) and predicted (1 if score >= `threshold`)."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema
    shared = ship(docs.sparkSession, model)

    def score(batches):
        m = shared()
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, data, off in flat.chunks(b.column("_text")):
                with np.errstate(over="ignore"):
                    out[lo:hi] = 1 / (1 + np.exp(-m.logit(data, off)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out)], names=[*keep, "score"])

    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
