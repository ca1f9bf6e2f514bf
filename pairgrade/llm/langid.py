"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of 0 to `order` bytes with the
counts of the bytes that followed them.  A byte is coded in its longest known
context with escape method C: symbol c / (n + q), escape q / (n + q), where n
is the context's count and q its number of distinct symbols; an escape goes to
the context shorter by one byte, and below order 0 each byte costs 8 bits.
The counts are frozen after learning, so a text's exact code length under each
language is a sum of table values; the shortest wins.

Edge cases: null and empty texts and texts without a letter get `und` and
score 0; ties go to the language first by code point; with nothing to learn
from, every text is `und`.  Repeated rows are scored alike, one result each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairgrade.llm import flat
from pairgrade.llm.constants import ship

# Bound on what is learned from: texts of one language.  The tables that go to the executors grow with it
# (and with the number of languages), not with the corpus.
TEXTS_PER_LANGUAGE = 600
ORDER = 3


def grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For each byte the byte and the `order` (at most 7) bytes before it, big-endian; zeros before a text."""
    kind = np.uint32 if order < 4 else np.uint64
    key = data.astype(kind)
    for d in range(1, order + 1):
        key[d:] |= data[:-d].astype(kind) << kind(8 * d)
    first = off[:-1][off[:-1] < off[1:]]
    for i in range(order):  # where a text is shorter than the order, the next text's own mask is the narrower one
        at = first + i
        at = at[at < len(data)]
        key[at] &= kind((1 << (8 * (i + 1))) - 1)
    return key


@dataclass
class Model:
    """Frozen tables: for each order the known grams and contexts, and the bits they cost in each language."""

    languages: list[str]
    order: int
    known: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    def code(self, key: np.ndarray, d: int | None = None) -> np.ndarray:
        """Bits of each gram's last byte, one column for each language."""
        d = self.order if d is None else d
        if d < 0:
            return np.full((len(key), len(self.languages)), 8, np.float32)
        known = self.known[d]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out = self.bits[d][at]
        miss = np.flatnonzero(known[at] != key)
        if len(miss):
            rest = key[miss]
            shorter = rest & rest.dtype.type((1 << (8 * d)) - 1)
            out[miss] = self.code(shorter, d - 1)
            ctx = rest >> rest.dtype.type(8)
            have = self.contexts[d]
            at = np.minimum(np.searchsorted(have, ctx), len(have) - 1)
            out[miss] += np.where((have[at] == ctx)[:, None], self.escape[d][at], 0)
        return out


def build(counts: list[tuple[str, np.ndarray, np.ndarray]], order: int) -> Model:
    """Model from (language, grams of the full order, counts), one entry for each language."""
    counts = sorted(counts, key=lambda x: x[0])
    m = Model([x[0] for x in counts], order, [], [], [], [])
    for d in range(order + 1 if counts else 0):
        own = []
        for _, key, n in counts:
            cut, at = np.unique(key & key.dtype.type((1 << (8 * (d + 1))) - 1), return_inverse=True)
            own.append((cut, np.bincount(at, n)))
        known = np.unique(np.concatenate([x[0] for x in own]))
        ctx = known >> known.dtype.type(8)
        have, of = np.unique(ctx, return_inverse=True)
        shorter = known & known.dtype.type((1 << (8 * d)) - 1)
        below = m.code(shorter, d - 1)
        bits = np.empty((len(known), len(counts)), np.float32)
        escape = np.zeros((len(have), len(counts)), np.float32)
        for j, (cut, n) in enumerate(own):
            c = np.zeros(len(known))
            c[np.searchsorted(known, cut)] = n
            total, kinds = np.bincount(of, c), np.bincount(of, c > 0)
            seen = total > 0
            escape[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
            whole = (total + kinds)[of]
            with np.errstate(divide="ignore", invalid="ignore"):
                bits[:, j] = np.where(c > 0, -np.log2(c / whole), below[:, j] + escape[of, j])
        m.known.append(known)
        m.bits.append(bits)
        m.contexts.append(have)
        m.escape.append(escape)
    return m


def learning_sample(docs: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most `per_label` rows of each non-null label, by the order of a hash of `key`.

    Label counts (a column-pruned pass) give each label a hash threshold that about twice the wanted rows pass;
    only those are ranked, so a label with a third of all rows is no heavy group.
    """
    docs = docs.where(F.col(label).isNotNull())
    share = docs.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(key)), 12)
    near = docs.withColumn("_h", h).join(F.broadcast(share), F.col(label) == F.col("_l"))
    near = near.where(F.col("_h") <= F.least(F.lit(1.0), F.lit(2.0 * per_label + 40) / F.col("_n")) * float(1 << 52))
    rank = F.row_number().over(W.partitionBy(label).orderBy("_h", key))
    return near.withColumn("_r", rank).where(F.col("_r") <= per_label).drop("_h", "_l", "_n", "_r")


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        per_label: int = TEXTS_PER_LANGUAGE, order: int = ORDER) -> Model:
    """Count the contexts of a bounded sample of labelled texts on the executors and freeze them."""
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(key).alias("key"), F.col(text).alias("text"))
    sample = learning_sample(rows, "label", "key", per_label).select("label", "text")

    def count(batches):
        for b in batches:
            label = np.asarray(b.column("label").to_pylist(), object)
            for lo, hi, data, off in flat.chunks(b.column("text")):
                if not len(data):
                    continue
                key = grams(data, off, order)
                own = np.repeat(label[lo:hi], np.diff(off))
                for name in set(label[lo:hi]):
                    cut, n = np.unique(key[own == name], return_counts=True)
                    if len(cut):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(cut), pa.string()), pa.array(cut.astype(np.int64)), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    found = sample.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toArrow()
    labels = np.asarray(found.column("label").to_pylist(), object)
    kind = np.uint32 if order < 4 else np.uint64
    key, n = found.column("gram").to_numpy().astype(np.uint64).astype(kind), found.column("n").to_numpy()
    return build([(name, key[labels == name], n[labels == name]) for name in sorted(set(labels))], order)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of `docs`: the `keep` columns, lang_pred, score (the language's share of the total probability) and bits
    (code length in the predicted language)."""
    rows = docs.select(*keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"), F.col(text).alias("_text"))
    schema = rows.select(*keep).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "bits": F.lit(0.0)}).schema
    shared = ship(docs.sparkSession, model)

    def score(batches):
        m = shared()
        names = np.asarray([*m.languages, "und"], object)
        for b in batches:
            letter = b.column("_letter").to_numpy(zero_copy_only=False)
            best = np.full(b.num_rows, len(names) - 1)
            p, bits = np.zeros(b.num_rows), np.zeros(b.num_rows)
            if m.languages:
                for lo, hi, data, off in flat.chunks(b.column("_text"), 1 << 19):
                    if len(data):
                        cost = flat.per_text(m.code(grams(data, off, m.order)), off)
                        best[lo:hi] = cost.argmin(1)
                        bits[lo:hi] = cost.min(1)
                        p[lo:hi] = 1 / np.exp2(np.minimum(bits[lo:hi, None] - cost, 0)).sum(1)
                best[~letter] = len(names) - 1
                p[~letter] = 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(p), pa.array(bits)], names=[*keep, "lang_pred", "score", "bits"])

    return rows.mapInArrow(score, schema)
