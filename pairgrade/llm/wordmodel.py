"""Words by the word before: modified Kneser-Ney over all texts, counted and scored on one shuffle.

Words are runs of letters, digits and other non-ASCII characters, A-Z as a-z and every digit as 0; a text's first word
follows a mark.  So that no text vouches for itself, texts are halved by their hash and each half is scored by what the
other half counts; equal texts share a half.

* A task packs the pairs of some texts as sorted arrays: each word before once, each word after it once, and the texts
  that hold the pair.  Packed pairs are dealt by the word before, so a bucket has all that follows a word.
* A bucket merges its arrays to one sorted array of pairs with the counts of both halves: the model's tables.  They grow
  with the corpus, a bucket does not: the number of buckets follows the number of words.  Buckets are read twice: first
  their counts of counts are summed over all buckets, then the pairs are scored with the discounts for counts of 1, 2 and
  3 or more that follow from the sums.  What the discounts leave goes to a word by its spelling, whose bits travel with
  the pairs (a byte: quarters of a bit, 63.75 at most).  Words before are told apart by 40 bits of their hash, words
  after one by 24; of words that are not told apart the fewest bits hold.
* The scores are sums of the texts of each packed part, in whole 2 ** -16 bits.
* A word that makes up more of the corpus than a bucket's share has its pairs dealt by the words after it as well, so that
  no task holds all that follows it; its totals come from the first reading.  There are at most `HOT` such words, and
  only they go to the tasks.

So the scores do not depend on the number of buckets, on how texts lie in parts, or on which words are dealt so.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrade.llm import flat
from pairgrade.llm.constants import ship

SEND, BUCKET = 1 << 21, 1 << 21  # words that a task packs at a time; words of a bucket
HOT = 1024
UNIT = 1 << 16  # of a bit
START = np.uint64(0x243F6A8885A308D3)


def _folded() -> np.ndarray:
    """Bytes of words: a-z, 0 for digits, bytes of other characters; 32 elsewhere."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    out[48:58] = 48
    out[128:] = np.arange(128, 256)
    return out


FOLDED = _folded()


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts for counts of 1, 2 and 3 or more, from how many n-grams have counts of 1 to 4."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        cut = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    else:
        cut = [0.5, 0.75, 0.9]
    return [float(np.clip(x, 0.05, i - 0.05)) for i, x in enumerate(cut, 1)]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, and starts, ends and offsets of each text's words."""
    folded = FOLDED[data]
    return folded, *flat.spans(folded != 32, off)


def frequent(rows: DataFrame, text: str = "_text") -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of all texts, and the hashes and numbers of those that are over 1 / `HOT` of them (about:
    parts of the corpus in which a word is rarer than half of that do not add to it)."""

    def count(batches):
        for b in batches:
            for _, _, data, off in flat.chunks(b.column(text)):
                folded, start, end, _ = words(data, off)
                h, n = np.unique(flat.hashes(folded, start, end), return_counts=True)
                often = n * 2 * HOT >= len(start)
                yield pa.RecordBatch.from_arrays([pa.array([None, *h[often].view(np.int64).tolist()], pa.int64()), pa.array([len(start), *n[often].tolist()], pa.int64())], ["word", "n"])

    counts = rows.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = int(counts.where("word is null").agg(F.sum("n")).first()[0] or 0)
    found = counts.where(F.col("word").isNotNull() & (F.col("n") * HOT >= total)).collect()
    found.sort(key=lambda r: r["word"] & (2**64 - 1))
    return total, np.array([r["word"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)


PACKED = "bucket long, part long, before binary, high binary, before_n binary, after binary, low binary, after_n binary, doc binary, present binary, half binary, times binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _squeeze(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _read(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _planes(x: np.ndarray, size: int = 3) -> bytes:
    """Numbers below 256 ** `size` as their lowest bytes, then the next ones, each together."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes(), 1)


def _unplanes(x: bytes, size: int = 3) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(size, -1).astype(np.int64)
    return np.bitwise_or.reduce([p << 8 * i for i, p in enumerate(planes)])


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _spread(hot: np.ndarray, shards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 40-bit numbers of the shards of the frequent words, and each one's word."""
    word = np.repeat(np.arange(len(hot)), shards)
    shard = np.arange(len(word)) - np.repeat(np.cumsum(shards) - shards, shards)
    own = flat.mix(hot[word] + shard.astype(np.uint64) * GOLDEN) >> np.uint64(24)
    order = np.argsort(own)
    return own[order], word[order]


def _pack(held: dict[int, list], buckets: int, hot: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """`PACKED` rows of some texts, a part; held: words, spelling bits and number of copies by the text's hash.

    A row for each bucket with its pairs, the texts that hold them (their numbers within the part), a bit for each text
    that is present and one for its half; and a row below 0 that names the part's texts and their numbers of words."""
    own = np.array(list(held), np.int64)
    part = int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True)
    size = np.array([len(x[0]) for x in held.values()])
    after, low = (np.concatenate([x[i] for x in held.values()]) for i in (0, 1))
    before = np.r_[START, after[:-1]]
    before[np.cumsum(size) - size] = START
    doc = np.repeat(np.arange(len(own), dtype=np.int32), size)
    after = after >> np.uint64(40)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        before = before + after % np.where(hot[at] == before, shards[at], 1).astype(np.uint64) * GOLDEN
    key = flat.mix(before) & ~np.uint64(0xFFFFFF) | after
    del before, after
    order = np.argsort(key, kind="stable")
    key, low, doc = key[order], low[order], doc[order]
    del order
    new_after = np.r_[True, key[1:] != key[:-1]]
    before = key >> np.uint64(24)
    new_before = np.r_[True, before[1:] != before[:-1]]
    bucket = (before * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True])
    times = np.array([x[2] for x in held.values()], np.int32)
    none = b""
    out = [(-1 - part % buckets, part, own.tobytes(), none, none, none, none, size.astype(np.int64).tobytes(), none, none, none, none)]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        nb, na = new_before[lo:hi], new_after[lo:hi]
        seen = np.zeros(len(own), bool)
        seen[doc[lo:hi]] = True
        mark = (np.cumsum(seen) - 1)[doc[lo:hi]]
        pairs = np.flatnonzero(na)
        firsts = np.flatnonzero(nb[pairs])
        first = before[lo:hi][nb]
        word = key[lo:hi][na].view(np.uint8).reshape(-1, 8)[:, :3]
        out.append((int(bucket[lo]), part, first.astype(np.uint32).tobytes(), _squeeze((first >> np.uint64(32)).astype(np.uint8)), _squeeze(np.diff(np.r_[firsts, len(pairs)]).astype(np.int32)),
                    np.ascontiguousarray(word).tobytes(), _squeeze(np.minimum.reduceat(low[lo:hi], pairs)), _squeeze(np.diff(np.r_[pairs, hi - lo]).astype(np.int32)),
                    _planes(mark), _squeeze(np.packbits(seen)), np.packbits(own[seen] & 1 == 1).tobytes(), _squeeze(times[seen])))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names=_NAMES)


def _send(model, spelling, buckets: int, hot: np.ndarray, shards: np.ndarray):
    def run(batches):
        m = model()
        held: dict[int, list] = {}
        total = 0
        for b in batches:
            own = b.column("own").to_numpy(zero_copy_only=False)
            for lo, _, data, off in flat.chunks(b.column("_text")):
                folded, start, end, at = words(data, off)
                h = flat.hashes(folded, start, end)
                _, one, back = np.unique(h, return_index=True, return_inverse=True)
                low = np.minimum(np.rint(4 * spelling(m, folded, start[one], end[one])), 255).astype(np.uint8)[back] if len(h) else np.zeros(0, np.uint8)
                for i in np.flatnonzero(np.diff(at)):
                    k = int(own[lo + i])
                    if k in held:
                        held[k][2] += 1
                    else:
                        held[k] = [h[at[i]:at[i + 1]], low[at[i]:at[i + 1]], 1]
                        total += int(at[i + 1] - at[i])
                if total >= SEND:
                    yield _pack(held, buckets, hot, shards)
                    held, total = {}, 0
        if held:
            yield _pack(held, buckets, hot, shards)

    return run


def _merged(g: pd.DataFrame):
    """A bucket's pairs, sorted, each once: the number of the word before and the spelling's bits of the one after, and
    the counts of both halves.  And for each text that a part has of a pair: the pair, the text, and its half; and where
    the parts' texts begin."""
    key, low, size, doc, half, times, cut = [], [], [], [], [], [], [0]
    for r in g.itertuples():
        before = np.frombuffer(r.before, np.uint32).astype(np.uint64) | _read(r.high, np.uint8).astype(np.uint64) << np.uint64(32)
        after = np.pad(np.frombuffer(r.after, np.uint8).reshape(-1, 3), ((0, 0), (0, 1))).view("<u4").ravel()
        key.append(np.repeat(before << np.uint64(24), _read(r.before_n, np.int32)) | after)
        low.append(_read(r.low, np.uint8))
        size.append(_read(r.after_n, np.int32))
        doc.append(_unplanes(r.doc) + cut[-1])
        times.append(_read(r.times, np.int32))
        half.append(np.unpackbits(np.frombuffer(r.half, np.uint8), count=len(times[-1])))
        cut.append(cut[-1] + len(times[-1]))
    key, low, size, doc, half, times = (np.concatenate(x) for x in (key, low, size, doc, half, times))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    low = np.minimum.reduceat(low[order], at)
    key = key[at] >> np.uint64(24)
    del order, first
    pair = np.repeat(pair, size)
    side, n = half[doc], times[doc]
    counts = [np.bincount(pair[side == m], n[side == m], len(at)) for m in (0, 1)]
    return key, low, counts, pair, doc, side, cut


COUNTED = "word int, half int, n1 long, n2 long, n3 long, n4 long, more long, total long"


def _count(spread: np.ndarray, word: np.ndarray):
    """Pandas function over a bucket: for each half how many pairs have counts of 1, 2, 3, 4 and more, and the sum of
    the counts; of all words (-1) and of each frequent one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if g["bucket"].iloc[0] >= 0:
            before, _, counts, *_ = _merged(g)
            of = np.full(len(before), -1)
            if len(spread):
                at = np.minimum(np.searchsorted(spread, before), len(spread) - 1)
                of = np.where(spread[at] == before, word[at], -1)
            for m, n in enumerate(counts):
                for w, own in [(-1, n), *((w, n[of == w]) for w in np.unique(of[of >= 0]))]:
                    times = np.bincount(np.minimum(own, 5).astype(np.int64), minlength=6)
                    out.append((int(w), m, *times[1:].tolist(), int(own.sum())))
        return pd.DataFrame(out, columns=[x.split()[0] for x in COUNTED.split(", ")]).astype("int64")

    return run


def table(before: np.ndarray, low: np.ndarray, count: np.ndarray, cut: list[float], known: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Bits of each pair by a half's counts and discounts; sorted by the word before.  `known` words before have their
    numbers of pairs with counts of 1, 2 and more and their sum of counts in `totals`."""
    first = np.r_[True, before[1:] != before[:-1]]
    group = np.cumsum(first) - 1
    sums = np.stack([*(np.bincount(group, count == i) for i in (1, 2)), np.bincount(group, count > 2), np.bincount(group, count)])
    if len(known):
        words = before[first]
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        hit = known[at] == words
        sums[:, hit] = totals[:, at[hit]]
    total, free = sums[3][group], (sums[0] * cut[0] + sums[1] * cut[1] + sums[2] * cut[2])[group]
    off = np.array([0.0, *cut])[np.minimum(count, 3).astype(np.int64)]
    below = np.exp2(low / -4.0)
    return -np.log2(np.where(total > 0, (count - off + free * below) / np.maximum(total, 1), below))


REPLY = "dest long, part long, own binary, n binary, present binary, bits binary"


def _score(dests: int, spread: np.ndarray, word: np.ndarray):
    """Pandas function over a bucket and the counts over all buckets: the sum of the bits of each text that a part has in
    it; rows that name a part's texts go on as they are."""

    def run(g: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in REPLY.split(", ")]
        if not len(g):
            return pd.DataFrame([], columns=names)
        if g["bucket"].iloc[0] < 0:
            return pd.DataFrame([(r.part % dests, r.part, r.before, r.after_n, b"", b"") for r in g.itertuples()], columns=names)
        before, low, counts, pair, doc, side, cut = _merged(g)
        bits = []
        for m, count in enumerate(counts):
            own = counted[counted["half"] == m].set_index("word")
            of = own.reindex(word)
            totals = np.stack([of["n1"], of["n2"], of["n3"] + of["n4"] + of["more"], of["total"]]).astype(float)
            every = own.loc[-1]
            bits.append(np.rint(UNIT * table(before, low, count, discounts(*(int(every[f"n{i}"]) for i in (1, 2, 3, 4))), spread, totals)).astype(np.int64))
        cost = np.where(side == 0, bits[1][pair], bits[0][pair])
        total = np.bincount(doc, cost, cut[-1]).astype(np.int64)
        return pd.DataFrame([(r.part % dests, r.part, b"", b"", r.present, _planes(total[lo:hi], 8)) for r, lo, hi in zip(g.itertuples(), cut[:-1], cut[1:], strict=True)], columns=names)

    return run


def _mean(g: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, p in g.groupby("part", sort=False):
        named = p[p["own"].str.len() > 0]
        own, n = np.frombuffer(named["own"].iloc[0], np.int64), np.frombuffer(named["n"].iloc[0], np.int64)
        total = np.zeros(len(own), np.int64)
        for r in p[p["own"].str.len() == 0].itertuples():
            total[np.unpackbits(_read(r.present, np.uint8), count=len(own)).astype(bool)] += _unplanes(r.bits, 8)
        out.append(pd.DataFrame({"own": own, "mean_bits": total / (n * len(named) * UNIT)}))  # the same texts may make two parts
    return pd.concat(out)


def word_bits(docs: DataFrame, model, spelling, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """own (hash of a text) and mean_bits, the mean cost of its words by the other half's counts, for every text that
    has words.  `spelling(model, bytes, starts, ends)` gives the bits of words by themselves."""
    rows = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"), F.col(text).alias("_text"))
    total, hot, n = frequent(rows)
    buckets = -(-total // bucket) or 1
    shards = np.maximum(1, -(-n // bucket))
    hot, shards = hot[shards > 1], shards[shards > 1]
    spread, word = _spread(hot, shards)
    packed = rows.mapInArrow(_send(ship(docs.sparkSession, model), spelling, buckets, hot, shards), PACKED).groupBy("bucket")
    counted = packed.applyInPandas(_count(spread, word), COUNTED).groupBy("word", "half").agg(*(F.sum(x).alias(x) for x in ("n1", "n2", "n3", "n4", "more", "total")))
    every = counted.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long")))).groupBy("bucket")
    replies = packed.cogroup(every).applyInPandas(_score(buckets, spread, word), REPLY)  # the packed pairs are shuffled once
    means = replies.groupBy("dest").applyInPandas(_mean, "own long, mean_bits double")
    return means.groupBy("own").agg(F.min("mean_bits").alias("mean_bits"))  # copies of a text in several parts
