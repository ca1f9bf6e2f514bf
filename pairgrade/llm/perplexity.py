"""Quality rules with n-gram perplexity.

A modified Kneser-Ney model of each word after the one before it is counted by
Spark over all texts (`wordmodel`): its sorted hash arrays have an entry for
each distinct pair of the corpus, grow with it, and lie in buckets of fixed
size; nothing of them comes to the driver.  So that no text vouches for
itself, texts are halved by their hash and each half is scored by what the
other half counts; equal texts share a half.

Below the words lies a spelling model, which gives words that a half has never
seen a probability: Kneser-Ney over 4 symbols, bytes folded to 64 (`SYMBOL`)
and spread evenly over the bytes of a symbol.  It knows at most 2**24 n-grams,
which bounds what the driver and the tasks hold of it.  It is stored as sorted
key arrays with the interpolated cost in bits of each known n-gram and the
back-off cost of each known context.

A text's perplexity is taken per word that has a letter or digit
(2 ** (bits / such words)): symbols glued to words or standing between them
raise it, words taken from a small stock lower it.  It is taken twice, by the
words and by the spelling alone.  Each language has its own bands; a text above
one of its language's bands, or below that of the spelling, is rejected.  Below
the words' band lie texts that others repeat, which is no fault of theirs:
copies are another operator's job.  A band reaches
from the lower to the upper quartile of the texts that pass the base rules,
widened on both sides by `WIDTH` times a spread, which is the larger of the
quartile distance and `LEAST` bits, and which grows for short texts, whose
mean varies more: by the root of `REFERENCE_WORDS` / words.

Edge cases: null and empty texts have no words and fail the base rules; a null
language is a language of its own; a language with few texts gets the band of
those texts, never narrower than `WIDTH` * `LEAST` on each side; repeated rows
count as often as they occur and get one result each.
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
from pairgrade.llm.wordmodel import discounts, word_bits
from pairgrade.session import materialize

ORDER = 4
WIDTH, LEAST, REFERENCE_WORDS = 3.0, 0.6, 200
BIN = 64  # quartiles are read off a histogram with so many bins per bit

# Fixed: symbols that the rules count.
COUNTED = np.zeros(256, bool)
COUNTED[list(b"#*$%&|<>")] = True
ALNUM = np.zeros(256, bool)
ALNUM[128:], ALNUM[48:58], ALNUM[65:91], ALNUM[97:123] = True, True, True, True
WINDOW = 8


def _symbols() -> np.ndarray:
    """64 symbols: white space 0, a-z 1-26, A-Z 27-34, digits 35, punctuation 36-51, UTF-8 lead bytes 52-54,
    continuation bytes 55-62, the rest 63."""
    out = np.full(256, 63, np.uint8)
    out[flat.SPACE] = 0
    out[97:123] = np.arange(1, 27)
    out[65:91] = 27 + np.arange(26) % 8
    out[48:58] = 35
    for code, group in enumerate([".", ",", "'\"`", "-_", "!?", ":;", "()[]{}", "/\\@=+~^", "#", "*", "$", "%", "&", "|", "<", ">"], 36):
        out[list(group.encode())] = code
    out[0xC2:0xE0], out[0xE0:0xF0], out[0xF0:0xF5] = 52, 53, 54
    out[0x80:0xC0] = 55 + np.arange(64) % 8
    return out


SYMBOL = _symbols()
WITHIN = np.log2(np.bincount(SYMBOL, minlength=64))[SYMBOL]  # bits that tell a byte from the others of its symbol


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the 24-bit key of its symbol and the three before it (white space before a text)."""
    s = SYMBOL[data].astype(np.int32)
    key = s.copy()
    for d in range(1, ORDER):
        key[d:] |= s[:-d] << (6 * d)
    first = off[:-1][off[:-1] < off[1:]]
    for i in range(ORDER - 1):
        at = first + i
        at = at[at < len(data)]
        key[at] &= (1 << (6 * (i + 1))) - 1
    return key


@dataclass
class Model:
    known: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    def cost(self, key: np.ndarray, d: int = ORDER - 1) -> np.ndarray:
        """Bits of the last symbol of each key, given the d symbols before it."""
        if d < 0 or not len(self.known[d]):
            return np.full(len(key), 6.0, np.float32)
        known = self.known[d]
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        out = self.bits[d][at]
        miss = np.flatnonzero(known[at] != key)
        if len(miss):
            rest, have = key[miss], self.contexts[d]
            out[miss] = self.cost(rest & ((1 << (6 * d)) - 1), d - 1)
            at = np.minimum(np.searchsorted(have, rest >> 6), len(have) - 1)
            out[miss] += np.where(have[at] == rest >> 6, self.backoff[d][at], 0)
        return out


def build(key: np.ndarray, n: np.ndarray) -> Model:
    """Model from the distinct n-grams of full order and their counts.  Lower orders count the distinct n-grams one
    longer that end in them; discounts for counts of 1, 2 and 3 or more come from each order's counts of counts."""
    order = np.argsort(key)
    tables = [(key[order].astype(np.int32), n[order].astype(np.float64))]
    for d in range(ORDER - 2, -1, -1):
        cut, times = np.unique(tables[0][0] & ((1 << (6 * (d + 1))) - 1), return_counts=True)
        tables.insert(0, (cut.astype(np.int32), times.astype(np.float64)))
    m = Model([], [], [], [])
    for d, (known, c) in enumerate(tables):
        cut = discounts(*((c == i).sum() for i in (1, 2, 3, 4)))
        off = np.select([c == 1, c == 2], cut[:2], cut[2])
        have, of = np.unique(known >> 6, return_inverse=True)
        total = np.bincount(of, c)
        free = np.bincount(of, off) / np.maximum(total, 1)
        below = np.exp2(-m.cost(known & ((1 << (6 * d)) - 1), d - 1).astype(np.float64)) if d else np.full(len(known), 1 / 64)
        m.known.append(known)
        m.bits.append(-np.log2((c - off) / total[of] + free[of] * below).astype(np.float32))
        m.contexts.append(have.astype(np.int32))
        m.backoff.append(-np.log2(np.maximum(free, 1e-9)).astype(np.float32))
    return m


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count the n-grams of every text."""

    def count(batches):
        for b in batches:
            for _, _, data, off in flat.chunks(b.column("_text"), 8 << 20):
                key, n = np.unique(grams(data, off), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["gram", "n"])

    found = docs.select(F.col(text).alias("_text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return build(found.column("gram").to_numpy(), found.column("n").to_numpy())


def spelling(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits of each byte range as a word of its own, with the white space that ends it."""
    size = end - start + 1
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1] - start, size)
    own = np.where(np.arange(off[-1]) == np.repeat(off[1:] - 1, size), 32, data[np.minimum(at, len(data) - 1)]).astype(np.uint8)
    return flat.per_text(model.cost(grams(own, off)).astype(np.float64) + WITHIN[own], off)


STATS = "n_words long, n_plain_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of `STATS` for each text."""
    texts = len(off) - 1
    start, end, at = flat.words(data, off)
    n_words = np.diff(at)
    inside = ~flat.SPACE[data]
    chars = flat.per_text((inside & flat.code_points(data)).astype(np.int64), off)
    symbols = flat.per_text(COUNTED[data].astype(np.int64), off)
    alnum = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ALNUM[data], out=alnum[1:])
    plain = flat.per_text((alnum[end] > alnum[start]).astype(np.int64), at)
    h = flat.hashes(data, start, end)
    own = np.repeat(np.arange(texts), n_words)
    repeat = np.zeros(texts, np.int64)
    if len(h) >= WINDOW:
        key = np.zeros(len(h) - WINDOW + 1, np.uint64)
        for j in range(WINDOW):
            key = key * np.uint64(0xD1342543DE82EF95) + h[j:len(h) - WINDOW + 1 + j]
        key = flat.mix(key + own[:len(key)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = np.flatnonzero(own[:len(key)] == own[WINDOW - 1:])
        key = key[first]
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            hit = first[np.isin(key, twice)]
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            repeat = flat.per_text((np.cumsum(cover)[:-1] > 0).astype(np.int64), at)
    ls, le, la = flat.spans(data != 10, off)
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    of = np.repeat(np.arange(texts), np.diff(la))[full]
    key = flat.mix(flat.hashes(data, ls[full], le[full]) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    dup = np.bincount(of[order][1:][same], minlength=texts)
    return [n_words, plain, chars, symbols, dup, repeat]


def measure(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The `keep` columns, own (hash of the text), the columns of `STATS`, bits (code length of the text by its spelling) and base_failed."""
    rows = docs.select(*keep, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"), F.col(text).alias("_text"))
    names = [x.split()[0] for x in STATS.split(", ")]
    schema = rows.select(*keep, "own").withColumns({n: F.lit(0).cast("long") for n in names} | {"bits": F.lit(0.0)}).schema
    shared = ship(docs.sparkSession, model)

    def score(batches):
        m = shared()
        for b in batches:
            out, bits = [[] for _ in names], []
            for _, _, data, off in flat.chunks(b.column("_text"), 1 << 19):
                for x, got in zip(out, text_stats(data, off), strict=True):
                    x.append(got)
                bits.append(flat.per_text(m.cost(grams(data, off)), off))
            if bits:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "own")), *(pa.array(np.concatenate(x).astype(np.int64)) for x in out), pa.array(np.concatenate(bits))], names=[*keep, "own", *names, "bits"])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.mapInArrow(score, schema).withColumn("base_failed", failed)


def bands(measured: DataFrame, language: str = "lang", bits: str = "bits") -> DataFrame:
    """One row for each language: quartiles of bits per word over the texts that pass the base rules."""
    bins = (measured.where(~F.col("base_failed") & (F.col("n_plain_words") > 0)).groupBy(F.col(language).alias("_lang"), F.floor(F.col(bits) / F.col("n_plain_words") * BIN).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))
    w = W.partitionBy("_lang").orderBy("bin")
    run = bins.withColumn("run", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("_lang")))
    at = lambda q: F.min(F.when(F.col("run") >= q * F.col("total"), (F.col("bin") + 0.5) / BIN))
    return run.groupBy("_lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))


def verdict(docs: DataFrame, text: str = "text", key: str = "doc_id", language: str = "lang") -> DataFrame:
    """Per row of `docs`: the key, the columns of `STATS`, base_failed, log2_ppl (bits per word by the words), and kept."""
    model = fit(docs, text)
    rows = docs.select(F.col(key).alias("_key"), F.col(language).alias("_language"), F.col(text).alias("_body"))
    bits = materialize(word_bits(rows, model, spelling, "_body"))
    stats = materialize(measure(rows, model, "_body", ("_key", "_language")))
    measured = materialize(stats.join(bits, "own", "left").withColumn("word_bits", F.col("mean_bits") * F.col("n_plain_words")))
    root = F.sqrt(F.greatest(F.lit(1.0), REFERENCE_WORDS / F.greatest(F.col("n_plain_words"), F.lit(1))))
    inside = ~F.col("base_failed")
    for name, column in (("spelt", "bits"), ("word", "word_bits")):
        band = bands(measured, "_language", column).select(F.col("_lang").alias(f"{name}_lang"), F.col("q1").alias(f"{name}_q1"), F.col("q3").alias(f"{name}_q3"))
        measured = measured.join(band, F.col("_language").eqNullSafe(F.col(f"{name}_lang")), "left")
        spread = WIDTH * F.greatest(F.col(f"{name}_q3") - F.col(f"{name}_q1"), F.lit(LEAST)) * root
        ppl = F.try_divide(column, "n_plain_words")
        inside &= F.coalesce((ppl <= F.col(f"{name}_q3") + spread) & (F.lit(name == "word") | (ppl >= F.col(f"{name}_q1") - spread)), F.lit(False))
    return (measured.withColumn("log2_ppl", F.try_divide("word_bits", "n_plain_words"))
            .withColumn("kept", inside)
            .select(F.col("_key").alias(key), *(x.split()[0] for x in STATS.split(", ")), "base_failed", "log2_ppl", "kept"))
