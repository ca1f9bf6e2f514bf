"""Byte-level BPE encoding and decoding.

A word (a match of the split pattern, found by Spark) starts as the ids of its
bytes.  Merges fold over it: the neighbouring pair of lowest rank, the leftmost
first, becomes one id, until no pair has a rank.  The ranks of pairs are a hash
table of fixed size with two slots for each pair (cuckoo hashing).

`Tokenizer.encode` folds the distinct words of each Arrow batch together, one
merge of every word at a time, on flat arrays.  `Tokenizer.fold` is the same
fold as one Spark expression of higher-order functions over a word; it gives
equal results, but at about twenty microseconds of interpretation for each
word of a text it is three times over the check tool's CPU budget (see
README), so texts are not encoded with it.

Decoding writes each id's bytes in hexadecimal, joins the pieces and turns them
to binary, in Spark expressions.

Edge cases: null and empty texts have no tokens and decode to an empty binary;
special tokens are ordinary text; any text round-trips to its UTF-8 bytes;
texts and words of any length are encoded whole (words of more than `LONG`
bytes with a heap, in n log n steps); repeated rows get one result each.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairgrade.llm import flat
from pairgrade.llm.constants import constant, let, ship

LONG = 48
WORDS = 1 << 19  # words of a batch that are encoded at a time
ID_BITS = 17
NONE = 1 << 40
_M1, _M2 = 0x9E3779B, 0x85EBCA7  # odd multipliers of the two slot functions; a pair's key times one of them fits 63 bits


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The split pattern for Java's regular expressions, with Unicode white space."""
    return f"(?U){pattern}"


def _cuckoo(slots: list[tuple[int, int]], n: int) -> list[int]:
    """For each of n places the index of the item that lies there, or -1; slots: an item's two places."""
    table = [-1] * n
    for i in range(len(slots)):
        item, at = i, slots[i][0]
        for _ in range(500):
            item, table[at] = table[at], item
            if item < 0:
                break
            a, b = slots[item]
            at = b if at == a else a
        else:
            raise ValueError("table too full")
    return table


def _places(key: int, bits: int) -> tuple[int, int]:
    """Two slots of a pair's key; the same in `_pair_slot`."""
    mask = (1 << bits) - 1
    return ((key * _M1) >> 19) & mask, ((key * _M2) >> 22) & mask


class Coder:
    """The fold on flat arrays: pair table and byte ids, as held by tasks."""

    def __init__(self, pairs: np.ndarray, first: np.ndarray, bits: int):
        self.pairs, self.first, self.mask = pairs, first, (1 << bits) - 1

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each merged pair, NONE where there is none."""
        key = a << ID_BITS | b
        one = self.pairs[(key * _M1) >> 19 & self.mask]
        two = self.pairs[(key * _M2) >> 22 & self.mask]
        low = (1 << ID_BITS) - 1
        return np.where(one >> ID_BITS == key, one & low, np.where(two >> ID_BITS == key, two & low, NONE))

    def fold(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and the number of them; words are not empty."""
        n = np.diff(off)
        ids, word = self.first[data], np.repeat(np.arange(len(n)), n)
        done_ids, done_word = [], []
        long = n > LONG
        if long.any():
            for w in np.flatnonzero(long):
                got = self.long(ids[off[w]:off[w + 1]].tolist())
                done_ids.append(np.array(got, np.int64))
                done_word.append(np.full(len(got), w))
            keep = ~long[word]
            ids, word = ids[keep], word[keep]
        while len(ids):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            rank = np.full(len(ids), NONE)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.merged(ids[same], ids[same + 1])
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(ids)])
            best_of = np.repeat(best, size)
            over = best_of == NONE
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == best_of) & ~over)
            hit = hit[np.r_[True, word[hit][1:] != word[hit][:-1]]] if len(hit) else hit
            ids[hit] = rank[hit]
            over[hit + 1] = True
            ids, word = ids[~over], word[~over]
        ids, word = np.concatenate([*done_ids, ids]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(n))

    def long(self, ids: list[int]) -> list[int]:
        """The same for one word, with a heap of pairs by rank and place."""
        rank = lambda a, b: int(self.merged(np.array([a]), np.array([b]))[0])
        known: dict[tuple[int, int], int] = {}
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(ids):
                pair = ids[i], ids[j]
                r = known[pair] = known[pair] if pair in known else rank(*pair)
                if r < NONE:
                    heapq.heappush(heap, (r, i, *pair))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < len(ids) and ids[i] == a and ids[j] == b:
                ids[i], ids[j], after[i] = r, -1, after[j]
                if after[j] < len(ids):
                    before[after[j]] = i
                push(i)
                if before[i] >= 0:
                    push(before[i])
        return [x for x in ids if x >= 0]

    def encode(self, words: pa.Array, off: np.ndarray) -> pa.Array:
        """Ids of each text: its words are words[off[i]:off[i + 1]]."""
        coded = pc.dictionary_encode(words)
        index = coded.indices.to_numpy()
        if not len(index):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(off)), pa.int32()), pa.array([], pa.int32()))
        ids, n = self.fold(*flat.utf8(coded.dictionary))
        size = n[index]
        place = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(place[-1]) + np.repeat((np.cumsum(n) - n)[index] - place[:-1], size)
        return pa.ListArray.from_arrays(pa.array(place[off], pa.int32()), pa.array(ids[at].astype(np.int32)))


class Tokenizer:
    """Column expressions for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = java_pattern(pattern)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << ID_BITS | b] = rank
        if max(ranks.values()) >= 1 << ID_BITS:
            raise ValueError(f"ids must be below 2**{ID_BITS}")
        self.bits = max(4, (len(pairs) * 5 // 2).bit_length())
        keys = list(pairs)
        table = _cuckoo([_places(k, self.bits) for k in keys], 1 << self.bits)
        # key and id of a pair in one number
        self.pairs = pa.array([-1 if i < 0 else keys[i] << ID_BITS | pairs[keys[i]] for i in table], pa.int64())
        self.first = pa.array([ranks[bytes([b])] for b in range(256)], pa.int64())
        token = {r: t for t, r in ranks.items()}
        self.hex = pa.array([token.get(i, b"").hex() for i in range(max(token) + 1)])

    def tables(self, spark: SparkSession) -> Column:
        return constant(spark, pairs=self.pairs, first=self.first)

    def _pair(self, t: Column, a: Column, b: Column) -> Column:
        """Id of the merged pair, or a number above all ids."""
        key = F.shiftleft(a.cast("long"), ID_BITS).bitwiseOR(b.cast("long"))
        mask = (1 << self.bits) - 1
        one = F.get(t["pairs"], F.shiftright(key * F.lit(_M1), 19).bitwiseAND(mask).cast("int"))
        two = F.get(t["pairs"], F.shiftright(key * F.lit(_M2), 22).bitwiseAND(mask).cast("int"))
        low = F.lit((1 << ID_BITS) - 1)
        return let(one, lambda x: F.when(F.shiftright(x, ID_BITS) == key, x.bitwiseAND(low)).otherwise(
            let(two, lambda y: F.when(F.shiftright(y, ID_BITS) == key, y.bitwiseAND(low)).otherwise(F.lit(NONE)))))

    def _ranks(self, t: Column, ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: self._pair(t, F.get(ids, i), F.get(ids, i + 1)))

    def _bytes(self, t: Column, word: Column) -> Column:
        code = F.encode(word, "UTF-8")
        return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.get(t["first"], F.conv(F.hex(F.substring(code, i, F.lit(1))), 16, 10).cast("int")))

    def fold(self, t: Column, word: Column) -> Column:
        """Ids of one word that is not empty, as a Spark expression; t: the tables, bound by `let`.

        Words of more than `LONG` bytes are kept as a text of ids, in which one step replaces every occurrence of the
        pair."""

        def short(ids: Column) -> Column:
            def merge(acc: Column, ranks: Column) -> Column:
                low = F.array_min(ranks)
                at = F.array_position(ranks, low).cast("int")
                merged = F.concat(F.slice(acc, F.lit(1), at - 1), F.array(low), F.slice(acc, at + 2, F.size(acc)))
                return F.when(low < F.lit(NONE), merged).otherwise(acc)

            return F.aggregate(F.sequence(F.lit(2), F.size(ids)), ids, lambda acc, _: F.when(F.size(acc) > 1, let(self._ranks(t, acc), lambda r: merge(acc, r))).otherwise(acc))

        def long(ids: Column) -> Column:
            """Over a text of ids, each between spaces of its own."""
            text = F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), "  "), F.lit(" "))
            start = F.struct(text.alias("s"), F.lit(False).alias("done"))

            def step(s: Column) -> Column:
                now = F.split(F.trim(s), "  ").cast("array<bigint>")

                def replace(ids: Column, ranks: Column) -> Column:
                    low = F.array_min(ranks)
                    at = F.array_position(ranks, low).cast("int")
                    pair = F.concat(F.lit(" "), F.get(ids, at - 1).cast("string"), F.lit("  "), F.get(ids, at).cast("string"), F.lit(" "))
                    out = F.replace(s, pair, F.concat(F.lit(" "), low.cast("string"), F.lit(" ")))
                    return F.when(F.coalesce(low < F.lit(NONE), F.lit(False)), F.struct(out.alias("s"), F.lit(False).alias("done"))).otherwise(F.struct(s.alias("s"), F.lit(True).alias("done")))

                return let(now, lambda ids: F.when(F.size(ids) > 1, let(self._ranks(t, ids), lambda r: replace(ids, r))).otherwise(F.struct(s.alias("s"), F.lit(True).alias("done"))))

            end = F.aggregate(F.sequence(F.lit(2), F.size(ids)), start, lambda acc, _: F.when(acc["done"], acc).otherwise(step(acc["s"])))
            return F.split(F.trim(end["s"]), "  ").cast("array<bigint>")

        return let(self._bytes(t, word), lambda ids: F.when(F.size(ids) < 2, ids).when(F.size(ids) <= LONG, short(ids)).otherwise(long(ids)))

    def words(self, text: Column) -> Column:
        return F.coalesce(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), F.array().cast("array<string>"))

    def encode(self, docs: DataFrame, text: str, ids: str, keep: Sequence[str] | None = None) -> DataFrame:
        """`docs` with the tokens of `text` in the array column `ids`; keep: the columns that go with them, else all.
        What is kept travels to the tasks' Python and back, beside the words."""
        keep = [c for c in (docs.columns if keep is None else keep) if c != ids]
        shared = ship(docs.sparkSession, Coder(self.pairs.to_numpy(), self.first.to_numpy(), self.bits))
        rows = docs.select(F.struct(*keep).alias("row"), self.words(F.col(text)).alias("words"))
        schema = rows.select("row").withColumn("ids", F.array().cast("array<int>")).schema

        def run(batches):
            coder = shared()
            for b in batches:
                words = b.column("words")
                off = words.offsets.to_numpy()
                lo = 0
                while lo < b.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(off, off[lo] + WORDS, side="right")) - 1)
                    part = b.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column("row"), coder.encode(words.values.slice(off[lo], off[hi] - off[lo]), off[lo:hi + 1] - off[lo])], names=["row", "ids"])
                    lo = hi
                pa.default_memory_pool().release_unused()

        return rows.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in keep), F.col("ids").alias(ids))

    def decode(self, rows: DataFrame, ids: str, out: str) -> DataFrame:
        """`rows` with the binary column `out`, the bytes of `ids`."""
        pieces = let(F.col("_tables"), lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t["hex"], i.cast("int"))), "")))
        return rows.withColumn("_tables", constant(rows.sparkSession, hex=self.hex)).withColumn(out, pieces).drop("_tables")
