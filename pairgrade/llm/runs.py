"""Periodic runs of words in texts.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(`LEAST`, `EXPONENT` * q) that no neighbouring word extends with that period.

* Words of a batch become numbers, by an exact dictionary.  Only stretches that can hold a run get trees: in a run
  every three consecutive words occur at least min(EXPONENT - 1, LEAST - 2) times, so words that no such triple covers
  part the text, and the parts are sifted again until nothing changes much.  Triples are counted by hash; a collision
  keeps more words and loses none.
* Each stretch and its reversal get a suffix tree (Ukkonen, in linear time).  The Euler tour of a tree, from leaf to
  leaf, keeps the depth of the node at each turn; the lowest common ancestor of two leaves is the smallest turn between
  them, found in constant time from a table of minima over powers of two.  Its depth is the longest common extension.
* Candidates are Lyndon roots: the longest Lyndon word from each place, for the order of the words and for the
  opposite order, reaches to the next smaller suffix.  Every run holds such a root with its period.  Each root is
  extended to both sides by one query of either tree, all of a stretch at once.

Texts are independent of each other: one pass without a shuffle.  Memory follows the longest stretch (about 500 bytes
for each of its words).

Edge cases: null and empty texts have no run and an empty collapsed text; any white space between words becomes one
space; rows of equal texts or keys get one result each; texts of any length are used whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgrade.llm import flat

EXPONENT, LEAST = 4, 6
SIFTS = 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixTree:
    """Suffix tree of a list of positive numbers; the end mark 0 is added.

    An edge is its node's `first` to `last` of the text; `head` is the place of the occurrence that the edge's label
    was taken from, so that a node's depth is last - head."""

    def __init__(self, symbols: list[int]):
        s = self.s = [*symbols, 0]
        n, wide = len(s), max(s) + 1
        go: dict[int, int] = {}
        first, last, head, link = [0], [0], [0], [0]
        node = edge = length = rest = leaves = 0
        for i, c in enumerate(s):
            rest += 1
            fresh = 0
            while rest:
                if not length:
                    edge = i
                key = node * wide + s[edge]
                below = go.get(key)
                if below is None:
                    go[key] = len(first)
                    first.append(i)
                    last.append(n)
                    head.append(leaves)
                    link.append(0)
                    leaves += 1
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    size = last[below] - first[below]
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    cut = first[below] + length
                    if s[cut] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    split = go[key] = len(first)
                    first += (first[below], i)
                    last += (cut, n)
                    head += (head[below], leaves)
                    link += (0, 0)
                    leaves += 1
                    go[split * wide + s[cut]] = below
                    go[split * wide + c] = split + 1
                    first[below] = cut
                    if fresh:
                        link[fresh] = split
                    fresh = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        key, kid = np.fromiter(go.keys(), np.int64, len(go)), np.fromiter(go.values(), np.int64, len(go))
        order = np.argsort(key)
        key = key[order]
        self.kids = kid[order]  # by parent, then by symbol
        self.ended = key % wide == 0
        self.at = np.searchsorted(key // wide, np.arange(len(first) + 1))
        self.head = np.asarray(head)
        self.depth = np.asarray(last) - self.head
        self.depth[0] = 0

    def tour(self, opposite: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in the order of their suffixes, and the depth of the turn before each.  The end mark is smallest, for
        the opposite order of the symbols too."""
        kids, at, depth = self.kids.tolist(), self.at.tolist(), self.depth.tolist()
        if opposite:
            ended = self.ended.tolist()
        leaves, turns = [], []
        stack = [(0, 0)]
        while stack:
            v, turn = stack.pop()
            lo, hi = at[v], at[v + 1]
            if lo == hi:
                leaves.append(v)
                turns.append(turn)
                continue
            own = kids[lo:hi]
            if opposite:
                own = [own[0], *own[:0:-1]] if ended[lo] else own[::-1]
            d = depth[v]
            stack += [(x, d) for x in own[:0:-1]]
            stack.append((own[0], turn))
        return self.head[leaves], np.asarray(turns)


class Extension:
    """Longest common extensions of places of a text, from the tour of its tree."""

    def __init__(self, places: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(places), np.int64)
        self.rank[places] = np.arange(len(places))
        self.least = [turns.astype(np.int32)]
        while (half := 1 << (len(self.least) - 1)) * 2 <= len(turns):
            below = self.least[-1]
            self.least.append(np.minimum(below[:-half], below[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            hit = level == k
            out[hit] = np.minimum(self.least[k][lo[hit]], self.least[k][hi[hit] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank."""
    value = rank.tolist()
    n = len(value)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, value[i]
        while j < n and value[j] > own:
            j = out[j]
        out[i] = j
    return np.asarray(out)


def runs_of(symbols: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period."""
    n = len(symbols)
    if n < max(least, exponent):
        return np.zeros((0, 3), np.int64)
    s = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(s)
    places, turns = tree.tour()
    right = Extension(places, turns)
    ranks = [right.rank]
    other = np.empty(n + 1, np.int64)
    other[tree.tour(True)[0]] = np.arange(n + 1)
    ranks.append(other)
    del tree
    left = Extension(*SuffixTree(s[::-1]).tour())  # place x of the text is n - 1 - x of the reversal
    found = []
    for rank in ranks:
        i = np.arange(n)
        j = next_smaller(rank)[:n]
        i, j = i[j < n], j[j < n]
        p = j - i
        end = j + right.of(i, j)
        back = left.of(n - i, n - j)  # what ends before i and j
        start = i - back
        good = end - start >= np.maximum(exponent * p, least)
        found.append(np.stack([start[good], (end - start)[good], p[good]], 1))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def stretches(words: np.ndarray, own: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of `words` (numbers; own: the text of each) that can hold a run."""
    at, part = np.arange(len(words)), own
    times = min(exponent - 1, max(least, exponent) - 2)
    for _ in range(SIFTS):
        if len(at) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = words[at].astype(np.uint64)
        key = np.zeros(len(at) - 2, np.uint64)
        for j, x in enumerate((part.astype(np.uint64), w[:-2], w[1:-1], w[2:])):
            key = key * np.uint64(0xD1342543DE82EF95) + (x[:len(key)] if j == 0 else x) + np.uint64(1)
        bits = max(8, len(key).bit_length() + 1)
        slot = (flat.mix(key) >> np.uint64(64 - bits)).astype(np.int64)
        whole = part[:-2] == part[2:]
        often = whole & (np.bincount(slot[whole], minlength=1 << bits)[slot] >= times)
        live = np.zeros(len(at), bool)
        for j in range(3):
            live[j:len(at) - 2 + j] |= often
        before = len(at)
        at, part = at[live], part[live]
        part = np.cumsum(np.r_[True, (np.diff(at) > 1) | (np.diff(part) != 0)]) if len(at) else part
        size = np.bincount(part)[part] if len(at) else np.zeros(0)
        at, part = at[size >= least], part[size >= least]
        if len(at) > 0.98 * before:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, np.diff(part) != 0, True])
    return at[cut[:-1]], at[cut[1:] - 1] + 1


def _batch(data: np.ndarray, off: np.ndarray, exponent: int, least: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed text of each text."""
    start, end, at = flat.words(data, off)
    n = len(off) - 1
    own = np.repeat(np.arange(n), np.diff(at))
    place = np.r_[0, np.cumsum(end - start)]
    letters = pa.py_buffer(np.ascontiguousarray(data[~flat.SPACE[data]]))
    spelt = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place.astype(np.int64)), letters])
    words = pc.dictionary_encode(spelt).indices.to_numpy()
    found = []
    for lo, hi in zip(*stretches(words, own, exponent, least), strict=True):
        got = runs_of(words[lo:hi], exponent, least)
        if len(got):
            found.append(np.c_[got[:, 0] + lo, got[:, 1:], np.full(len(got), own[lo])])
    runs = np.concatenate([*found, np.zeros((0, 4), np.int64)])
    gone = np.zeros(len(start) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(gone)[:-1] == 0
    # A kept word's bytes and, unless it is the text's last kept one, the white space after it as one space.
    edge = np.zeros(len(data) + 1, np.int64)
    edge[start[keep]] += 1
    edge[end[keep]] -= 1
    taken = np.cumsum(edge[:-1]) > 0
    kept = np.flatnonzero(keep)
    inner = kept[:-1][own[kept[:-1]] == own[kept[1:]]]
    taken[end[inner]] = True
    text = data.copy()
    text[end[inner]] = 32
    length = np.r_[0, np.cumsum(taken)][off]
    collapsed = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(length.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text[taken]))])
    bounds = np.searchsorted(runs[:, 3], np.arange(n + 1))
    rows = pa.StructArray.from_arrays([pa.array(runs[:, 0] - at[runs[:, 3]]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows), collapsed.cast(pa.string())


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The `keep` columns, runs (start, length, period, by start and period) and collapsed: the words joined by one
    space, without those that a run holds after its first period."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = rows.select("row").withColumns({"runs": F.array().cast(RUNS), "collapsed": F.lit("")}).schema

    def run(batches):
        for b in batches:
            for lo, hi, data, off in flat.chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("row").slice(lo, hi - lo), *_batch(data, off, exponent, least)], names=["row", "runs", "collapsed"])

    return rows.mapInArrow(run, schema).select(*(F.col("row")[c].alias(c) for c in keep), "runs", "collapsed")
