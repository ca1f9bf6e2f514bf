"""Language identification, quality scores and rounding against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from pairgrade.llm import flat, langid, mixing, quality


def texts(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def test_ppm_equals_dict_tries():
    rng = random.Random(3)
    learn = {"a": texts(rng, "abc d", 25) + ["é漢"], "b": texts(rng, "bcd e,", 25), "c": texts(rng, "xy z", 20)}
    order = 3
    tries = {}
    for name, rows in learn.items():
        tries[name] = [defaultdict(Counter) for _ in range(order + 1)]
        for t in rows:
            raw = bytes(order) + t.encode()
            for i in range(order, len(raw)):
                for d in range(order + 1):
                    tries[name][d][raw[i - d:i]][raw[i]] += 1

    def bits(name, context, symbol):
        for_d = 0.0
        for d in range(order, -1, -1):
            seen = tries[name][d].get(context[len(context) - d:])
            if not seen:
                continue
            n, q = sum(seen.values()), len(seen)
            if seen[symbol]:
                return for_d - math.log2(seen[symbol] / (n + q))
            for_d -= math.log2(q / (n + q))
        return for_d + 8

    counts = []
    for name, rows in learn.items():
        key, n = np.unique(langid.grams(*flat.utf8(pa.array(rows)), order), return_counts=True)
        counts.append((name, key, n))
    model = langid.build(counts, order)
    asked = texts(rng, "abcdexyz ,q", 50) + ["", "漢字é", "a" * 5000]
    data, off = flat.utf8(pa.array(asked))
    cost = flat.per_text(model.code(langid.grams(data, off, order)), off)
    for i, t in enumerate(asked):
        raw = bytes(order) + t.encode()
        want = [sum(bits(name, raw[j - order:j], raw[j]) for j in range(order, len(raw))) for name in model.languages]
        assert np.allclose(cost[i], want, rtol=1e-4, atol=1e-3), t


def test_quality_equals_averaged_vectors():
    rng = random.Random(4)
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.25, 1)
    rows = ["", "a", "ab", "one two two three", "é 漢字 x", " spaced  out "] + texts(rng, "abc de\n", 40)
    data, off = flat.utf8(pa.array(rows))
    got = model.logit(data, off)
    word = lambda w: int(flat.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    mix = lambda x: int(flat.mix(np.array([x % 2**64], np.uint64))[0])
    for i, t in enumerate(rows):
        raw = t.encode()
        h = [word(w) for w in raw.split()]
        used = [x >> 48 for x in h]
        used += [(int(quality._SAME) if a == b else mix(a * 3 + b)) >> 48 for a, b in zip(h, h[1:])]
        for n in (3, 4):
            for j in range(len(raw) - n + 1):
                gram = sum(raw[j + k] << (8 * k) for k in range(n)) % 2**32
                used.append(((gram + (n << 32)) * 0x9E3779B97F4A7C15) % 2**64 >> 48)
        want = sum(float(model.weight[b]) for b in used) / max(1, len(used)) + 0.25
        assert abs(got[i] - want) < 1e-4, t


def test_pivotal_rounding_is_fair_and_keeps_the_mass():
    size, part = np.array([5, 1, 3, 8, 2, 13.0]), np.array([0.2, 0.9, 0.5, 0.0, 0.35, 0.61])
    mean, runs = np.zeros(len(part)), 4000
    for seed in range(runs):
        out = mixing.settle(size, part, np.random.default_rng(seed))
        assert abs((size * out).sum() - (size * part).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1 and ((out >= 0) & (out <= 1)).all()
        mean += out
    assert np.abs(mean / runs - part).max() < 4 * 0.5 / math.sqrt(runs)
