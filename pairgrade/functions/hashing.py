"""Keyed hashes: the seeded, order-free replacement of random draws."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column, functions as F


def keyed_md5(*parts) -> Column:
    """Lower-case hex md5 of the parts joined by '|'; literals allowed."""
    return F.md5(_joined(parts))


def keyed_sha256(*parts) -> Column:
    return F.sha2(_joined(parts), 256)


def _joined(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hex_to_long(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def draw_index(hash_hex: Column, n: Column | int) -> Column:
    """Index in [0, n), uniform to within n / 2**60: first 15 hex digits modulo n."""
    n = n if isinstance(n, Column) else F.lit(n)
    return (hex_to_long(F.substring(hash_hex, 1, 15)) % n).cast("bigint")


def pair_key_hash(a: Column, b: Column) -> Column:
    """First 32 hex digits of sha256('min|max'); equal for (a, b) and (b, a)."""
    return F.substring(keyed_sha256(F.least(a, b), F.greatest(a, b)), 1, 32)


# ------------------------------------------------- many short hashes in a task

_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_STEP = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_FIRST = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
LANES, ONE_BLOCK = 32768, 55  # messages hashed at a time; bytes of a message that is one block of md5


def _md5_block(words: list, out: np.ndarray) -> None:
    """First 64 bits of the md5 of messages of one block: 16 words, arrays of one number for each message or numbers."""
    shape = out.shape
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _FIRST)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        a += f
        word = words[_WORD[i]]
        if isinstance(word, np.ndarray):
            a += word
            a += _STEP[i]
        else:
            a += np.uint32((int(word) + int(_STEP[i])) & 0xFFFFFFFF)
        turn = _TURN[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    a += _FIRST[0]
    b += _FIRST[1]
    np.bitwise_or(a.byteswap().astype(np.uint64) << np.uint64(32), b.byteswap(), out)


def md5_leading(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """Leading 64 bits of md5(head + tail): a row for each tail, a column for each head.

    Messages of equal lengths of head and tail are hashed together, step by step over arrays; only messages over one
    block are hashed one by one."""
    out = np.empty((len(tails), len(heads)), np.uint64)
    groups = []
    for texts in (heads, tails):
        size = np.array([len(x) for x in texts], np.int64)
        groups.append([(int(n), np.flatnonzero(size == n)) for n in np.unique(size)])
    for head_len, cols in groups[0]:
        for tail_len, rows in groups[1]:
            total = head_len + tail_len
            if total > ONE_BLOCK:
                held = b"".join([md5(heads[j] + tails[i]).digest()[:8] for i in rows for j in cols])
                out[np.ix_(rows, cols)] = np.frombuffer(held, ">u8").reshape(len(rows), len(cols))
                continue
            sides = []
            for texts, at, lo, n in ((heads, cols, 0, head_len), (tails, rows, head_len, tail_len)):
                block = np.zeros((len(at), 64), np.uint8)
                block[:, lo:lo + n] = np.frombuffer(b"".join([texts[i] for i in at]), np.uint8).reshape(len(at), n)
                sides.append(block)
            sides[0][:, total] = 0x80
            sides[0][:, 56:] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
            head, tail = (np.ascontiguousarray(x.view("<u4").T) for x in sides)
            some = max(1, LANES // len(cols))
            for lo in range(0, len(rows), some):
                part = rows[lo:lo + some]
                words = [np.bitwise_or(tail[k, lo:lo + some, None], head[k][None]) if 4 * k <= total else head[k, 0] for k in range(16)]
                found = np.empty((len(part), len(cols)), np.uint64)
                _md5_block(words, found)
                out[np.ix_(part, cols)] = found
    return out
