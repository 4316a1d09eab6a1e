"""MD5 keys of many short texts ``prefix + number`` at once: the numpy form of ``sampling.keyed`` inside tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np

STEPS = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
POWERS = 10 ** np.arange(1, 19, dtype=np.int64)
#: Bytes of one block.
BLOCK = 55


def digests(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """MD5 of one block each: the first words of the padded messages (by word, message), and the messages' lengths in bits."""
    a, b, c, d = (np.full(len(bits), x) for x in START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        a += STEPS[i]
        if g == 14:
            a += bits
        elif g < len(words):
            a += words[g]
        turn = TURNS[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), out=t)
        a >>= np.uint32(32 - turn)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + y for x, y in zip((a, b, c, d), START, strict=True)], 1)


def numbered_keys(prefixes: list[bytes], owner: np.ndarray, number: np.ndarray, chunk: int = 1 << 13) -> np.ndarray:
    """(n, 16) bytes: the md5 of each owner's prefix and the decimal number (not below 0)."""
    length = np.array([len(x) for x in prefixes], np.int64)
    highest = int(number.max()) if len(number) else 0
    if len(length) and length.max() + len(str(highest)) > BLOCK:
        begun = [hashlib.md5(x) for x in prefixes]
        out = bytearray()
        for o, n in zip(owner.tolist(), number.tolist(), strict=True):
            h = begun[o].copy()
            h.update(b"%d" % n)
            out += h.digest()
        return np.frombuffer(bytes(out), np.uint8).reshape(-1, 16)
    width = int(length.max()) if len(length) else 0
    table = np.zeros((len(prefixes), width), np.uint8)
    for i, x in enumerate(prefixes):
        table[i, : len(x)] = np.frombuffer(x, np.uint8)
    out = np.empty((len(number), 4), "<u4")
    for low in range(0, len(number), chunk):
        o, rest = owner[low : low + chunk], number[low : low + chunk].astype(np.uint32 if highest < 1 << 32 else np.int64)
        end = length[o] + np.searchsorted(POWERS, rest, "right") + 1
        text = np.zeros((len(o), -(-(int(end.max()) + 1) // 4) * 4), np.uint8)
        text[:, :width] = table[o][:, : text.shape[1]]
        flat, at = text.ravel(), np.arange(len(o)) * text.shape[1] + end
        flat[at] = 0x80
        while len(rest):
            at = at - 1
            flat[at] = 48 + rest % 10
            rest = rest // 10
            more = rest > 0
            if not more.all():
                at, rest = at[more], rest[more]
        out[low : low + chunk] = digests(np.ascontiguousarray(text.view("<u4").T), (end * 8).astype(np.uint32))
    return out.view(np.uint8).reshape(-1, 16)
