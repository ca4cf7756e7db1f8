"""Counting quotient filters without loss: compact sorted counters of packed word-id n-grams.

An n-gram is the tuple of its word ids, packed into `n` fields of equal width. A permutation that can be undone spreads
the packed numbers evenly; its top bits name a range, the next ones the quotient, and all bits below them are kept as the
remainder. A filter stores, for the keys of one range in order, how many have each quotient, the remainders, and counts
of one byte (larger ones beside). Nothing is hashed away, so counts are exact and the n-grams can be read back.

Keys are two lanes of 64 bits, aligned to the left; the second is None where 64 bits hold the whole key.
"""

from __future__ import annotations

import struct

import numpy as np

MIXERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
RANGE_BITS = 8  # a filter is cut into so many times more ranges whenever filters are merged
_SMALL = 255
_HEAD = struct.Struct("<IIBBBB")
_ALL = 64

Keys = tuple[np.ndarray, np.ndarray | None]


def _mixed(x: np.ndarray, mixer: np.uint64, bits: int) -> np.ndarray:
    """The top bits of a product with an odd number."""
    return ((x ^ (x >> np.uint64(32))) * mixer) >> np.uint64(_ALL - bits)


def _up(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) if bits < _ALL else np.zeros_like(x)


def _down(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(bits) if bits < _ALL else np.zeros_like(x)


def permuted(words: list[np.ndarray], width: int) -> Keys:
    """Keys of n-grams given as one array of ids per place. Two to three places, ids below 2 ** width, width up to 32."""
    high, low, rest = words[0].astype(np.uint64), words[1].astype(np.uint64), width * (len(words) - 1)
    for w in words[2:]:
        low = (low << np.uint64(width)) | w.astype(np.uint64)
    high = high ^ _mixed(low, MIXERS[0], width)
    low ^= _mixed(high, MIXERS[1], rest)
    high ^= _mixed(low, MIXERS[2], width)
    left = _up(low, _ALL - rest)
    top = _up(high, _ALL - width) | _down(left, width)
    return top, (_up(left, _ALL - width) if width + rest > _ALL else None)


def restored(keys: Keys, width: int, places: int) -> list[np.ndarray]:
    """The ids of each place, from keys."""
    top, more = keys
    rest = width * (places - 1)
    high = _down(top, _ALL - width)
    left = _up(top, width) | (_down(more, _ALL - width) if more is not None else np.uint64(0))
    low = _down(left, _ALL - rest)
    high ^= _mixed(low, MIXERS[2], width)
    low ^= _mixed(high, MIXERS[1], rest)
    high ^= _mixed(low, MIXERS[0], width)
    mask = np.uint64((1 << width) - 1)
    return [high, *((low >> np.uint64(width * k)) & mask for k in reversed(range(places - 1)))]


def folded(keys: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """Distinct keys in order with their counts added; no counts are ones."""
    top, more = keys
    order = np.argsort(top, kind="stable") if more is None else np.lexsort((more, top))
    top, more = top[order], None if more is None else more[order]
    if not len(top):
        return (top, more), np.zeros(0, np.int64)
    first = np.ones(len(top), bool)
    first[1:] = top[1:] != top[:-1] if more is None else (top[1:] != top[:-1]) | (more[1:] != more[:-1])
    starts = np.flatnonzero(first)
    added = np.diff(np.append(starts, len(top))) if counts is None else np.add.reduceat(counts[order], starts)
    return (top[starts], None if more is None else more[starts]), added


def cut(keys: Keys, counts: np.ndarray, bits: int, prefix_bits: int) -> list[tuple[int, bytes]]:
    """(range, filter) of each range of `prefix_bits` top bits that holds keys; keys are distinct and in order."""
    top, more = keys
    if not len(top):
        return []
    prefix_bits = min(prefix_bits, bits)
    ranges = _down(top, _ALL - prefix_bits).astype(np.int64)
    stops = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(top)]
    return [(int(ranges[a]), packed((top[a:b], None if more is None else more[a:b]), counts[a:b], bits, prefix_bits))
            for a, b in zip(stops, stops[1:])]


def packed(keys: Keys, counts: np.ndarray, bits: int, prefix_bits: int) -> bytes:
    """The filter of the keys of one range."""
    top, more = keys
    left = bits - prefix_bits
    quotient = min(left, max(0, len(top).bit_length() - 3))
    quotient += (left - quotient) % 8  # remainders are whole bytes
    skip, size = prefix_bits + quotient, (left - quotient) // 8
    runs = np.bincount(_down(_up(top, prefix_bits), _ALL - quotient).astype(np.int64), minlength=1 << quotient)
    wide = 1 if runs.max() < 1 << 8 else 4
    tail = np.zeros((len(top), 16), np.uint8)
    tail[:, :8] = (_up(top, skip) | (_down(more, _ALL - skip) if more is not None else np.uint64(0))).astype(">u8").view(np.uint8).reshape(-1, 8)
    if more is not None:
        tail[:, 8:] = _up(more, skip).astype(">u8").view(np.uint8).reshape(-1, 8)
    large = np.flatnonzero(counts >= _SMALL)
    return b"".join([_HEAD.pack(len(top), len(large), quotient, size, wide, prefix_bits), runs.astype(f"<u{wide}").tobytes(),
                     tail[:, :size].tobytes(), np.minimum(counts, _SMALL).astype(np.uint8).tobytes(),
                     large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes()])


def unpacked(blob: bytes, range_: int, bits: int) -> tuple[Keys, np.ndarray]:
    """Keys and counts of a filter."""
    n, n_large, quotient, size, wide, prefix_bits = _HEAD.unpack_from(blob)
    at = _HEAD.size
    runs = np.frombuffer(blob, f"<u{wide}", 1 << quotient, at)
    at += wide << quotient
    tail = np.zeros((n, 16), np.uint8)
    tail[:, :size] = np.frombuffer(blob, np.uint8, n * size, at).reshape(n, size)
    at += n * size
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    at += n
    large = np.frombuffer(blob, "<u4", n_large, at)
    counts[large] = np.frombuffer(blob, "<i8", n_large, at + 4 * n_large)
    skip = prefix_bits + quotient
    lanes = np.ascontiguousarray(tail).view(">u8").astype(np.uint64)
    top = np.repeat(np.arange(1 << quotient, dtype=np.uint64), runs)
    top = _up(top, _ALL - skip) | _down(lanes[:, 0], skip)
    if prefix_bits:
        top |= np.uint64(range_ << (_ALL - prefix_bits))
    return (top, _up(lanes[:, 0], _ALL - skip) | _down(lanes[:, 1], skip) if bits > _ALL else None), counts


def merged(filters: list[tuple[bytes, int]], bits: int) -> tuple[Keys, np.ndarray]:
    """Distinct keys in order and their added counts, of filters given with their ranges."""
    parts = [unpacked(blob, range_, bits) for blob, range_ in filters]
    tops = np.concatenate([k[0] for k, _ in parts])
    more = np.concatenate([k[1] for k, _ in parts]) if bits > _ALL else None
    return folded((tops, more), np.concatenate([n for _, n in parts]))
