"""Vectorised hashes of words, for whole Arrow batches of texts.

A word is a run of bytes other than 20 and 09 to 0D, with A-Z lower-cased. Its 64-bit hash mixes each eight bytes with
their place, adds them up and mixes the sum with the length; equal words always have equal hashes, on every machine.
Nothing in it is a polynomial over bytes, so long words of a regular build do not collide on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text hashed at once; bounds memory only
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_PLACE, _LENGTH, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes in ascending order, equal ones as they come, and the hashes so ordered.

    Sorting numbers is several times as fast as sorting places by them, so the places replace the low bits; the few
    hashes that differ there only are put right afterwards.
    """
    low = np.uint64((1 << max(1, len(keys) - 1).bit_length()) - 1)
    both = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        upper = found | low
        mixed = np.unique(upper[1:][found[1:] < found[:-1]])
        if len(mixed) > 1000:  # not spread as hashes are
            order = np.argsort(keys, kind="stable")
            return order, keys[order]
        for i, j in zip(np.searchsorted(upper, mixed).tolist(), np.searchsorted(upper, mixed, side="right").tolist(), strict=True):
            again = np.argsort(found[i:j], kind="stable")
            order[i:j], found[i:j] = order[i:j][again], found[i:j][again]
    return order, found


def word_bounds(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of one run of bytes begin and end; starts_at: offsets at which a text begins."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    edge[starts_at[starts_at < len(data)]] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    edge[1:-1] = space[1:]
    edge[starts_at[(starts_at > 0) & (starts_at < len(data))]] = True
    return starts, np.flatnonzero(edge[1:] & ~space) + 1


def _hash(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one run of bytes, and where each word starts; starts_at: offsets at which a text begins."""
    starts, ends = word_bounds(data, starts_at)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    low = np.zeros(len(data) + 8, np.uint8)
    LOWER.take(data, out=low[: len(data)])
    eight = np.ndarray((len(data) + 1,), np.uint64, low.data, strides=(1,))
    size = ends - starts
    value = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) ^ _SEED)
    total = mix(value + _PLACE)
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] - 1) >> 3  # further groups of eight bytes
        first = n.cumsum() - n
        group = np.arange(n.sum()) - np.repeat(first, n) + 1
        rest = np.repeat(size[long], n) - 8 * group
        value = mix((eight[np.repeat(starts[long], n) + 8 * group] & _FIRST[np.minimum(rest, 8)]) ^ _SEED)
        total[long] += np.add.reduceat(mix(value + (group + 1).astype(np.uint64) * _PLACE), first)
    return mix(total + size.astype(np.uint64) * _LENGTH), starts


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its texts; null texts are empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, ends) for rows i to j of a column: their word hashes, and after how many hashes each row ends.

    Long texts are cut at white space, so that memory stays bounded by CHUNK, the longest word and eight bytes a word.
    """
    data, at = texts_of(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        part = data[at[i] : at[j]]
        if len(part) <= CHUNK:
            hashes, starts = _hash(part, at[i:j] - at[i])
            yield i, j, hashes, np.searchsorted(starts, at[i + 1 : j + 1] - at[i])
        else:  # one long text
            found, begin = [], 0
            while begin < len(part):
                end = min(len(part), begin + CHUNK)
                if end < len(part):
                    gaps = np.flatnonzero(SPACE[part[begin:end]])
                    if len(gaps):
                        end = begin + int(gaps[-1]) + 1
                    else:
                        after = np.flatnonzero(SPACE[part[end:]])
                        end = end + int(after[0]) + 1 if len(after) else len(part)
                found.append(_hash(part[begin:end], np.zeros(1, np.int64))[0])
                begin = end
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield i, j, hashes, np.array([len(hashes)])
        i = j


_SHINGLE = [np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(column: pa.Array, words: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `words` words.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    factor = [_SHINGLE[k % 5] * np.uint64(2 * (k // 5) + 1) for k in range(words)]
    for i, j, hashes, ends in word_hashes(column):
        long = np.zeros(0, np.uint64)
        if len(hashes) >= words:
            m = len(hashes) - words + 1
            long = hashes[:m] * factor[0]
            for k in range(1, words):
                long = long + hashes[k : k + m] * factor[k]
            long = mix(long)
        begin = 0
        for end in ends.tolist():
            n = end - begin
            if n >= words:
                found = long[begin : end - words + 1].copy()
                found.sort()
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif n:
                value = np.array([n], np.uint64)
                for k in range(begin, end):
                    value = mix(value * _SHINGLE[1] + hashes[k : k + 1])
                yield value
            else:
                yield np.zeros(0, np.uint64)
            begin = end
