"""A run-compressed Burrows-Wheeler index of many short texts, and matching statistics streamed through it.

Suffixes are sorted by prefix doubling that touches only what is not yet told apart. Of the transform only runs stay: where
a run begins, its character, where its first row goes by the LF mapping, and the text positions of its first and last
row. Matching statistics walk patterns from right to left, all of them in step: where a pattern's next character is the
run's, a row moves by LF and the match grows; else it jumps to the nearer sampled run end of that character that
matches further, and the match is cut to what the two positions have in common.
"""

from __future__ import annotations

import numpy as np

#: Texts are UTF-8, which never holds this byte; it ends each of them and sorts last.
END = 0xFF


def _eights(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each position on, as numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), kind, padded.data, strides=(1,))


def joined(texts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes one after another, and their lengths) with END after each, and where each begins."""
    start = size.cumsum() - size + np.arange(len(size))
    out = np.full(len(texts) + len(size), END, np.uint8)
    keep = np.ones(len(out), bool)
    keep[start + size] = False
    out[keep] = texts
    return out, start


def suffixes(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions by the order of what begins there, to its END; equal ones by position. left: bytes before each position's END."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # Sorted are numbers that end with a place, which is several times as fast as sorting places by numbers.
    bits = np.uint64(max(1, n - 1).bit_length())
    step = (64 - int(bits)) // 8
    first = _eights(data, ">u8")[:n].astype(np.uint64)
    short = np.flatnonzero(left < 7)
    keep = (7 - left[short]).astype(np.uint64) * np.uint64(8)
    first[short] = (first[short] >> keep) << keep
    first >>= np.uint64(64 - 8 * step)
    first = (first << bits) | np.arange(n, dtype=np.uint64)
    first.sort()
    order, key = (first & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), first >> bits
    if int(left.max()) < 256:
        left = left.astype(np.uint8)  # fits into the processor's memory
    slots, rank = np.arange(n), np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(key)))
        at = order[slots]
        rank[at] = np.repeat(slots[head], size)
        more = np.repeat(size > 1, size)
        if not more.any():
            return order
        slots, at, group = slots.compress(more), at.compress(more), new.compress(more).cumsum(dtype=np.uint64) - np.uint64(1)
        # What has ended is told apart by its position; the rest by what follows the part that is compared already.
        second = np.where(left[at] < step, at, rank[np.minimum(at + step, n - 1)])
        key = (group << bits) | second.astype(np.uint64)
        of_place = np.uint64(max(1, len(at) - 1).bit_length())
        if int(key[-1] >> bits).bit_length() + int(bits) + int(of_place) <= 64:
            key = (key << of_place) | np.arange(len(at), dtype=np.uint64)
            key.sort()
            by_key, key = (key & ((np.uint64(1) << of_place) - np.uint64(1))).astype(np.int64), key >> of_place
        else:
            by_key = np.argsort(key)
            key = key[by_key]
        order[slots] = at[by_key]
        step *= 2


class RunIndex:
    """Texts, each with a number (its earliest document): long matches of any pattern, and the least number among them."""

    def __init__(self, texts: np.ndarray, size: np.ndarray, numbers: np.ndarray, window: int) -> None:
        self.window, self.numbers = window, numbers
        self.data, self.start = joined(texts, size)
        own = np.repeat(np.arange(len(size)), size + 1)
        left = (self.start + size)[own] - np.arange(len(self.data))
        order = suffixes(self.data, left)
        self.eight = _eights(self.data, "<u8")
        before = self.data[order - 1]
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        char, length = before[head], np.diff(np.append(head, len(order)))
        by_char = np.argsort(char, kind="stable")
        self.first_row, self.char = head, char
        self.lf = np.empty(len(head), np.int64)
        self.lf[by_char] = length[by_char].cumsum() - length[by_char]
        self.bounds = np.append(head, len(order))
        self.lands = np.empty(len(head), np.int64)
        self.lands[by_char] = np.searchsorted(head, self.lf[by_char], side="right") - 1  # ascending: neighbours are looked up together
        # Samples of the run ends, in the order of (character, row).
        self.keys = (char[by_char].astype(np.int64) << 40) | head[by_char]
        self.last_row = (head + length - 1)[by_char]
        self.head_at, self.tail_at = order[head[by_char]], order[self.last_row]
        self.goes, self.goes_run = self.lf[by_char], self.lands[by_char]
        self._intervals(order, left, own, numbers)

    def _intervals(self, order: np.ndarray, left: np.ndarray, own: np.ndarray, numbers: np.ndarray) -> None:
        """Rows with a window in common: where such an interval begins and ends, and its least number."""
        rows = np.flatnonzero(left[order] >= self.window)
        at = order[rows]
        same = np.flatnonzero(rows[1:] == rows[:-1] + 1)
        for off in [*range(0, self.window - 7, 8), self.window - 8]:
            same = same[self.eight[at[same] + off] == self.eight[at[same + 1] + off]]
        linked = np.zeros(len(rows) + 1, bool)
        linked[same + 1] = True
        begin = np.flatnonzero(~linked[:-1] & linked[1:])
        end = np.flatnonzero(linked[:-1] & ~linked[1:])
        values = numbers[own[at]]
        bounds = np.stack([begin, end + 1], axis=1).ravel()
        if not len(begin):
            self.least = self.interval_first = self.interval_last = np.zeros(0, np.int64)
            return
        self.least = np.minimum.reduceat(np.append(values, 0), bounds)[::2]
        self.interval_first, self.interval_last = rows[begin], rows[end]

    def statistics(self, patterns: np.ndarray, size: np.ndarray, own: bool = False):
        """Matching statistics, streamed: (pattern numbers, position in the pattern, match lengths, rows, places in the index) from each pattern's last character on.

        own: the patterns are the index's texts, in their order; their walks begin at their ENDs.
        """
        by_size = np.argsort(-size, kind="stable")
        size, begin = size[by_size], (size.cumsum() - size)[by_size]
        ends = len(self.data) - len(self.start)
        row = by_size + ends if own else np.full(len(size), ends, np.int64)
        matched = np.zeros(len(size), np.int64)
        found = (np.append(self.start[1:], len(self.data)) - 1)[row - ends]
        eight = _eights(patterns, "<u8")
        run = np.searchsorted(self.first_row, row, side="right") - 1
        for step in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size, -step, side="left"))
            row, matched, found = row[:active], matched[:active] + 1, found[:active] - 1
            place = size[:active] - 1 - step
            byte = patterns[begin[:active] + place]
            run = run[:active]
            off = np.flatnonzero(self.char[run] != byte)
            moved = self.lf[run] + row - self.first_row[run]
            if len(off):
                moved[off], matched[off], found[off], jumped = self._jump(row[off], byte[off], matched[off] - 1, eight, begin[off] + place[off] + 1)
            guess = self.lands[run]
            if len(off):
                guess[off] = jumped
            row, run = moved, self._run_of(moved, guess)
            yield by_size[:active], place, matched, row, found

    def _run_of(self, row: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """The runs of rows, which are few runs after where their runs' first rows went."""
        late = np.flatnonzero(row >= self.bounds[guess + 1])
        for _ in range(4):
            if not len(late):
                return guess
            guess[late] += 1
            late = late[row[late] >= self.bounds[guess[late] + 1]]
        guess[late] = np.searchsorted(self.first_row, row[late], side="right") - 1
        return guess

    def _jump(self, row: np.ndarray, byte: np.ndarray, matched: np.ndarray, eight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, match lengths, places and the runs to look from after a step on a character that the run at hand does not have."""
        below = np.searchsorted(self.keys, (byte.astype(np.int64) << 40) | row)
        ends = len(self.data) - len(self.start)
        best, target, place = np.full(len(row), -1, np.int64), np.full(len(row), ends, np.int64), np.full(len(row), self.start[1] - 1 if len(self.start) > 1 else len(self.data) - 1)
        near = np.full(len(row), np.searchsorted(self.first_row, ends, side="right") - 1)
        for run, samples, rows in ((below - 1, self.tail_at, self.last_row), (below, self.head_at, None)):
            there = np.flatnonzero((run >= 0) & (run < len(self.keys)))
            there = there[self.keys[run[there]] >> 40 == byte[there]]
            which = run[there]
            common = self._common(eight, at[there], samples[which], matched[there])
            goes = self.goes[which]
            if rows is not None:
                goes = goes + rows[which] - (self.keys[which] & ((1 << 40) - 1))
            better = common > best[there]
            best[there[better]], target[there[better]], place[there[better]] = common[better], goes[better], samples[which][better] - 1
            near[there[better]] = self.goes_run[which[better]]
        return target, best + 1, place, near

    def _common(self, eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the pattern from a on and the indexed text from b on have in common, `most` at most."""
        out = most.copy()
        todo = np.flatnonzero(most > 0)
        off = 0
        while len(todo):
            differ = eight[np.minimum(a[todo] + off, len(eight) - 1)] ^ self.eight[np.minimum(b[todo] + off, len(self.data))]
            low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            hit = differ != 0
            out[todo[hit]] = np.minimum(out[todo[hit]], off + low[hit])
            off += 8
            todo = todo[~hit]
            todo = todo[out[todo] > off]
        return out

    def earliest(self, patterns: np.ndarray, size: np.ndarray, own: bool = False) -> np.ndarray:
        """For each window of each pattern, one after another, the least number of an indexed text that holds it.

        For patterns that are the index's own texts a window that occurs once gets the largest number there is; so does, for
        others, one that no text holds.
        """
        none = np.iinfo(np.int64).max
        count = np.maximum(size - self.window + 1, 0)
        base = count.cumsum() - count
        out = np.full(int(count.sum()), none, np.int64)
        for which, place, matched, row, found in self.statistics(patterns, size, own):
            long = np.flatnonzero(matched >= self.window)
            if len(long):
                at = np.searchsorted(self.interval_first, row[long], side="right") - 1
                number = np.full(len(long), none) if own else self.numbers[np.searchsorted(self.start, found[long], side="right") - 1]
                inside = np.flatnonzero((at >= 0) & (row[long] <= np.append(self.interval_last, 0)[at]))
                number[inside] = self.least[at[inside]]
                out[base[which[long]] + place[long]] = number
        return out
