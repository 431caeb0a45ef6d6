"""A run-length index: the run-compressed Burrows-Wheeler transform of some
short strings with sampled run ends, and matching statistics streamed over it.

The strings stand one after the other, each ended by a separator, and suffixes
are ordered as if the separators grew from left to right.  Of the transform its
runs are kept, with the number of the run at each place, and of the suffix array
only the entries at run ends; a step to the left looks up the run it leaves.  Where
a pattern's next letter does not follow, the search moves to the end of the nearest
run of that letter before or after, found by bisection, whichever continues the
match further (by comparing the text), so the length of the longest match is known at every position.  All
patterns advance together, one array operation at a time.
"""

from __future__ import annotations

import numpy as np

#: Not a byte of UTF-8.
SEPARATOR = 0xFF


def _join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings, a separator after each, and where each begins (length + 1)."""
    length = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    return np.frombuffer(bytes([SEPARATOR]).join([*strings, b""]), np.uint8), np.concatenate([[0], np.cumsum(length)])


class RunIndex:
    """``owner`` has a number for each string; ``least_owner`` gives, for a match
    of ``depth`` bytes (8 or more), the least number among all strings that hold it."""

    def __init__(self, strings: list[bytes], owner: np.ndarray, depth: int):
        text, starts = _join(strings)
        n = self.n = len(text)
        self.depth = depth
        at = np.arange(n)
        ends = starts[1:] - 1
        ahead = np.repeat(ends, np.diff(starts)) - at  # letters before the separator
        # eight letters as a number, nothing behind a separator
        wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(7, np.uint8)]), 8)
        word = np.ascontiguousarray(wide).view(">u8")[:, 0].astype(np.uint64)
        word &= ~np.uint64(0) << (np.uint64(8) * np.maximum(7 - ahead, 0).astype(np.uint64))
        self.word = np.concatenate([word, np.zeros(8 + int(ahead.max(initial=0)), np.uint64)])
        rank = self._ranks(word)
        step, prefix = 8, None
        while True:
            if step <= depth < 2 * step:  # equal pairs of these ranks are equal prefixes of the depth
                there = np.minimum(at + depth - step, n - 1)
                prefix = (rank, np.where(ahead >= depth, rank[there], -1))
            if step > ahead.max(initial=0):
                break
            second = np.where(ahead >= step, rank[np.minimum(at + step, n - 1)] + 1, 0)
            rank = self._ranks(rank * (n + 1) + second)
            step *= 2
        suffix = np.argsort(rank * n + at)  # equal ones by their separators
        last = text[suffix - 1]  # of the first string's first suffix: the last separator
        head = np.concatenate([[True], last[1:] != last[:-1]])
        self.run_start = np.flatnonzero(head)
        self.run_letter = last[self.run_start].astype(np.int64)
        self.run_length = np.diff(np.append(self.run_start, n))
        self.first_suffix = suffix[self.run_start]
        self.last_suffix = suffix[self.run_start + self.run_length - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:256]
        self.by_letter = np.argsort(self.run_letter, kind="stable")
        self.key = self.run_letter[self.by_letter] * n + self.run_start[self.by_letter]
        # of each place in the transform its run, and of each run its place by letter
        self.run_at = np.repeat(np.arange(self.runs, dtype=np.int32), self.run_length)
        self.place = np.empty(self.runs, np.int64)
        self.place[self.by_letter] = np.arange(self.runs)
        count = np.cumsum(self.run_length[self.by_letter]) - self.run_length[self.by_letter]
        letter = self.run_letter[self.by_letter]
        self.before = count - count[np.searchsorted(letter, letter)]
        # intervals of suffixes that share their first ``depth`` bytes
        if prefix is None:
            prefix = (at, np.full(n, -1))
        a, b = prefix[0][suffix], prefix[1][suffix]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) | (b < 0)
        self.owner_of = np.minimum.reduceat(np.repeat(owner, np.diff(starts))[suffix], np.flatnonzero(new))
        self.interval_at = np.cumsum(new, dtype=np.int32) - np.int32(1)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        """Of each key the number of distinct smaller ones."""
        order = np.argsort(key)
        rank, key = np.empty(len(key), np.int64), key[order]
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        return rank

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def _common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Letters that the texts at a and b have in common, up to ``limit``."""
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0)
        while len(live):
            x = self.word[a[live] + out[live]] ^ self.word[b[live] + out[live]]
            same = np.full(len(live), 8)
            for k in range(7, -1, -1):
                same[(x >> np.uint64(8 * (7 - k))) & np.uint64(0xFF) != 0] = k
            out[live] += same
            live = live[(same == 8) & (out[live] < limit[live])]
        return np.minimum(out, limit)

    def least_owner(self, position: np.ndarray) -> np.ndarray:
        return self.owner_of[self.interval_at[position]]

    def matching_statistics(self, patterns: list[bytes]):
        """Yields (pattern numbers, position, match lengths, positions in the
        transform) from the last position of the patterns to the first."""
        text, starts = _join(patterns)
        size = np.diff(starts) - 1
        by_size = np.argsort(-size, kind="stable")
        text, size, starts = text.astype(np.int64), size[by_size], starts[:-1][by_size]
        q, suffix, length = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        suffix[:] = self.first_suffix[0]
        for step in range(1, int(size.max(initial=0)) + 1):
            live = int(np.searchsorted(-size, -step, "right"))
            c = text[starts[:live] + size[:live] - step]
            run = self.run_at[q[:live]]
            k = self.place[run]  # of the run that is left by the step
            miss = np.flatnonzero(self.run_letter[run] != c)
            known = np.ones(live, bool)
            if len(miss):
                behind = np.searchsorted(self.key, c[miss] * self.n + q[miss])
                sides = []
                for side, samples, shift in ((behind - 1, self.last_suffix, -1), (behind, self.first_suffix, 0)):
                    there = self.by_letter[np.clip(side, 0, len(self.key) - 1)]
                    fits = (side >= 0) & (side < len(self.key)) & (self.run_letter[there] == c[miss])
                    to = self.run_start[there] + (self.run_length[there] - 1 if shift else 0)
                    share = np.where(fits, self._common(suffix[miss], samples[there], np.where(fits, length[miss], 0)), -1)
                    sides.append((to, samples[there], share))
                (t0, s0, l0), (t1, s1, l1) = sides
                later = l1 > l0
                best = np.maximum(l0, l1)
                known[miss[best < 0]] = False
                ok = best >= 0
                k[miss[ok]] = np.where(later, behind, behind - 1)[ok]
                q[miss[ok]] = np.where(later, t1, t0)[ok]
                suffix[miss[ok]] = np.where(later, s1, s0)[ok]
                length[miss] = np.maximum(best, 0)
            to = self.below[c] + self.before[k] + q[:live] - self.run_start[self.by_letter[k]]
            q[:live] = np.where(known, to, q[:live])
            suffix[:live] = np.where(known, suffix[:live] - 1, suffix[:live])
            length[:live] = np.where(known, length[:live] + 1, 0)
            yield by_size[:live], size[:live] - step, length[:live], q[:live]
