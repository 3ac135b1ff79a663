"""FM-index over word ids: suffix array, wavelet matrix over the Burrows-Wheeler transform, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Of runs of positive symbols between zeros, by prefix doubling. Each zero counts as a symbol of its own, smaller
    than all words, so no comparison goes past the end of a run, and the number of rounds is the log of the longest run."""
    n = len(seq)
    zeros = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (rank.max() + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        if new[order[-1]] == n - 1:
            return order
        # ranks stay in order of the first 2k symbols
        rank, k = new, 2 * k


class Bits:
    """A bit vector with rank by popcounts of 64-bit words."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]
        self.total = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: for each bit from the highest, the symbols in stable order of the bits above it."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.levels, rest = [], symbols.astype(np.int64)
        for b in range(width - 1, -1, -1):
            bit = (rest >> b) & 1
            bits = Bits(bit)
            self.levels.append((b, bits, bits.n - bits.total))
            rest = np.r_[rest[bit == 0], rest[bit == 1]]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol c before its i."""
        left, right = np.zeros(len(i), np.int64), i.astype(np.int64)
        for b, bits, zeros in self.levels:
            one = (c >> b) & 1 == 1
            l1, r1 = bits.rank(left), bits.rank(right)
            left, right = np.where(one, zeros + l1, left - l1), np.where(one, zeros + r1, right - r1)
        return right - left

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i, and its rank there."""
        at, start, c = i.astype(np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for _, bits, zeros in self.levels:
            one = bits.get(at)
            c = c << 1 | one
            a1, s1 = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + a1, at - a1), np.where(one, zeros + s1, start - s1)
        return c, at - start


class FmIndex:
    """Counts and locates patterns of positive symbols in a sequence whose zeros separate runs."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        seq = np.r_[0, seq, 0].astype(np.int64)  # each run has a zero on both sides
        self.n, self.sample = len(seq), sample
        sa = suffix_array(seq)
        self.wavelet = Wavelet(seq[sa - 1], max(1, int(symbols).bit_length()))
        self.starts = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols + 1))]
        # positions at a multiple of the rate and at the head of a run: no walk crosses a separator
        known = (sa % sample == 0) | (seq[sa - 1] == 0)
        self.known, self.samples = Bits(known), sa[known]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns of one length (rows), the ranges of suffixes that start with them."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            # both ends in one pass through the levels
            r = self.starts[np.r_[c, c]] + self.wavelet.rank(np.r_[c, c], np.r_[lo[live], hi[live]])
            lo[live], hi[live] = r[: len(c)], r[len(c) :]
            dead = live[lo[live] >= hi[live]]
            hi[dead] = lo[dead]
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: walk to the left until a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            known = self.known.get(at)
            out[todo[known]] = self.samples[self.known.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            if len(todo):
                c, r = self.wavelet.access(at)
                at = self.starts[c] + r
            steps += 1
        return out - 1  # without the zero in front

    def occurrences(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of each occurrence."""
        lo, hi = self.search(patterns)
        counts = hi - lo
        which = np.repeat(np.arange(len(patterns)), counts)
        rows = np.repeat(lo - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        return which, self.locate(rows)
