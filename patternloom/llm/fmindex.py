"""FM-index over a sequence of small integers: suffix order, wavelet ranks, backward search, locating."""

from __future__ import annotations

import numpy as np

SAMPLE = 16  # one text position in so many is kept


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; prefixes double, and only ties are sorted again."""
    n = len(text)
    bits = (int(text.max()) + 1).bit_length() if n else 1
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[: max(0, n - j)] |= text[j:] + 1  # 0 stands for the end
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank the suffixes in ``slots`` by their first slot of equal keys; return the slots of ties."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        head = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[order[slots]] = head
        tied = ~new
        tied[:-1] |= ~new[1:]
        return slots[tied]

    slots = regroup(np.arange(n), key[order]) if n else np.zeros(0, np.int64)
    while len(slots):
        at = order[slots]
        after = at + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        order[slots] = at[by]
        slots = regroup(slots, key[by])
        depth *= 2
    return order


class Bits:
    """Bit vector with the number of ones before any position."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit, bitorder="little")
        packed = np.concatenate((packed, np.zeros(8 + (-len(packed)) % 8, np.uint8)))
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class Wavelet:
    """Wavelet tree with one bit vector a level (as a matrix: zeros of a level go before its ones)."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in reversed(range(bits)):
            bit = (seq >> level) & 1
            self.levels.append((level, Bits(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        start = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def symbols(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            one = bits.get(i).astype(bool)
            out |= one.astype(np.int64) << level
            a = bits.ones(i)
            i = np.where(one, zeros + a, i - a)
        return out


class FMIndex:
    """Index of a sequence of numbers from 0 on; an end mark below all of them is added."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.concatenate((text.astype(np.int64) + 1, [0]))
        self.n, top = len(text), int(text.max())
        order = suffix_order(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.last = Wavelet(text[order - 1], max(1, top.bit_length()))
        kept = order % sample == 0
        self.kept, self.places = Bits(kept.astype(np.uint8)), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every row of ``patterns`` (its first ``lengths`` symbols) the range of suffixes that begin with it."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1 if len(lengths) else 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back].astype(np.int64) + 1
            known = symbol < len(self.first) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back through the text until a kept position."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            done = self.kept.get(at).astype(bool)
            out[todo[done]] = self.places[self.kept.ones(at[done])] + steps
            todo, at, steps = todo[~done], at[~done], steps + 1
            symbol = self.last.symbols(at)
            at = self.first[symbol] + self.last.rank(symbol, at)
        return out
