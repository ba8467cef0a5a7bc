"""An FM-index over the words of one shard: suffix order, wavelet ranks and sampled suffix positions, in numpy.

The text is a sequence of symbols in which 0 is a separator that no phrase contains. Separators count
as different symbols, ordered by place, so suffixes are compared up to their first separator only and
all of them are told apart.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the suffixes in order. text ends with 0; ties up to a separator go by place.

    The first round packs as many symbols as fit into a key; later rounds double the compared length by
    the ranks of the round before, over the suffixes that are not told apart yet.
    """
    n = len(text)
    bits = max(1, int(symbols).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, dtype=bool)  # no separator within the symbols packed so far
    padded = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    for k in range(depth):
        here = padded[k : k + n]
        key <<= bits
        key |= np.where(open_, here, 0)
        open_ &= here != 0
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, np.int64)
    sorted_key = key[order]
    same = np.zeros(n, dtype=bool)
    same[1:] = sorted_key[1:] == sorted_key[:-1]
    group = np.where(same, 0, np.arange(n))
    np.maximum.accumulate(group, out=group)
    undone = open_[order]
    ranks[order] = np.where(undone, group, np.arange(n))
    alone = ~same
    alone[:-1] &= ~same[1:]
    slots = np.flatnonzero(undone & ~alone)
    while len(slots):
        places = order[slots]
        pair = (ranks[places] << 32) | ranks[places + depth]
        by = np.argsort(pair, kind="stable")
        places, pair = places[by], pair[by]
        order[slots] = places
        same = np.zeros(len(slots), dtype=bool)
        same[1:] = pair[1:] == pair[:-1]
        group = np.where(same, 0, slots)
        np.maximum.accumulate(group, out=group)
        ranks[places] = group
        alone = ~same
        alone[:-1] &= ~same[1:]
        slots = slots[~alone]
        depth *= 2
    return order


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(ones), np.int64)
        np.cumsum(ones[:-1], out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks and symbols of a sequence, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        for shift in range(bits - 1, -1, -1):
            bit = ((values >> shift) & 1).astype(bool)
            self.levels.append(BitRank(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def descend(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i lands among the places of its symbol; the difference of two landings is a count."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(i)
            right = (symbols >> (self.bits - 1 - level)) & 1 == 1
            i = np.where(right, zeros + ones, i - ones)
        return i

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = bits.get(i).astype(np.int64), bits.rank(i)
            out = (out << 1) | bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int) -> None:
        """text: symbols below `symbols`, with 0 first and last as separators."""
        order = suffix_order(text, symbols)
        last = text[order - 1]
        self.size = len(text)
        self.matrix = WaveletMatrix(last.astype(np.int64), max(1, int(symbols - 1).bit_length()))
        counts = np.bincount(text, minlength=symbols)
        self.first = np.zeros(symbols, np.int64)
        np.cumsum(counts[:-1], out=self.first[1:])
        self.base = self.matrix.descend(np.arange(symbols), np.zeros(symbols, np.int64))
        sampled = (last == 0) | (order % SAMPLE == 0)  # a walk to a sample never crosses a separator
        self.sampled = BitRank(sampled)
        self.samples = order[sampled]

    def step(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where suffixes before row i, preceded by the symbol, begin in the order of suffixes."""
        return self.first[symbols] + self.matrix.descend(symbols, i) - self.base[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (a row of symbols), read from its end."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[alive, k]
            low[alive] = self.step(symbols, low[alive])
            high[alive] = self.step(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        empty = np.ones(len(phrases), dtype=bool)
        empty[alive] = False
        high[empty] = low[empty]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of the suffixes in these rows: back to a sampled one, counting the steps."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        walking, steps = np.arange(len(rows)), 0
        while len(walking):
            here = rows[walking]
            done = self.sampled.get(here) == 1
            out[walking[done]] = self.samples[self.sampled.rank(here[done])] + steps
            walking = walking[~done]
            here = here[~done]
            rows[walking] = self.step(self.matrix.symbol(here), here)
            steps += 1
        return out
