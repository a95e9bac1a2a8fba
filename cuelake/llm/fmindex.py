"""An FM-index over word sequences: suffix array by prefix doubling, wavelet matrix over its last column.

The last column is held as packed bits, one level a bit of the words' numbers, with a count of ones before every 64
bits. Backward search narrows an interval of the sorted suffixes a word at a time; many sequences take each step
together as arrays.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence of numbers, from packed bits."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.symbols = int(symbols.max(initial=0)) + 1
        self.levels = max(1, (self.symbols - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
            padded[: self.size] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(self.size - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        self.base = self._walk(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = place >> 6
            below = self.bits[k][word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ones[k][word] + np.bitwise_count(below)
            place = np.where((symbol >> level) & 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._walk(symbol, place) - self.base[symbol]


def suffixes(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of all suffixes, class of each suffix by its first ``length`` keys).

    length: a power of two. The last key and every sequence's end must be keys that occur once.
    """
    n = len(keys)
    rank = np.unique(keys, return_inverse=True)[1].reshape(-1)
    covered, classes = 1, rank if length == 1 else None
    while True:
        follow = np.zeros(n, np.int64)
        follow[:-covered or None] = rank[covered:] + 1 if covered < n else 0
        key = rank * np.int64(n + 1) + follow
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        covered *= 2
        if covered == length:
            classes = rank
        if rank[order[-1]] == n - 1:
            return order, rank if classes is None else classes


class FMIndex:
    """Index of sequences of numbers from 1 with a weight each: in how many places the sequence stands.

    ``window``: the length of match that counts; intervals of that many words or more are widened to it.
    """

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, window: int):
        ends = len(sequences)
        self.window = window
        self.starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])[:-1]
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.text = np.zeros(int(self.lengths.sum()) + ends, np.int64)
        owner = np.repeat(np.arange(ends), self.lengths + 1)
        stops = self.starts + self.lengths
        inner = np.ones(len(self.text), bool)
        inner[stops] = False
        self.text[inner] = np.concatenate(sequences)
        keys = np.where(inner, self.text + ends, owner)  # an end differs from all others and from all words
        power = 1 << (window.bit_length() - 1)
        order, classes = suffixes(keys, power)
        last = self.text[order - 1]
        self.wavelet = WaveletMatrix(last)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(self.text))))
        self.weight = np.concatenate(([0], np.cumsum(weights[owner[order]])))
        # runs of suffixes that agree in their first ``window`` words
        far = classes[np.minimum(order + window - power, len(order) - 1)]
        near = classes[order]
        fresh = np.concatenate(([True], (near[1:] != near[:-1]) | (far[1:] != far[:-1])))
        self.run = np.cumsum(fresh) - 1
        self.first = np.append(np.flatnonzero(fresh), len(order))

    def backward(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol and go on as before."""
        start = self.before[symbol]
        return start + self.wavelet.rank(symbol, low), start + self.wavelet.rank(symbol, high)

    def repeated(self, least: int = 2) -> list[np.ndarray]:
        """For each sequence the starts of its windows that stand in ``least`` places or more.

        The sequences are streamed from their ends, all of them a word a step. After ``window`` words the interval is
        that of one window; a further word makes it a word longer, and widening to the run of equal windows takes the
        last word off again.
        """
        by_length = np.argsort(-self.lengths, kind="stable")
        lengths, starts = self.lengths[by_length], self.starts[by_length]
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.text), np.int64)
        found = np.zeros(len(self.text), bool)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-lengths, -step, side="right"))
            at = starts[:active] + lengths[:active] - step
            low, high = self.backward(low[:active], high[:active], self.text[at])
            if step >= self.window:
                run = self.run[low]
                low, high = self.first[run], self.first[run + 1]
                found[at] = self.weight[high] - self.weight[low] >= least
        return [np.flatnonzero(found[s : s + n]) for s, n in zip(self.starts, self.lengths, strict=True)]
