"""A compressed FM-index over word symbols: packed wavelet matrix of the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``text`` holds dense non-negative symbols."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = fresh
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


#: Masks of the bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank of any symbol before any place, over bit planes of 64-bit words with running counts."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.planes = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        s = symbols
        for b in range(self.planes - 1, -1, -1):
            bit = (s >> b) & 1
            padded = np.zeros((len(s) // 64 + 1) * 64, np.uint8)
            padded[: len(s)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.begin = self._down(np.zeros(alphabet, np.int64), np.arange(alphabet))

    def _down(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(self.planes - 1, -1, -1)):
            word = place >> 6
            held = self.words[level].take(word, mode="wrap")
            held &= _BELOW.take(place & 63, mode="wrap")
            ones = self.counts[level].take(word, mode="wrap")
            ones += np.bitwise_count(held)
            place = place - ones
            ones += self.zeros[level]
            np.copyto(place, ones, where=(symbol >> b) & 1 == 1)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(place, symbol) - self.begin.take(symbol)


class FMIndex:
    """Backward search with weighted occurrences.

    ``text`` holds symbols from 1 upwards (0 is kept for the end); ``weights`` says how often the stretch
    of text around each place occurs in the corpus.
    """

    def __init__(self, text: np.ndarray, weights: np.ndarray):
        whole = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_order(whole)
        alphabet = int(whole.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=alphabet))])
        self.bwt = WaveletMatrix(whole[order - 1], alphabet)
        self.weight = np.concatenate([[0], np.cumsum(np.concatenate([weights, [0]])[order])])
        self.text = whole

    def matching_lengths(self, ends: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place of the text: the length, up to its ``most``, of the longest stretch that ends
        there and occurs ``least`` times."""
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        symbol = self.text[ends]
        low, high = self.before[symbol], self.before[symbol + 1]
        step = 0
        while len(live):
            often = self.weight[high] - self.weight[low] >= least
            live, low, high = live[often], low[often], high[often]
            step += 1
            length[live] = step
            more = most[live] > step
            live, low, high = live[more], low[more], high[more]
            if not len(live):
                break
            symbol = self.text[ends[live] - step]
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.before[symbol], 2)
            low, high = both[: len(live)], both[len(live) :]
        return length
