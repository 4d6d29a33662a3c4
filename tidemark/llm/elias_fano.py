"""Elias-Fano sequences and the n-gram trie made of them, in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

#: Steps of a factor of ten in quantised probabilities.
QUANTUM = 4096
#: The codes of 0 and 1.
NOTHING, ALL = 65_535, 0


_POWERS = np.append(10.0 ** (-np.arange(65_535) / QUANTUM), 0.0)


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit fixed-point logarithms."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.rint(-QUANTUM * np.log10(p)), 65_535).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return _POWERS[q]


class EliasFano:
    """A strictly or weakly growing sequence of n integers below `universe` in about 2 + log2(universe / n) bits each.

    The low bits stand packed in 64-bit words. The high bits are a bit vector in which element i with the high part h sets
    bit h + i, so that each zero closes a bucket of elements of one high part.
    """

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.int64)
        self.n, self.universe = len(values), max(1, universe)
        self.width = max(0, int(max(1, universe) // max(1, self.n)).bit_length() - 1)
        low = values & ((1 << self.width) - 1)
        high = values >> self.width
        words = np.zeros(self.n * self.width // 64 + 2, np.uint64)
        place = np.arange(self.n, dtype=np.int64) * self.width
        at, offset = place >> 6, (place & 63).astype(np.uint64)
        np.bitwise_or.at(words, at, low.astype(np.uint64) << offset)
        over = np.flatnonzero((offset.astype(np.int64) + self.width > 64) & (self.width > 0))
        np.bitwise_or.at(words, at[over] + 1, low[over].astype(np.uint64) >> (np.uint64(64) - offset[over]))
        buckets = (int(max(0, universe - 1)) >> self.width) + 1
        bits = np.zeros(-(-(self.n + buckets + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.low = words
        self.high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = 64 - np.bitwise_count(self.high).astype(np.int64)
        self.zeros = np.append(0, np.cumsum(zeros))  # zeros before each word

    def arrays(self) -> list[str]:
        return ["low", "high", "zeros"]

    def _low(self, i: np.ndarray) -> np.ndarray:
        place = i * self.width
        at, offset = place >> 6, (place & 63).astype(np.uint64)
        value = self.low[at] >> offset
        value |= np.where(offset > 0, self.low[at + 1] << ((np.uint64(64) - offset) & np.uint64(63)), np.uint64(0))
        return (value & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """Number of elements with a smaller high part: where the zero before the bucket stands."""
        k = high - 1
        safe = np.maximum(k, 0)
        word = np.searchsorted(self.zeros, safe, "right") - 1
        bits, left = ~self.high[word], safe - self.zeros[word]
        at = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            skip = left >= part
            left = np.where(skip, left - part, left)
            at = np.where(skip, at + step, at)
            bits = np.where(skip, bits >> np.uint64(step), bits)
        return np.where(k < 0, 0, word * 64 + at - safe)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by position, found by bisection over the buckets' starts."""
        first, last = np.zeros(len(i), np.int64), np.full(len(i), len(self.high) * 64 - self.n - 1, np.int64)
        while (first < last).any():
            middle = (first + last + 1) // 2
            ok = self._bucket(middle) <= i
            first, last = np.where(ok, middle, first), np.where(ok, last, middle - 1)
        return first << self.width | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where it is absent: successor search inside the bucket of its high part."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        inside = values < self.universe
        values = np.where(inside, values, 0)
        high, low = values >> self.width, values & ((1 << self.width) - 1)
        lo, end = self._bucket(high), self._bucket(high + 1)
        hi, open_ = end.copy(), np.flatnonzero(lo < end)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < low[open_]
            lo[open_[less]], hi[open_[~less]] = middle[less] + 1, middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        there = inside & (lo < end) & (self._low(np.minimum(lo, self.n - 1)) == low)
        return np.where(there, lo, -1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and each key's place among them."""
    order = np.argsort(keys)
    held = keys[order]
    new = np.append(True, held[1:] != held[:-1])[: len(held)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return held[new], place


class Trie:
    """Trigram trie: context words, their successors, wider contexts, and successors again.

    Levels: contexts x; pairs (x, w); wider contexts (x, u), where u comes before x; and triples ((x, u), w), in which w is
    written as its rank among the successors of x. Ranks are small, so the last level needs few bits. Each level's
    key is its parent's position times the width of the parent's range, which keeps the whole level growing; the pointers from
    contexts to their first successors are a growing sequence, too. Probabilities are those of absolute discounting with given
    discounts, quantised to 16 bits, and every level's array stands in one anonymous memory map.
    """

    def __init__(self, x: np.ndarray, u: np.ndarray, w: np.ndarray, words: int, discounts: tuple[float, float]):
        """x, u, w: one entry per trigram occurrence; words: all of u and w are below it."""
        self.words = words
        pairs, p = distinct(x * words + w)
        owner = pairs // words
        new = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
        contexts, rank_of_owner = owner[new], np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(pairs))
        i = rank_of_owner[p]
        pairs = rank_of_owner * words + pairs % words
        wide, j = distinct(i * words + u)
        self.ranks = int(np.diff(first).max(initial=0)) + 1
        triples, q = distinct(j * self.ranks + (p - first[i]))
        count_x, count_p = np.bincount(i, minlength=len(contexts)), np.bincount(p, minlength=len(pairs))
        count_j, count_q = np.bincount(j, minlength=len(wide)), np.bincount(q, minlength=len(triples))
        self.contexts = EliasFano(contexts, int(contexts[-1]) + 1 if len(contexts) else 1)
        self.first = EliasFano(first, len(pairs) + 1)
        self.pairs = EliasFano(pairs, max(1, len(contexts)) * words)
        self.wide = EliasFano(wide, max(1, len(contexts)) * words)
        self.triples = EliasFano(triples, max(1, len(wide)) * self.ranks)
        self.pair_p, self.pair_rest = self._discount(count_p, rank_of_owner, count_x, discounts[0])
        self.triple_p, self.triple_rest = self._discount(count_q, triples // self.ranks, count_j, discounts[1])
        self._map()
        #: Where the occurrences that the trie is made of stand in its levels: what `locate` finds for them.
        self.own = i, p, j, q

    @staticmethod
    def _discount(counts: np.ndarray, owner: np.ndarray, totals: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Quantised discounted probabilities, and what each context leaves to the lower order."""
        kinds = np.bincount(owner, minlength=len(totals))
        return discounted(counts, totals[owner], discount), left_over(kinds, totals, discount)

    def _map(self) -> None:
        """Move all arrays into one anonymous memory map."""
        parts = [(self, k) for k in ("pair_p", "pair_rest", "triple_p", "triple_rest")]
        parts += [(s, k) for s in (self.contexts, self.first, self.pairs, self.wide, self.triples) for k in s.arrays()]
        sizes = [-(-getattr(o, k).nbytes // 8) * 8 for o, k in parts]
        self.memory, at = mmap.mmap(-1, max(8, sum(sizes))), 0
        for (owner, key), size in zip(parts, sizes, strict=True):
            array = getattr(owner, key)
            held = np.frombuffer(self.memory, array.dtype, array.size, at)
            held[:] = array
            setattr(owner, key, held)
            at += size

    def locate(self, x: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of contexts, pairs, wider contexts and triples, -1 where one is absent: successor searches relative to the context."""
        contexts, i = distinct(x)
        at = self.contexts.find(contexts)
        start = np.where(at >= 0, self.first.get(np.maximum(at, 0)), 0)[i] if len(at) else np.zeros(0, np.int64)
        at = at[i]
        pair = np.where(at >= 0, self.pairs.find(np.maximum(at, 0) * self.words + w), -1)
        wide = np.where(at >= 0, self.wide.find(np.maximum(at, 0) * self.words + u), -1)
        asked = np.flatnonzero((wide >= 0) & (pair >= 0))
        triple = np.full(len(x), -1, np.int64)
        triple[asked] = self.triples.find(wide[asked] * self.ranks + pair[asked] - start[asked])
        return at, pair, wide, triple

    def codes(self, at: np.ndarray, pair: np.ndarray, wide: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, ...]:
        """Quantised: P(w | x) and P(w | u, x) as far as they are seen, each followed by the share left to the lower order."""
        return (
            np.where(pair >= 0, _take(self.pair_p, pair), NOTHING),
            np.where(at >= 0, _take(self.pair_rest, at), ALL),
            np.where(triple >= 0, _take(self.triple_p, triple), NOTHING),
            np.where(wide >= 0, _take(self.triple_rest, wide), ALL),
        )


def discounted(counts: np.ndarray, totals: np.ndarray, discount: float) -> np.ndarray:
    """Quantised (count - discount) / total; nothing where the count is 0."""
    return quantise(np.maximum(counts - discount, 0) / np.maximum(totals, 1))


def left_over(kinds: np.ndarray, totals: np.ndarray, discount: float) -> np.ndarray:
    """Quantised share that the discounts leave to the lower order: all of it where nothing was seen."""
    return np.where(totals > 0, quantise(discount * kinds / np.maximum(totals, 1)), ALL).astype(np.uint16)


def blend(lower: np.ndarray, pair: np.ndarray, pair_rest: np.ndarray, triple: np.ndarray, triple_rest: np.ndarray) -> np.ndarray:
    """P(w | u, x) from codes, interpolated with `lower`, the probability of w alone."""
    return restore(triple) + restore(triple_rest) * (restore(pair) + restore(pair_rest) * lower)


def _take(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    return array[np.maximum(at, 0)] if len(array) else np.zeros(len(at), array.dtype)
