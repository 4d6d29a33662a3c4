"""Periodic runs of words by maximal pairs.

A run of period q and length L is a maximal pair: the places s and s + q, followed by the same L - q words and no more, and
preceded by different words. So runs need no extension: they are the maximal pairs whose distance q meets the length
constraints.

Suffixes of all documents of a batch are sorted by doubling; a suffix leaves the work as soon as it is unique in its document.
Those that share enough words for the shortest run keep their neighbours' common prefixes (LCP). The tree of LCP
intervals is walked bottom-up. A subtree has its places as a sorted list and as lists by left word; when subtrees meet in a node, the
places of the smaller look for places of other classes of the larger inside the distances that the node's LCP allows.
Stretches of the own class are skipped by galloping through its list, so that work follows the pairs that are found.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_slices

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Subtree:
    """The places below a node of the LCP-interval tree, in order and by left word."""

    __slots__ = ("order", "classes")

    def __init__(self, place: int, left: int):
        self.order, self.classes = [place], {left: [place]}

    def absorb(self, other: Subtree) -> None:
        _merge(self.order, other.order)
        for left, places in other.classes.items():
            mine = self.classes.get(left)
            if mine is None:
                self.classes[left] = places
            else:
                _merge(mine, places)


def _merge(large: list[int], small: list[int]) -> None:
    if 16 * len(small) < len(large):
        for x in small:
            insort(large, x)
    elif large[-1] < small[0]:
        large += small
    else:
        large += small
        large.sort()  # two ascending stretches: linear


def _same_stretch(order: list[int], at: int, own: list[int], place: int, step: int) -> int:
    """How many places from order[at] on, in the direction of `step`, are all of the class list `own`."""
    begin = bisect_left(own, place)
    most = min(len(own) - begin, len(order) - at) if step > 0 else min(begin, at) + 1
    size = 1  # order[at] itself
    while size < most and order[at + step * min(2 * size, most) - step] == own[begin + step * min(2 * size, most) - step]:
        size = min(2 * size, most)
    high = min(2 * size, most)
    while size < high:
        middle = (size + high + 1) // 2
        if order[at + step * (middle - 1)] == own[begin + step * (middle - 1)]:
            size = middle
        else:
            high = middle - 1
    return size


class Pairs:
    """Maximal pairs of one batch whose distances meet the constraints, as (start, length, period)."""

    def __init__(self, left: list[int], shortest: int, repeats: int):
        self.left, self.shortest, self.repeats = left, shortest, repeats
        self.found: list[tuple[int, int, int]] = []

    def join(self, a: Subtree, b: Subtree, common: int) -> Subtree:
        """Both subtrees as one, after looking for the pairs between them; `common`: words that all their places share."""
        large, small = (a, b) if len(a.order) >= len(b.order) else (b, a)
        least, most = max(1, self.shortest - common), common // (self.repeats - 1)
        if least <= most:
            for left, places in small.classes.items():
                own = large.classes.get(left, ())
                for place in places:
                    self._around(place, large.order, own, least, most, common)
        large.absorb(small)
        return large

    def _around(self, place: int, order: list[int], own: list[int], least: int, most: int, common: int) -> None:
        at = bisect_right(order, place)
        left = self.left[place]
        k = at
        while k < len(order) and order[k] - place <= most:
            if self.left[order[k]] == left:
                k += _same_stretch(order, k, own, order[k], 1)
            else:
                if order[k] - place >= least:
                    self.found.append((place, order[k] - place + common, order[k] - place))
                k += 1
        k = at - 1
        while k >= 0 and place - order[k] <= most:
            if self.left[order[k]] == left:
                k -= _same_stretch(order, k, own, order[k], -1)
            else:
                if place - order[k] >= least:
                    self.found.append((order[k], place - order[k] + common, place - order[k]))
                k -= 1

    def walk(self, places: list[int], common: list[int]) -> None:
        """Bottom-up through the intervals of sorted suffixes; common[k]: what places k and k + 1 share, 0 after the last."""
        stack: list[tuple[int, Subtree]] = []
        for place, shared in zip(places, common, strict=True):
            tree = Subtree(place, self.left[place])
            while stack and stack[-1][0] > shared:
                depth, node = stack.pop()
                tree = self.join(node, tree, depth)
            if shared and stack and stack[-1][0] == shared:
                stack[-1] = (shared, self.join(stack[-1][1], tree, shared))
            elif shared:
                stack.append((shared, tree))


def _groups(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ranks: where each group begins, and each element's group."""
    new = np.append(True, ranks[1:] != ranks[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def sorted_repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, group) of suffixes that share `base` words, a power of two, with another of their document; in suffix order.

    words: numbers of words; doc: the document of each; ends: the end of each word's document.
    """
    n = len(words)
    key = doc * (int(words.max(initial=0)) + 1) + words
    active = np.argsort(key)
    first, group = _groups(key[active])
    rank = np.empty(n, np.int64)
    rank[active] = first[group]
    size = np.diff(np.append(first, n))
    active = active[size[group] > 1]
    shared, home = 1, None
    while len(active):
        if shared == base:
            deep, home = active, rank[active]
        after = active + shared
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)], -1)
        key = rank[active] * (n + 1) + second + 1
        order = np.argsort(key)
        active, key = active[order], key[order]
        first, group = _groups(key)
        old_first, old_group = _groups(rank[active])
        start = rank[active][first] + first - old_first[old_group[first]]
        rank[active] = start[group]
        size = np.diff(np.append(first, len(active)))
        active = active[size[group] > 1]
        shared *= 2
    if home is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(rank[deep])
    return deep[order], home[order]


def common_prefixes(places: np.ndarray, group: np.ndarray, words: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """What each place shares with the next in suffix order, 0 at the end of a group; at least `base` else.

    From one place of the text to the next a prefix loses one word at most, so each word is compared once or twice.
    """
    common = np.zeros(len(places), np.int64)
    paired = np.flatnonzero(group[1:] == group[:-1])
    text_order = paired[np.argsort(places[paired + 1])]
    held, last, size = words.tolist(), -2, 0
    for k, here, there, end in zip(
        text_order.tolist(), places[text_order + 1].tolist(), places[text_order].tolist(), ends[places[text_order]].tolist(), strict=True
    ):
        size = max(base, size - 1) if here == last + 1 else base
        most = end - max(here, there)
        while size < most and held[here + size] == held[there + size]:
            size += 1
        common[k], last = size, here
    return common


def runs(words: np.ndarray, sizes: np.ndarray, shortest: int = 24, repeats: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs in documents of `sizes` words that stand one after another in `words`.

    A run has at least `shortest` words and `repeats` (2 or more) periods. Rows are sorted by start and period.
    """
    least = -(-shortest * (repeats - 1) // repeats)  # of L - q with L >= shortest and L >= repeats q
    base = 1 << (max(1, least).bit_length() - 1)
    nothing = np.empty((0, 3), np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not len(doc):
        return nothing
    ends = np.cumsum(sizes)[doc]
    places, group = sorted_repeats(words, doc, ends, base)
    if not len(places):
        return nothing
    common = common_prefixes(places, group, words, ends, base)
    # Groups whose places are all too far apart for what they share have no run.
    first, number = _groups(group)
    in_text = np.lexsort((places, number))
    gap = np.append(np.diff(places[in_text]), 0)
    gap[np.append(first[1:], len(gap)) - 1] = np.iinfo(np.int64).max
    near = np.minimum.reduceat(gap, first) <= np.maximum.reduceat(common, first) // (repeats - 1)
    left = np.append(-1, words[:-1])
    left[ends - sizes[doc] == np.arange(len(words))] = -1
    pairs = Pairs(left.tolist(), shortest, repeats)
    bounds = np.append(first, len(places)).tolist()
    for k in np.flatnonzero(near).tolist():
        part = slice(bounds[k], bounds[k + 1])
        pairs.walk(places[part].tolist(), common[part].tolist())
    if not pairs.found:
        return nothing
    found = np.array(pairs.found, np.int64)
    # Multiples of a period give the same stretch; the smallest is its period.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(axis=1)
    found = found[np.append(True, ~same)]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _measured(texts: list[str], shortest: int, repeats: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """Of each text: how many words it has, its runs, and the words that stay, joined by spaces."""
    numbers, split = _Numbers(), [t.encode().split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    words = np.fromiter((numbers[w] for s in split for w in s), np.int64, int(sizes.sum()))
    found = runs(words, sizes, shortest, repeats)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(change[:-1]) == 0
    starts = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(found[:, 0], np.append(starts, len(words)))
    of_text, kept = [], []
    for k, (part, begin) in enumerate(zip(split, starts.tolist(), strict=True)):
        mine = found[bounds[k] : bounds[k + 1]]
        of_text.append([{"start": s - begin, "length": n, "period": q} for s, n, q in mine.tolist()])
        if len(mine):
            part = [w for w, stay in zip(part, stays[begin : begin + len(part)].tolist(), strict=True) if stay]
        kept.append(b" ".join(part))
    return sizes.tolist(), of_text, kept


def periodic_runs(
    docs: DataFrame, shortest: int = 24, repeats: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period), collapsed.

    Words are what stands between the white space characters of ASCII, numbered from 0. A run is a stretch of at least
    `shortest` words and `repeats` times its smallest period, in which words one period apart are equal and which cannot
    be extended; runs are sorted by start, then period. `collapsed` has the words that no run contains after its first
    period, joined by one space. Null and empty texts have no words and no runs, and `collapsed` is empty. Null ids and repeated rows
    are documents like others. Other columns are not read. An empty table gives no rows. A text is worked on as a whole, in memory of
    about 200 bytes a word, and time of about n log n.
    """
    if repeats < 2 or shortest < 2:
        raise ValueError("runs have at least two words and two periods")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sizes, found, kept = _measured(texts, shortest, repeats)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0),
                    "n_words": pa.array(sizes, pa.int64()),
                    "runs": pa.array(found, kind),
                    "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def longest(runs: str = "runs"):
    """The run of the greatest length / period, compared exactly; of equal ones the first. Null if there is none."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, x: F.when(better(best, x), x).otherwise(best))
