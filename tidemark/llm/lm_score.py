"""Language-model scores from an Elias-Fano trigram trie that is spread over the cluster by context.

1. Texts become blocks: token lists in block-local word numbers, and the block's words with their training counts, dealt
   into vocabulary shards.
2. Each vocabulary shard adds up the counts. Words get global numbers by falling count, so a word's count follows from
   its number by a step function with at most sqrt(2 N) steps for N tokens; that function is all that is sent around.
3. Blocks turn their tokens into trigrams (u, v, w) and deal them by the middle word v.
4. Each shard builds the trie of its training trigrams, looks up all of its trigrams, and sends sums per document back.

The model is that of the whole corpus, however it is dealt: absolute discounting of global counts with fixed discounts. A word v
of more than a shard's share of the tokens is *heavy* and not kept in one place. Its trigrams go to shards by (u, v) for the upper level and by (v, w)
for the lower one. If the pair (u, v) is heavy itself, its upper level is dealt by (u, v, w). Contexts that are dealt by w are
*split*: shards send back counts, and the block adds up their totals and numbers of kinds and blends both levels. All figures are
quantised before they are blended, and logarithms before they are added, so scores do not depend on shards at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, text_slices, written
from tidemark.llm.elias_fano import NOTHING, EliasFano, Trie, blend, discounted, distinct, left_over

#: The token that ends a text; no word can be a line break.
END = b"\n"
BLOCK_CHARS = 8_000_000
#: Shards are worked on one at a time, so that more of them per partition bound the memory of a task.
SHARDS_PER_PARTITION = 3
#: Shards' shares of the tokens from which on a word or pair is split.
HEAVY_SHARES = 2
#: Logarithms are added as whole numbers of this share of one, so that sums do not depend on their order.
GRAIN = 2**-20
#: What is taken off the counts of pairs and of triples: most of both are seen once.
DISCOUNTS = (0.75, 0.9)


def pack(array: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    kind = np.dtype("<u4") if not len(array) or int(array.max()) < 2**32 else np.dtype("<u8")
    planes = np.ascontiguousarray(array.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.int64)


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _blocks(rows: DataFrame, shards: int) -> DataFrame:
    """rows: doc_id, text, held_out. One row per block; its local word numbers are sorted by vocabulary shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for part, texts in text_slices(batches, limit=BLOCK_CHARS):
            numbers = _Numbers()
            tokens, sizes = [], []
            for text in texts:
                found = text.encode().lower().split()
                tokens.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                tokens.append(np.array([numbers[END]]))
                sizes.append(len(found) + 1)
            held = np.array(part.column(2).to_pylist(), bool)
            words, tokens, sizes = list(numbers), np.concatenate(tokens), np.array(sizes)
            counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
            shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            vocabulary = [
                {
                    "shard": s,
                    "words": zstandard.ZstdCompressor(level=1).compress(b" ".join(words[k] for k in order[a:b].tolist())),
                    "counts": pack(counts[order[a:b]]),
                }
                for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                if b > a
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()),
                    "docs": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([pack(held)], pa.binary()),
                    "sizes": pa.array([pack(sizes)], pa.binary()),
                    "tokens": pa.array([pack(place[tokens])], pa.binary()),
                    "train_docs": pa.array([int((~held).sum())], pa.int64()),
                    "train_tokens": pa.array([int(counts.sum())], pa.int64()),
                    "vocabulary": pa.array(
                        [vocabulary], pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
                    ),
                }
            )
            block += 1

    return rows.mapInArrow(
        run,
        "block long, docs array<long>, held binary, sizes binary, tokens binary, train_docs long, train_tokens long, "
        "vocabulary array<struct<shard:int,words:binary,counts:binary>>",
    )


HEAVY = "array<struct<word:binary,n:bigint,place:bigint>>"


def _count_words(share: float):
    """Per block of a vocabulary shard: each word's count and its place among words of that count.

    One more row, of the block null, has the distinct counts and how many words have each, and the words of more than `share` tokens.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        lists = [zstandard.ZstdDecompressor().decompress(w).split(b" ") for w in rows["words"]]
        for words, counts in zip(lists, rows["counts"], strict=True):
            for word, n in zip(words, unpack(counts).tolist(), strict=True):
                total[word] = total.get(word, 0) + n
        names = sorted(total)
        counts = np.array([total[w] for w in names])
        order = np.argsort(-counts, kind="stable")
        ranked = counts[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(-ranked, -ranked)
        index = {w: k for k, w in enumerate(names)}
        at = [np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for words in lists]
        values, sizes = np.unique(counts[counts > 0], return_counts=True)
        heavy = [{"word": names[k], "n": int(counts[k]), "place": int(place[k])} for k in np.flatnonzero(counts >= share).tolist()]
        return pd.DataFrame(
            {
                "shard": int(rows["shard"].iloc[0]),
                "block": pd.array([*rows["block"], None], "Int64"),
                "counts": [*(pack(counts[a]) for a in at), pack(values)],
                "places": [*(pack(place[a]) for a in at), pack(sizes)],
                "heavy": [*([] for _ in at), heavy],
            }
        )

    return run


def _split_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for shard, values, sizes in zip(frame["shard"], frame["counts"], frame["places"], strict=True):
            yield pd.DataFrame({"shard": shard, "n": unpack(values), "words": unpack(sizes)})


def _pack_bases(rows: pd.DataFrame) -> pd.DataFrame:
    """The first number of each count in one vocabulary shard."""
    rows = rows.sort_values("n")
    packed = [pack(rows[c].to_numpy()) for c in ("n", "base")]
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "ns": packed[:1], "bases": packed[1:]})


def _number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Global word numbers + 1 of a block's words in one vocabulary shard; 0 for words without training counts."""
    for frame in frames:
        out = []
        for counts, places, values, bases in zip(*(frame[c] for c in ("counts", "places", "ns", "bases")), strict=True):
            n = unpack(counts)
            known = n > 0
            numbers = np.zeros(len(n), np.int64)
            if known.any():
                base = unpack(bases)[np.searchsorted(unpack(values), n[known])]
                numbers[known] = base + unpack(places)[known] + 1
            out.append(pack(numbers))
        yield pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "numbers": out})


class Steps:
    """Counts by word number. Numbers: 0 .. V - 1 known words by falling count, V unknown, V + 1 the start of a text."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, train_docs: int, shards: int):
        self.counts, self.first = counts, np.append(0, np.cumsum(words))
        self.total, self.kinds = int((counts * words).sum()), int(words.sum())
        self.unknown, self.start = self.kinds, self.kinds + 1
        self.words = self.start + 1
        self.train_docs, self.shards = train_docs, shards
        self.heavy_pairs, self.heavy_counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def set_heavy_pairs(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: u * words + v of pairs above a shard's share, at most one per shard."""
        order = np.argsort(keys)
        self.heavy_pairs, self.heavy_counts = keys[order], counts[order]

    def parts(self, numbers: np.ndarray) -> np.ndarray:
        """Among how many shards a word's trigrams are split; 1 for words of at most a shard's share of the tokens."""
        return 1 + self.count(numbers) * self.shards // (HEAVY_SHARES * (self.total + 1))

    def pair_parts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.heavy_pairs):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.heavy_pairs, keys), len(self.heavy_pairs) - 1)
        return np.where(self.heavy_pairs[at] == keys, 1 + self.heavy_counts[at] * self.shards // (HEAVY_SHARES * (self.total + 1)), 1)

    def count(self, numbers: np.ndarray) -> np.ndarray:
        table = np.append(self.counts, [0, self.train_docs])
        at = np.searchsorted(self.first[1:], numbers, "right")
        return table[at + (numbers == self.start)]

    def unigram(self, numbers: np.ndarray) -> np.ndarray:
        return (self.count(numbers) + 1) / (self.total + self.kinds + 1)


def _mixed(*numbers: np.ndarray) -> np.ndarray:
    """A hash of rows of numbers, the same everywhere."""
    out = np.zeros(len(numbers[0]), np.uint64)
    for n in numbers:
        out = (out ^ n.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out >> np.uint64(1)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, begin, end) of the stretches of ascending shard numbers."""
    bounds = np.searchsorted(shard, np.arange(shards + 1)).tolist()
    return ((s, a, b) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a)


class Split:
    """How a block's trigrams of split contexts are asked for, and what comes back.

    code: the context of each; a context is asked for in all of its parts, whether the block has successors there or not, because their
    totals add up to the context's.
    """

    def __init__(self, code: np.ndarray, w: np.ndarray, parts: np.ndarray, shards: int):
        self.codes, at = distinct(code)
        many = np.ones(len(self.codes), np.int64)
        many[at] = parts
        begin = np.cumsum(many) - many
        self.context = np.repeat(np.arange(len(self.codes)), many)
        self.part = np.arange(len(self.context)) - np.repeat(begin, many)
        shard = (_mixed(self.codes[self.context], self.part) % np.uint64(shards)).astype(np.int64)
        self.entries = np.argsort(shard, kind="stable")  # contexts' parts by shard
        place = np.empty(len(shard), np.int64)
        place[self.entries] = np.arange(len(shard))
        self.at = at
        entry = place[begin[at] + (_mixed(w) % many[at].astype(np.uint64)).astype(np.int64)]
        self.order = np.argsort(entry, kind="stable")  # trigrams by shard
        self.entry, self.shard = entry[self.order], shard[self.entries]
        self.shards = shards

    def requests(self, w: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, bytes]]:
        w, held = w[self.order], held[self.order]
        for s, a, b in _by_shard(self.shard, self.shards):
            rows = slice(*np.searchsorted(self.entry, [a, b]))
            asked = self.entries[a:b]
            parts = (self.codes[self.context[asked]], self.part[asked], self.entry[rows] - a, w[rows], held[rows])
            yield s, _join(*map(pack, parts))

    def answers(self, found: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each trigram its count, and its context's total and number of kinds; found: (counts, totals, kinds) by shard."""
        counts = np.zeros(len(self.order), np.int64)
        sums = np.zeros((2, len(self.codes)), np.int64)
        for s, a, b in _by_shard(self.shard, self.shards):
            rows = slice(*np.searchsorted(self.entry, [a, b]))
            counts[self.order[rows]] = found[s][0]
            for k in (0, 1):
                np.add.at(sums[k], self.context[self.entries[a:b]], found[s][1 + k])
        return counts, sums[0][self.at], sums[1][self.at]


class Heavy:
    """A block's trigrams of heavy middle words: the lower level is split, the upper one split or dealt by (u, v)."""

    def __init__(self, steps: Steps, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        key = u * steps.words + v
        parts = steps.pair_parts(key)
        self.split = parts > 1
        # One numbering for both levels: middle words are below `words`, pairs are not.
        code = np.append(v, steps.words + key[self.split])
        self.asked = Split(code, np.append(w, w[self.split]), np.append(steps.parts(v), parts[self.split]), steps.shards)
        self.wide = np.flatnonzero(~self.split)
        shard = (_mixed(key[self.wide]) % np.uint64(steps.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.wide, self.wide_shard = self.wide[order], shard[order]


def _deal(steps: Steps):
    """Trigrams of a block, dealt by context, and a row of negative shard for what its documents have of their own."""

    def run(block: pd.DataFrame, vocabulary: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        parts = [unpack(n) for n in vocabulary.sort_values("shard")["numbers"]]
        numbers = np.concatenate(parts) - 1
        numbers[numbers < 0] = steps.unknown
        sizes, held = unpack(row["sizes"]), unpack(row["held"])
        logs, known = np.log10(steps.unigram(numbers)), numbers != steps.unknown
        tokens = unpack(row["tokens"])
        begin = np.cumsum(sizes) - sizes
        base, n_known = np.add.reduceat(logs[tokens], begin), np.add.reduceat(known[tokens].astype(np.int64), begin)
        w = numbers[tokens]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        v, u = np.append(steps.start, w[:-1]), np.append([steps.start] * 2, w[:-2])[: len(w)]
        v[begin] = steps.start
        u[begin] = steps.start
        second = begin[sizes > 1] + 1
        u[second] = steps.start
        heavy = steps.parts(v) > 1
        hu, hv, hw, hdoc = u[heavy], v[heavy], w[heavy], doc[heavy]
        own = _join(_floats(base), pack(n_known), row["held"], row["sizes"], pack(hu), pack(hv), pack(hw), pack(hdoc))
        out = [(-1 - int(row["block"]) % steps.shards, "own", own)]
        if len(hu):
            dealt = Heavy(steps, hu, hv, hw)
            both, hheld = np.append(hw, hw[dealt.split]), held[hdoc]
            out += [(s, "split", p) for s, p in dealt.asked.requests(both, np.append(hheld, hheld[dealt.split]))]
            for s, a, b in _by_shard(dealt.wide_shard, steps.shards):
                at = dealt.wide[a:b]
                out.append((s, "wide", _join(*(pack(x[at]) for x in (hu, hv, hw, hheld)))))
        u, v, w, doc = u[~heavy], v[~heavy], w[~heavy], doc[~heavy]
        shard = (_mixed(v) % np.uint64(steps.shards)).astype(np.int64)
        order = np.argsort((shard << 40) | v, kind="stable")
        u, v, w, doc, shard = u[order], v[order], w[order], (doc * 2 + held[doc])[order], shard[order]
        for s, a, b in _by_shard(shard, steps.shards):
            out.append((s, "light", _join(pack(u[a:b]), pack(np.diff(v[a:b], prepend=0)), pack(w[a:b]), pack(_steps_of(v[a:b], doc[a:b])))))
        return pd.DataFrame(
            {"shard": [s for s, _, _ in out], "block": row["block"], "kind": [k for _, k, _ in out], "payload": [p for _, _, p in out]}
        )

    return run


def _steps_of(v: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Documents by their distance to the one before of the same v, which is not larger; the first of each v as it is."""
    same = np.append(False, v[1:] == v[:-1])
    return np.where(same, doc - np.append(0, doc[:-1]), doc)


def _from_steps(v: np.ndarray, steps: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(v))))


def _costs(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities in whole GRAINs."""
    return np.rint(-np.log10(p) / GRAIN)


def _floats(array: np.ndarray) -> bytes:
    return array.astype("<f8").tobytes()


def _join(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _cut(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    sizes = np.frombuffer(data, "<u4", n, 4).astype(int)
    ends = 4 + 4 * n + np.cumsum(sizes)
    return [data[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _columns(payloads: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all payloads one after another, and the rows of each payload by its last column."""
    parts = [[unpack(p) for p in _cut(x)] for x in payloads]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))], np.array([len(p[-1]) for p in parts])


def _looked_up(words: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """The codes of all trigrams from the trie of the training ones.

    Trigrams that the trie is made of are read at the places that they were given in its levels; the others are searched for.
    """
    trie = Trie(v[train], u[train], w[train], words, DISCOUNTS)
    found = [np.empty(len(v), np.int64) for _ in range(4)]
    for places, own, other in zip(found, trie.own, trie.locate(v[~train], u[~train], w[~train]), strict=True):
        places[train], places[~train] = own, other
    return trie.codes(*found)


def _score_light(steps: Steps, payloads: pd.Series) -> list[bytes]:
    """Sums of costs per document of each payload."""
    parts = [[unpack(p) for p in _cut(x)] for x in payloads]
    u, w = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
    middle = [np.cumsum(p[1]) for p in parts]
    doc = np.concatenate([_from_steps(v, p[3]) for v, p in zip(middle, parts, strict=True)])
    v, sizes = np.concatenate(middle), [len(p[0]) for p in parts]
    del parts, middle
    costs = _costs(blend(steps.unigram(w), *_looked_up(steps.words, u, v, w, doc % 2 == 0)))
    out, begin = [], 0
    for size in sizes:
        docs, at = distinct(doc[begin : begin + size] // 2)
        sums = np.bincount(at, costs[begin : begin + size]).astype(np.int64)  # exact: whole numbers below 2^53
        out.append(_join(pack(np.diff(docs, prepend=0)), pack(sums)))
        begin += size
    return out


def _score_wide(steps: Steps, payloads: pd.Series) -> list[bytes]:
    """The upper level's codes of each trigram."""
    (u, v, w, held), sizes = _columns(payloads)
    _, _, triple, rest = _looked_up(steps.words, u, v, w, held == 0)
    ends = np.cumsum(sizes)
    return [_join(pack(triple[e - s : e]), pack(rest[e - s : e])) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _score_split(steps: Steps, payloads: pd.Series) -> list[bytes]:
    """Counts of each trigram in its context's part, and each part's total and number of kinds."""
    parts = [[unpack(p) for p in _cut(x)] for x in payloads]
    code, part = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    codes, at = distinct(code)
    entries, at = distinct(at * (int(part.max()) + 1) + part)
    begin = np.cumsum([0, *(len(p[0]) for p in parts)])
    context = np.concatenate([at[b + p[2]] for b, p in zip(begin, parts, strict=False)])
    w, held = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
    key, train = context * steps.words + w, held == 0
    pairs, own = distinct(key[train])
    seen, place = np.bincount(own, minlength=len(pairs)), np.empty(len(key), np.int64)
    place[train] = own
    place[~train] = EliasFano(pairs, len(entries) * steps.words).find(key[~train])
    counts = np.where(place >= 0, seen[np.maximum(place, 0)], 0) if len(pairs) else np.zeros(len(key), np.int64)
    totals = np.bincount(pairs // steps.words, seen, len(entries)).astype(np.int64)
    kinds = np.bincount(pairs // steps.words, minlength=len(entries))
    out, row = [], 0
    for b, p in zip(begin, parts, strict=False):
        asked = at[b : b + len(p[0])]
        out.append(_join(pack(counts[row : row + len(p[2])]), pack(totals[asked]), pack(kinds[asked])))
        row += len(p[2])
    return out


def _score(steps: Steps):
    """What a shard answers to the payloads of each kind; rows of a block's own pass through."""
    scorers = {"light": _score_light, "wide": _score_wide, "split": _score_split}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["shard"].iloc[0] >= 0:
            rows = rows.assign(payload=rows["payload"].astype(object))
            for kind, part in rows.groupby("kind"):
                rows.loc[part.index, "payload"] = pd.Series(scorers[kind](steps, part["payload"]), index=part.index, dtype=object)
        return rows[["block", "shard", "kind", "payload"]]

    return run


def _heavy_costs(steps: Steps, answers: pd.DataFrame, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Costs of a block's trigrams of heavy words from the shards' answers."""
    dealt = Heavy(steps, u, v, w)
    of = {kind: dict(zip(part["shard"], part["payload"], strict=True)) for kind, part in answers.groupby("kind")}
    counts, totals, kinds = dealt.asked.answers({s: [unpack(x) for x in _cut(p)] for s, p in of["split"].items()})
    n = len(v)
    pair, pair_rest = discounted(counts[:n], totals[:n], DISCOUNTS[0]), left_over(kinds[:n], totals[:n], DISCOUNTS[0])
    triple, rest = np.full(n, NOTHING), np.zeros(n, np.int64)
    triple[dealt.split] = discounted(counts[n:], totals[n:], DISCOUNTS[1])
    rest[dealt.split] = left_over(kinds[n:], totals[n:], DISCOUNTS[1])
    for s, a, b in _by_shard(dealt.wide_shard, steps.shards):
        triple[dealt.wide[a:b]], rest[dealt.wide[a:b]] = (unpack(x) for x in _cut(of["wide"][s]))
    return _costs(blend(steps.unigram(w), pair, pair_rest, triple, rest))


def _combine(steps: Steps):
    """One row per document of a block from its own figures and the shards' answers."""

    def run(docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        base, n_known, held, sizes, *heavy = _cut(sums.loc[sums["kind"] == "own", "payload"].iloc[0])
        cost = np.zeros(len(docs["docs"].iloc[0]), np.int64)
        for payload in sums[sums["kind"] == "light"]["payload"]:
            at, part = _cut(payload)
            cost[np.cumsum(unpack(at))] += unpack(part)
        u, v, w, doc = map(unpack, heavy)
        if len(v):
            cost += np.bincount(doc, _heavy_costs(steps, sums, u, v, w), minlength=len(cost)).astype(np.int64)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs["docs"].iloc[0]], "Int64"),
                "held_out": unpack(held).astype(bool),
                "n_tokens": unpack(sizes),
                "n_known": unpack(n_known),
                "train_tokens": steps.total,
                "base_score": np.frombuffer(base, "<f8"),
                "score": -cost * GRAIN,
            }
        )

    return run


def _heavy_pairs(blocks: DataFrame, heavy: dict[bytes, int], steps: Steps) -> DataFrame:
    """(pair, n): how often pairs of heavy words stand in training documents, summed per block. heavy: their numbers by word."""
    words = steps.words
    start = steps.start if steps.parts(np.array([steps.start]))[0] > 1 else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = [w for part in row["vocabulary"] for w in zstandard.ZstdDecompressor().decompress(part["words"]).split(b" ")]
                number = np.fromiter((heavy.get(w, -1) for w in names), np.int64, len(names))
                tokens, sizes, held = number[unpack(row["tokens"])], unpack(row["sizes"]), unpack(row["held"])
                usable = np.repeat(held == 0, sizes)
                before = np.append(-1, tokens[:-1])
                before[np.cumsum(sizes) - sizes] = start
                at = np.flatnonzero(usable & (tokens >= 0) & (before >= 0))
                twice = np.full(int((held == 0).sum()) if start >= 0 else 0, start * words + start)
                pairs, place = distinct(np.append(before[at] * words + tokens[at], twice))
                yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs, pa.int64()), "n": pa.array(np.bincount(place, minlength=len(pairs)), pa.int64())})

    columns = blocks.select("held", "sizes", "tokens", F.expr("transform(vocabulary, v -> struct(v.words as words))").alias("vocabulary"))
    return columns.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def lm_score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held_out` is a condition on the column `doc_id`; what it holds for is scored, but not learned from. A-Z are lower-cased,
    words are what stands between the white space characters of ASCII, and every text ends with one end token, so null
    and empty texts have one token. base_score adds one to all counts; score is log10 P of a trigram model of the whole
    corpus with absolute discounting, the first words of a text following marks of its start. Null ids and repeated rows are documents like others. Other columns are not read. Without training
    documents every word is unknown. An empty table gives no rows. Scores do not depend on the number of partitions.
    """
    spark = docs.sparkSession
    shards = SHARDS_PER_PARTITION * partitions(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    blocks = written(_blocks(rows.select("doc_id", "text", held_out.alias("held")), shards), "lm-blocks")
    shard = blocks.select("block", F.explode("vocabulary").alias("v")).select("block", "v.shard", "v.words", "v.counts")
    train_docs, total = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("train_docs", "train_tokens"))).first()
    counted = shard.groupBy("shard").applyInPandas(
        _count_words(HEAVY_SHARES * (total + 1) / shards), f"shard int, block long, counts binary, places binary, heavy {HEAVY}"
    )
    counted = written(counted, "lm-words")
    by_count = counted.filter("block is null").mapInPandas(_split_counts, "shard int, n long, words long")
    table = by_count.groupBy("n").agg(F.sum("words").alias("words")).orderBy(F.desc("n")).toPandas()  # at most sqrt(2 N) rows
    steps = Steps(table["n"].to_numpy(np.int64), table["words"].to_numpy(np.int64), int(train_docs), shards)
    firsts = spark.createDataFrame(
        pd.DataFrame({"n": steps.counts, "first": steps.first[:-1]}).astype("int64"), "n long, first long"
    )
    before = F.sum("words").over(Window.partitionBy("n").orderBy("shard")) - F.col("words")
    bases = by_count.withColumn("before", before).join(firsts, "n")
    bases = bases.select("shard", "n", (F.col("first") + F.col("before")).alias("base"))
    heavy = counted.filter("block is null").select("shard", F.explode("heavy").alias("h")).select("shard", "h.word", "h.n", "h.place")
    heavy = heavy.join(bases, ["shard", "n"]).select("word", (F.col("base") + F.col("place")).alias("number")).collect()  # at most `shards` rows
    if heavy or steps.parts(np.array([steps.start]))[0] > 1:
        pairs = _heavy_pairs(blocks, {bytes(r["word"]): r["number"] for r in heavy}, steps)
        pairs = pairs.filter(F.col("n") >= HEAVY_SHARES * (total + 1) / shards).toPandas()  # at most `shards` rows, too
        steps.set_heavy_pairs(pairs["pair"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64))
    bases = bases.groupBy("shard").applyInPandas(_pack_bases, "shard int, ns binary, bases binary")
    numbered = counted.filter("block is not null").join(bases, "shard", "left")
    numbered = numbered.mapInPandas(_number, "block long, shard int, numbers binary")
    plain = blocks.select("block", "held", "sizes", "tokens")
    dealt = plain.groupBy("block").cogroup(numbered.groupBy("block")).applyInPandas(_deal(steps), "shard int, block long, kind string, payload binary")
    scored = dealt.groupBy("shard").applyInPandas(_score(steps), "block long, shard int, kind string, payload binary")
    return (
        blocks.select("block", "docs")
        .groupBy("block")
        .cogroup(scored.groupBy("block"))
        .applyInPandas(
            _combine(steps),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
