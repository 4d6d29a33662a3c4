"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most `length` tokens; full pieces are sequences of their own. The other pieces are dealt
into shards of about `shard_size` pieces by hash. Every shard is worked on by several islands, each with a population of
packings. An island crosses two packings by injecting whole well-filled bins of one into the other, removing the bins
that would hold a piece twice, and best-fitting the displaced pieces. After each epoch the best packing of every island
migrates to the next island of its shard. When all epochs are over, badly filled bins are opened and their pieces are
dealt into new shards, so that what is left over in one shard is filled up with pieces of others.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import record_batch, text_slices, written
from tidemark.llm.tokens import Encoder

PIECES = pa.schema(
    [
        ("uid", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces, but for the first, which takes the remainder."""
    first = n % length or length
    return [(0, min(first, n))] + [(start, length) for start in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_column: str = "doc_id", text_column: str = "text"):
    """One row per piece; uid tells repeated rows apart and is stable once the table is written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        end, uid = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for part, texts in text_slices(batches):
            out = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = memoryview(encoder.ids(text) + end)
                for k, (start, size) in enumerate(cut(len(ids) // 4, length)):
                    out.append((uid, doc_id, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    uid += 1
            yield record_batch(PIECES, *zip(*out, strict=True))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(encode, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of piece numbers, with the free space of each."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self, items: list[int]) -> None:
        """Put each item, in the given order, into the fullest bin that has room for it."""
        room = sorted((free, k) for k, free in enumerate(self.free) if free)
        for item in items:
            size = self.sizes[item]
            at = bisect_left(room, (size, -1))
            if at == len(room):
                k, free = len(self.bins), self.capacity
                self.bins.append([])
                self.free.append(free)
            else:
                free, k = room.pop(at)
            self.bins[k].append(item)
            self.free[k] = free - size
            if free > size:
                insort(room, (free - size, k))

    def fitness(self) -> float:
        """Mean square of the fill: few full bins beat many half-full ones."""
        return sum((self.capacity - free) ** 2 for free in self.free) / max(1, len(self.free)) / self.capacity**2

    def keep(self, bins: list[int]) -> Packing:
        part = Packing(self.sizes, self.capacity)
        part.bins, part.free = [list(self.bins[k]) for k in bins], [self.free[k] for k in bins]
        return part


def decreasing(sizes: list[int], items: list[int], rng: random.Random, noise: float) -> list[int]:
    return sorted(items, key=lambda i: -sizes[i] * (1 + noise * (rng.random() - 0.5)))


def cross(mother: Packing, father: Packing, rng: random.Random) -> Packing:
    """Inject well-filled bins of the father into the mother, drop hers that share a piece, best-fit the displaced."""
    fullest = sorted(range(len(father.bins)), key=lambda k: (father.free[k], rng.random()))
    take = fullest[: max(1, len(fullest) * rng.randint(10, 60) // 100)]
    injected = {item for k in take for item in father.bins[k]}
    stay, displaced = [], []
    for k, members in enumerate(mother.bins):
        if injected.isdisjoint(members):
            stay.append(k)
        else:
            displaced += [item for item in members if item not in injected]
    child = mother.keep(stay)
    child.bins += [list(father.bins[k]) for k in take]
    child.free += [father.free[k] for k in take]
    worst = sorted(range(len(child.bins)), key=lambda k: -child.free[k])[: max(1, len(child.bins) // 50)]
    opened = {k for k in worst if child.free[k]}
    displaced += [item for k in opened for item in child.bins[k]]
    child = child.keep([k for k in range(len(child.bins)) if k not in opened])
    child.best_fit(decreasing(child.sizes, displaced, rng, 0.02))
    return child


def evolve(sizes: list[int], capacity: int, seed: int, elite: list[list[int]] | None, population: int, generations: int):
    """The best packing after some generations; `elite` is a packing that has come from another island."""
    rng = random.Random(seed)
    lowest = -(-sum(sizes) // capacity)
    ranks: dict[int, tuple[int, float]] = {}

    def rank(packing: Packing) -> tuple[int, float]:
        if id(packing) not in ranks:
            ranks[id(packing)] = len(packing.bins), -packing.fitness()
        return ranks[id(packing)]

    herd = []
    if elite is not None:
        guest = Packing(sizes, capacity)
        guest.bins = elite
        guest.free = [capacity - sum(sizes[i] for i in members) for members in elite]
        herd.append(guest)
    while len(herd) < population:
        start = Packing(sizes, capacity)
        start.best_fit(decreasing(sizes, list(range(len(sizes))), rng, 0.1 * len(herd)))
        herd.append(start)
    for _ in range(generations):
        herd.sort(key=rank)
        if len(herd[0].bins) <= lowest:
            break
        mother, father = herd[0], rng.choice(herd[1:])
        if rng.random() < 0.5:
            mother, father = father, mother
        for gone in herd[population - 1 :]:
            ranks.pop(id(gone), None)
        herd = [*herd[: population - 1], cross(mother, father, rng)]
    return min(herd, key=rank)


def _epoch(items: DataFrame, capacity: int, epoch: int, population: int, generations: int) -> DataFrame:
    """items: shard, island, uid, length, bin (of the elite packing, null at first)."""

    def island(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        elite = None
        if rows["bin"].notna().all():
            elite = [list(g) for g in rows.groupby("bin", sort=True).indices.values()]
        seed = hash((int(rows["shard"][0]), int(rows["island"][0]), epoch))
        best = evolve(rows["length"].tolist(), capacity, seed, elite, population, generations)
        bins = np.empty(len(rows), np.int64)
        for k, members in enumerate(best.bins):
            bins[members] = k
        fitness = best.fitness() - len(best.bins)
        return rows.assign(bin=bins, fitness=fitness)[["shard", "island", "uid", "length", "bin", "fitness"]]

    return items.groupBy("shard", "island").applyInPandas(
        island, "shard long, island int, uid long, length long, bin long, fitness double"
    )


def _pack_shards(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int):
    """Rows shard, uid, length, bin: the best packing that any island has found for its shard."""
    state = items.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "uid", "length",
        F.lit(None).cast("long").alias("bin"),
    )
    for epoch in range(epochs):
        state = written(_epoch(state, capacity, epoch, population, generations), "packing-epoch")
        if epoch + 1 < epochs:  # the elite of each island goes on as the guest of the next one
            state = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int")).drop("fitness")
    best = state.groupBy("shard").agg(F.max(F.struct("fitness", "island")).alias("top"))
    chosen = best.select("shard", F.col("top.island").alias("island"))
    return state.join(chosen, ["shard", "island"], "left_semi").drop("island", "fitness")


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 1024,
    end_id: int = 2,
    shard_size: int = 4000,
    islands: int = 2,
    epochs: int = 2,
    population: int = 8,
    generations: int = 16,
    slack: float = 0.01,
    rounds: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    `tokenizer` is a file of the tokenizers library. Null and empty texts consist of the end id alone. Only documents
    longer than `length` are cut. A repeated row, or a null id, is packed like any other row. Ties between equal sizes
    go by row. In each of the `rounds` after the first, bins with more than `slack` of their space free are opened and
    repacked in shards of their own. Each island breeds `generations` children from a `population`, unless it reaches the
    lower bound of sequences before. Other columns are not read. An empty table gives no rows.
    """
    made = written(pieces(docs, tokenizer, length, end_id, id_column, text_column), "pieces")
    rest = made.filter(F.col("length") < length).select("uid", "length")
    placed = None
    for turn in range(rounds):
        rest = written(rest, "packing-rest") if turn else rest
        shards = max(1, round(rest.count() / shard_size))
        items = rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)))
        packed = written(_pack_shards(items, length, islands, epochs, population, generations), "packing-round")
        packed = packed.withColumn("sequence_id", (F.col("shard") * rounds + turn) * 2**20 + F.col("bin"))
        fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
        opened = fill.filter(F.col("fill") < (1 - slack) * length).select("sequence_id") if turn + 1 < rounds else None
        settled = packed if opened is None else packed.join(opened, "sequence_id", "left_anti")
        settled = settled.select("uid", "length", "sequence_id")
        placed = settled if placed is None else placed.unionByName(settled)
        rest = None if opened is None else packed.join(opened, "sequence_id", "left_semi").select("uid", "length")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("uid"))  # of at most `length` members
    offsets = placed.select("uid", "sequence_id", (before - F.col("length")).alias("offset"))
    full = made.filter(F.col("length") == length).select(
        *PIECES.names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return made.filter(F.col("length") < length).join(offsets, "uid").select(full.columns).unionByName(full).drop("uid")
