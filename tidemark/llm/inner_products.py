"""Exact top-k inner products by norm-sorted pruned search.

Vectors become whole numbers and are dealt into bands of falling length. They are rotated by the right singular vectors
of the table (eigenvectors of its Gram matrix, summed on the executors), so that the first coordinates hold most of a
product. By Cauchy-Schwarz a product is at most the sum over the first w coordinates plus the product of the lengths of both
remainders. A query starts from its k-th best product with the `lead` longest rows; bands, chunks and pairs whose bound is below
the k-th best are left out, and a chunk too short for a query ends its search. Scores are products of the unrotated whole
numbers.

Queries that need rows of similar length form a block of bounded size; a block meets each part of the bands it needs, also
of bounded size, in a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Bounds are computed in floating point; this share of both lengths is added to them.
SLACK = 1e-9
BANDS = 32
#: Rows that a search takes at a time, queries whose start is searched at a time, and pairs multiplied at a time.
CHUNK, ASKED, PAIRS = 1024, 500, 50_000
LARGEST = 2**63 - 1
RESULT = "query_id long, rank int, vec_id long, score long"


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components. Zero and empty vectors take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def pack(whole: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as little-endian 32-bit integers, or as doubles if one does not fit."""
    small = (np.abs(whole) < 2**31).all(axis=1)
    return [r.astype("<i4").tobytes() if s else r.astype("<f8").tobytes() for r, s in zip(whole, small.tolist(), strict=True)]


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    if not len(rows):
        return np.zeros((0, width))
    if all(len(r) == 4 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), width).astype(float)
    return np.stack([np.frombuffer(r, "<i4" if len(r) == 4 * width else "<f8").astype(float) for r in rows])


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of q[i] and x[j], pair by pair, as exact 64-bit integers; beyond their range the nearest of them."""
    if not len(i) or not q.shape[1]:
        return np.zeros(len(i), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        if 8 * len(i) > len(q) * len(x):  # most pairs: as one matrix
            return (q @ x.T)[i, j].astype(np.int64)
        pieces = [slice(at, at + PAIRS) for at in range(0, len(i), PAIRS)]
        return np.concatenate([np.einsum("ij,ij->i", q[i[p]], x[j[p]]) for p in pieces]).astype(np.int64)
    rows, columns = q.tolist(), x.tolist()
    sums = (sum(int(a) * int(b) for a, b in zip(rows[r], columns[c], strict=True)) for r, c in zip(i.tolist(), j.tolist(), strict=True))
    return np.array([max(-LARGEST, min(LARGEST, s)) for s in sums], np.int64)


def top(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query i, ties to the smaller id, ordered by query and rank."""
    order = np.lexsort((ids, -score, i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < k]


class Pruned:
    """Searches queries in rows of falling length. `rotation`: orthonormal columns, the heaviest direction first."""

    def __init__(self, rotation: np.ndarray, k: int):
        self.rotation, self.k = rotation, k
        width = len(rotation)
        self.cuts = sorted({max(1, width * part // 4) for part in (1, 2, 3, 4)}) if width else []

    def _turned(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated rows, and the length of what follows each cut."""
        turned = rows @ self.rotation
        squares = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.column_stack([squares[:, c] if c < turned.shape[1] else np.zeros(len(rows)) for c in self.cuts] or [np.zeros(len(rows))])
        return turned, np.sqrt(np.maximum(rest, 0))

    def search(self, names: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple:
        """(query place, id, score) of the k best rows of each query among those that reach `least`."""
        q_size, x_size = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
        order = np.argsort(-x_size, kind="stable")
        ids, x, x_size = ids[order], x[order], x_size[order]
        (q_turned, q_rest), least = self._turned(q), least.copy()
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for at in range(0, len(ids), CHUNK):
            part = slice(at, at + CHUNK)
            rows = np.flatnonzero(q_size * x_size[at] * (1 + SLACK) + SLACK >= least)
            if not len(rows):
                break  # all that follows is shorter
            turned, rest = self._turned(x[part])
            i, j = self._survivors(rows, q_turned, q_rest, q_size, least, turned, rest, x_size[part])
            other = names[i] != ids[part][j]
            i, j = i[other], j[other]
            score = products(q, x[part], i, j)
            reached = score >= least[i]
            i, j, score = i[reached], j[reached], score[reached]
            merged = [np.concatenate(p) for p in zip(best, (i, ids[part][j], score), strict=True)]
            kept = top(merged[0], merged[2], merged[1], self.k)
            best = tuple(m[kept] for m in merged)
            ranks = np.arange(len(kept)) - np.searchsorted(best[0], best[0])
            full = ranks == self.k - 1
            least[best[0][full]] = np.maximum(least[best[0][full]], best[2][full])
        return best

    def _survivors(self, rows, q_turned, q_rest, q_size, least, turned, rest, x_size) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose bound reaches the query's k-th best product after every cut."""
        columns = np.arange(len(turned))
        sums, begin = np.zeros((len(rows), len(columns))), 0
        alive = np.ones(sums.shape, bool)
        for c, end in enumerate(self.cuts):
            sums = sums + q_turned[rows, begin:end] @ turned[columns, begin:end].T
            slack = SLACK * (1 + q_size[rows, None] * x_size[columns])
            alive = alive & (sums + q_rest[rows, c, None] * rest[columns, c] + slack >= least[rows, None])
            some_rows, some_columns = alive.any(1), alive.any(0)
            rows, columns = rows[some_rows], columns[some_columns]
            sums, alive, begin = sums[some_rows][:, some_columns], alive[some_rows][:, some_columns], end
            if not len(rows):
                break
        i, j = np.nonzero(alive)
        return rows[i], columns[j]


def _blocks(value: str, edges: list[float]) -> Column:
    """The number of edges that are at most the value, which is not negative."""
    return sum(((F.col(value) >= e).cast("int") for e in edges), (F.col(value) < 0).cast("int"))


def _edges(rows: DataFrame, column: str, size: int) -> list[float]:
    """Bounds of up to BANDS groups of about equal size, and of `size` rows at least."""
    groups = min(BANDS, -(-rows.count() // size))
    return sorted(set(rows.approxQuantile(column, [n / groups for n in range(1, groups)], 0.005))) if groups > 1 else []


def top_inner_products(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    lead: int = 4096,
    block: int = 2000,
    part: int = 16_000,
) -> DataFrame:
    """The k highest inner products of each query: query_id, rank (from 1), vec_id, score (a whole number).

    Components become floor(scale * x) in double precision. `is_query` is a condition on the column `vec_id`; rows of other
    ids are candidates, all of them if there are fewer than k. Null vectors, and those with null or non-finite components, also
    once scaled, take no part, nor do rows with a null id. Shorter vectors count as filled up with zeros, so empty and zero vectors have
    products 0. Ties go to the smaller id. Rows with the id of the query are never among its results; repeated candidates
    count each, a repeated query once, by its smallest vector. Products beyond 64 bits become the nearest number of 64 bits. Other
    columns are not read. An empty table gives no rows.

    The driver holds the `lead` longest rows, the Gram matrix (the square of the vectors' width) and a few numbers a band.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.transform("vector", lambda x: x * scale)))
    width = rows.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return spark.createDataFrame([], RESULT)
    width = max(1, width)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            column = batch.column(1)
            sizes = np.diff(np.asarray(column.offsets))
            x = np.zeros((batch.num_rows, width))
            x[np.arange(width) < sizes[:, None]] = np.floor(scale * np.asarray(column.flatten(), dtype=float))
            length = np.sqrt((x**2).sum(1))
            place = pa.array(np.arange(rows, rows + len(x)), pa.int64())  # tells repeated rows apart
            rows += len(x)
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column(0), "place": place, "length": length, "vector": pa.array(pack(x), pa.binary())}
            )

    held = written(rows.mapInArrow(whole, "vec_id long, place long, length double, vector binary"), "inner-vectors")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = unpack(batch.column(0).to_pylist(), width)
            x = x / max(1.0, np.abs(x).max(initial=0)) if np.abs(x).max(initial=0) > 1e100 else x
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(width * width), pa.int32()), "value": total.ravel()})

    sums = held.select("vector").mapInArrow(gram, "cell int, value double").groupBy("cell").agg(F.sum("value")).toPandas()
    matrix = np.zeros(width * width)
    matrix[sums.iloc[:, 0]] = sums.iloc[:, 1]
    rotation = np.linalg.eigh(matrix.reshape(width, width))[1][:, ::-1]
    pruned = Pruned(np.ascontiguousarray(rotation), k)
    first = held.orderBy(F.desc("length"), "vec_id", "vector").limit(lead).toPandas()
    first_ids, first_x = first["vec_id"].to_numpy(np.int64), unpack(first["vector"].tolist(), width)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ASKED) for b in batches for at in range(0, b.num_rows, ASKED)):
            names = np.asarray(batch.column(0))
            q = unpack(batch.column(1).to_pylist(), width)
            i, _, score = pruned.search(names, q, np.full(len(q), -np.inf), first_ids, first_x)
            least = np.full(len(q), -np.inf)
            ranks = np.arange(len(i)) - np.searchsorted(i, i)
            least[i[ranks == k - 1]] = score[ranks == k - 1]
            size = np.sqrt((q**2).sum(1))
            need = np.where(least > 0, least / np.maximum(size, 1e-300), 0.0)  # rows shorter than this cannot reach it
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "vector": batch.column(1), "least": least, "need": need})

    asked = held.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = written(asked.mapInArrow(begin, "vec_id long, vector binary, least double, need double"), "inner-queries")

    held = held.withColumn("band", _blocks("length", _edges(held, "length", part)))
    asked = asked.withColumn("needs", _blocks("need", _edges(asked, "need", block)))
    bands = held.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).toPandas()
    needs = asked.groupBy("needs").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("least")).toPandas()
    # Which bands a group of queries needs, how many parts a band has, and how many blocks a group of queries.
    met = [
        (int(n.needs), -(-int(n.n) // block), int(b.band), -(-int(b.n) // part))
        for n in needs.itertuples()
        for b in bands.itertuples()
        if b.longest * (1 + SLACK) + SLACK >= n.least
    ]
    pairs = spark.createDataFrame(met, "needs int, blocks int, band int, parts int")
    queries = asked.join(pairs, "needs").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stored = held.join(pairs, "band").withColumn("part", F.pmod(F.xxhash64("vec_id", "place"), F.col("parts")).cast("int"))
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names, ids = asked["vec_id"].to_numpy(np.int64), held["vec_id"].to_numpy(np.int64)
        q, x = unpack(asked["vector"].tolist(), width), unpack(held["vector"].tolist(), width)
        i, found, score = pruned.search(names, q, asked["least"].to_numpy(float), ids, x)
        return pd.DataFrame({"query_id": names[i], "vec_id": found, "score": score})

    key = ["needs", "block", "band", "part"]
    queries, stored = queries.select(*key, "vec_id", "vector", "least"), stored.select(*key, "vec_id", "vector")
    found = queries.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
