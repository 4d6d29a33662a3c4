"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own; the pair of centroids is a cell. A query walks the pairs in the order of
their summed distance with a heap until the cells hold enough rows, and these rows are reranked by exact distance.
The cells' sizes, at most `codewords` squared numbers, are all that the driver learns about the rows besides the bounded
sample that the centroids are fitted on. Cells are cut into parts and queries into blocks of bounded size; a part and a
block meet in one group, so that a cell with a third of all rows is many groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written


def kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's method, from distinct points taken evenly; fewer than k if there are fewer points."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(5)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(float)
    for _ in range(rounds):
        nearest = _squared(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
    return centres


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T), 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in the order of the summed distance of their two centroids, until they hold `enough` rows."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return cells


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    codewords: int | None = None,
    share: float = 0.75,
    fit_rows: int = 20_000,
    block: int = 2000,
) -> DataFrame:
    """The k nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    `is_query` is a condition on the column `vec_id`. Rows of other ids are candidates; cells are probed until they hold the
    `share` of all rows, and k candidates if there are so many. Vectors without any structure need about 0.65 of the
    rows for a recall of 0.9 at few codewords and half of them at many; vectors in clusters need far less. `codewords` per half default to the fourth root of the number of rows, which
    makes cells and rows per cell grow alike. Centroids are fitted on at most `fit_rows` rows, all rows are indexed.
    Rows with a null id, and vectors that are null, zero, of another length than most of the sample, or hold null or
    non-finite components, take no part. Ties go to the smaller id. Rows with the id of the query are never its neighbours;
    a repeated query counts once. Other columns are not read; an empty table gives no rows.
    """
    double = rows.schema[vector_column].dataType.elementType.typeName() == "double"
    kind = np.dtype("<f8" if double else "<f4")
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toPandas()["vector"]
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], result)
    width = int(sample.map(len).mode()[0])
    points = np.stack([v for v in sample if len(v) == width]).astype(float)
    half, number = (width + 1) // 2, codewords or min(256, max(2, round(total**0.25)))
    books = kmeans(points[:, :half], number), kmeans(points[:, half:], number) if width > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), dtype=kind).reshape(-1, width)
            cell = _squared(x[:, :half].astype(float), books[0]).argmin(1) * len(books[1])
            cell += _squared(x[:, half:].astype(float), books[1]).argmin(1)
            yield pa.RecordBatch.from_pydict(
                {"cell": pa.array(cell, pa.int32()), "vec_id": batch.column(0), "vector": pa.array([v.tobytes() for v in x], pa.binary())}
            )

    index = rows.filter(F.size("vector") == width).mapInArrow(assign, "cell int, vec_id long, vector binary")
    index = written(index, "multi-index")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for row in index.groupBy("cell").count().toLocalIterator():
        sizes[row["cell"]] = row["count"]
    asked = index.filter(is_query)
    number_asked, repeats = asked.groupBy("vec_id").count().agg(F.count(F.lit(1)), F.max("count")).first()
    # Rows with the query's own id fill cells, but are no candidates.
    enough = max(k + (repeats or 1), int(np.ceil(share * sizes.sum())))
    queries = asked.dropDuplicates(["vec_id"])
    blocks = max(1, -(-number_asked // block))
    parts = np.maximum(1, -(-sizes // block)).tolist()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(-1, width).astype(float)
            first, second = _squared(x[:, :half], books[0]), _squared(x[:, half:], books[1])
            found = [multi_sequence(a, b, sizes, enough) for a, b in zip(first, second, strict=True)]
            at = np.repeat(np.arange(len(found)), [sum(parts[c] for c in cells) for cells in found])
            cell, part = zip(*((c, p) for cells in found for c in cells for p in range(parts[c])), strict=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "cell": pa.array(cell, pa.int32()),
                    "part": pa.array(part, pa.int32()),
                    "vec_id": batch.column(1).take(pa.array(at)),
                    "vector": batch.column(2).take(pa.array(at)),
                }
            )

    cells = pd.DataFrame({"cell": np.arange(len(sizes), dtype=np.int32), "parts": np.array(parts, np.int32)})
    cells = rows.sparkSession.createDataFrame(cells[sizes > 0], "cell int, parts int")
    probes = queries.mapInArrow(walk, "cell int, part int, vec_id long, vector binary")
    probes = probes.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    stored = index.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("parts")

    def rerank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x = (np.frombuffer(b"".join(f["vector"]), kind).reshape(-1, width).astype(float) for f in (asked, held))
        names, ids = asked["vec_id"].to_numpy(), held["vec_id"].to_numpy()
        rough = np.where(names[:, None] == ids, np.inf, _squared(q, x))
        last = min(k, len(ids)) - 1
        bound = np.partition(rough, last, axis=1)[:, last]
        i, j = np.nonzero((rough <= (bound + 1e-9 * (1 + bound))[:, None]) & np.isfinite(rough))  # all ties, too
        exact = np.sqrt(((x[j] - q[i]) ** 2).sum(1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pd.DataFrame({"query_id": names[i[top]], "vec_id": ids[j[top]], "score": exact[top]})

    key = ["cell", "part", "block"]
    found = probes.groupBy(*key).cogroup(stored.groupBy(*key)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
