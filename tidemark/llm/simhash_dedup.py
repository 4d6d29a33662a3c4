"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are joined once each, however many documents share one. If two differ in at most `budget` bits, then of
`budget` + 1 blocks of bits one at least is equal: each fingerprint goes into one group per block, keyed by the
block's value. In a group the fingerprints form a binary trie. Pairs of its nodes are walked together from the root, the
bits in which they differ are added up, and a pair is left as soon as it exceeds the budget. A group hands on a spanning
forest of the links that it finds, never all of its pairs. Groups above `group_limit` are split in parts, and every
two parts meet in a task of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, record_batch, text_slices, written
from tidemark.llm.components import components

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64 bits: a bit is 1 if more than half of the shingles' hashes have it; 0 for a text without words."""
    words = text.encode().lower().split()  # of bytes, both know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = (ends - 1)[shingle - 1 :].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65_536):
        part = slice(at, at + 65_536)
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[part], ends[part], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            yield record_batch(PRINTS, part.column(0), np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(values: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of values of one group that differ in 1 to `budget` bits.

    values: unsigned 64-bit, sorted within each group; groups: non-decreasing. A trie node of depth d is the range [lo, hi)
    of values that share their first d bits; all node pairs of a depth are taken a step down at once.
    """
    n = len(values)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    differ = values[1:] ^ values[:-1]
    # Bits that neighbours share: a node splits at depth d where neighbours inside it share exactly d bits.
    shared = np.full(n, -1, np.int64)
    bits = np.zeros(n - 1, np.int64)
    rest = differ.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        up = high > 0
        bits += np.where(up, step, 0)
        rest = np.where(up, high, rest)
    shared[1:] = np.where(groups[1:] != groups[:-1], -1, np.where(differ == 0, BITS, BITS - 1 - bits))
    firsts = np.flatnonzero(shared == -1)
    lasts = np.append(firsts[1:], n)
    a_lo = b_lo = firsts
    a_hi = b_hi = lasts
    errors = np.zeros(len(firsts), np.int64)
    found_i, found_j = [], []
    for depth in range(BITS + 1):
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)  # two leaves: the remaining bits at once
        i, j = a_lo[single], b_lo[single]
        near = (i != j) & (_popcount(values[i] ^ values[j]) <= budget)
        found_i.append(i[near])
        found_j.append(j[near])
        a_lo, a_hi, b_lo, b_hi, errors = (x[~single] for x in (a_lo, a_hi, b_lo, b_hi, errors))
        if not len(a_lo) or depth == BITS:
            break
        splits = np.append(np.flatnonzero(shared == depth), n)
        shift = np.uint64(BITS - 1 - depth)

        def halves(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Ranges of the children 0 and 1; an absent child is empty."""
            at = splits[np.searchsorted(splits, lo, "right")]
            one = (values[lo] >> shift) & np.uint64(1) == 1
            middle = np.where(at < hi, at, np.where(one, lo, hi))
            return np.stack([lo, middle]), np.stack([middle, hi])

        (al, ah), (bl, bh) = halves(a_lo, a_hi), halves(b_lo, b_hi)
        same = a_lo == b_lo
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                more = errors + (x != y)
                ok = (more <= budget) & (ah[x] > al[x]) & (bh[y] > bl[y])
                if x > y:
                    ok &= ~same  # a node with itself: its two children meet once
                parts.append((al[x][ok], ah[x][ok], bl[y][ok], bh[y][ok], more[ok]))
        a_lo, a_hi, b_lo, b_hi, errors = (np.concatenate(p) for p in zip(*parts, strict=True))
    return np.concatenate(found_i), np.concatenate(found_j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


def _links(prints: DataFrame, budget: int, group_limit: int) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints."""
    width = -(-BITS // (budget + 1))
    keys = [
        (F.lit(k).cast("long") * 2**40 + F.shiftrightunsigned("print", k * width).bitwiseAND((1 << width) - 1)).alias("key")
        for k in range(budget + 1)
    ]
    entries = prints.select("print", F.explode(F.array(*keys)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / group_limit).cast("int")
    entries = entries.join(sizes, "key").withColumn("parts", parts)
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    pair = F.transform(others, lambda other: F.struct(F.least(own, other).alias("p"), F.greatest(own, other).alias("q")))
    # Two parts meet once; what is within one part is found whenever it meets another.
    pair = F.when(F.col("parts") == 1, pair).otherwise(F.filter(pair, lambda x: x["p"] != x["q"]))
    tasks = entries.select("print", "key", F.explode(pair).alias("pair")).select("print", "key", "pair.p", "pair.q")
    tasks = tasks.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "print")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows < 4 * group_limit:
                continue
            both = pd.concat(held, ignore_index=True)
            last = both[["key", "p", "q"]].ne(both[["key", "p", "q"]].iloc[-1]).any(axis=1).to_numpy()
            whole = int(last.sum())  # the last group may go on in the next batch
            if whole:
                yield edges(both.iloc[:whole])
            held, rows = [both.iloc[whole:]], len(both) - whole
        if rows:
            yield edges(pd.concat(held, ignore_index=True))

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        change = frame[["key", "p", "q"]].ne(frame[["key", "p", "q"]].shift()).any(axis=1).to_numpy()
        group = np.cumsum(change)
        values = frame["print"].to_numpy().view(np.uint64)
        order = np.lexsort((values, group))
        values, group = values[order], group[order]
        i, j = trie_links(values, group, budget)
        root = spanning(len(values), i, j)
        moved = np.flatnonzero(root != np.arange(len(values)))
        out = pd.DataFrame({"a": values[root[moved]].view(np.int64), "b": values[moved].view(np.int64)})
        return out[out["a"] != out["b"]]

    return tasks.mapInPandas(join, "a long, b long")


def _classes(prints: DataFrame, budget: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """(print, root) of all fingerprints, and of each component its root and the (doc_id, print) that stands for it.

    The smallest id stands for a component, and of its fingerprints the smallest; null ids only if there is no other. The
    components are a written table, so that the join by root has plain exchanges on both sides, of which a large component's is split.
    """
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    linked = written(components(_links(classes.select("print"), budget, group_limit)), "components")
    rooted = classes.join(linked.withColumnRenamed("node", "print"), "print", "left")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "print")), "rooted")
    first = F.min(F.struct(F.col("first").isNull(), F.col("first").alias("doc_id"), "print")).alias("least")
    named = rooted.groupBy("root").agg(first).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.print").alias("kept_print"))
    return rooted.select("print", "root"), written(named, "named")


def simhash_classes(
    docs: DataFrame, budget: int = 4, group_limit: int = 1000, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, print, component_id (the smallest doc_id reachable over links).

    Texts link if their fingerprints differ in at most `budget` bits. Null and empty texts have fingerprint zero and link
    like any other. Null ids are members of their component, but name it only if it has no other id; repeated
    rows are returned as often as they occur. Other columns are not read. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_column, text_column), "prints")
    rooted, named = _classes(prints, budget, group_limit)
    of_print = rooted.join(named, "root").select("print", "component_id")
    return prints.join(of_print, "print").select("doc_id", "print", "component_id")


def keep_one(
    docs: DataFrame, budget: int = 4, group_limit: int = 1000, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The whole rows of `docs` that stay: one of each component, that of the smallest id.

    If this id has several texts in the component, the one of the smallest fingerprint stays; if its row is repeated, one repetition.
    A component of null ids only keeps the row of its smallest fingerprint. All columns are kept, whatever their names.
    """
    prints = written(fingerprints(docs, id_column, text_column), "prints")
    _, named = _classes(prints, budget, group_limit)
    kept_id, kept_print = fresh("kept_id", docs), fresh("kept_print", docs)
    # An id that stands once is found by id alone. Rows of null and repeated ids are told apart by their fingerprints.
    times = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    kept = named.select(F.col("component_id").alias("doc_id"), F.col("kept_print").alias("print"))
    kept = kept.join(times, kept["doc_id"].eqNullSafe(times["doc_id"])).select(kept["doc_id"].alias(kept_id), F.col("print").alias(kept_print), "times")
    kept = written(kept, "near-kept")
    alone = F.col(kept_id).isNotNull() & (F.col("times") == 1)
    stay = docs.join(kept.filter(alone), docs[id_column].cast("long") == F.col(kept_id), "left_semi")
    several = kept.filter(~alone)
    if several.isEmpty():
        return stay
    own = fresh("print_of_row", docs)
    rows = _with_print(docs.join(several, docs[id_column].cast("long").eqNullSafe(F.col(kept_id)), "left_semi"), own, text_column)
    rows = rows.join(several, rows[id_column].cast("long").eqNullSafe(F.col(kept_id)) & (rows[own] == F.col(kept_print)), "left_semi")
    return stay.unionByName(rows.dropDuplicates([id_column, own]).drop(own))


def _with_print(docs: DataFrame, column: str, text_column: str) -> DataFrame:
    """The rows with their fingerprints in a new column."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_column):
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints)], names=[*part.schema.names, column])

    return docs.mapInArrow(run, schema)
