"""The trie of all conversations' prefixes, by balanced parentheses.

A turn is a digest of its role and text, a conversation the path of its turns' digests. Paths are sorted over the cluster, so each
range of them (a shard) is a stretch of the trie's preorder. A shard writes its trie as balanced parentheses. Blocks of
the excess' minima (range min tree) find the parenthesis that closes a node, and thereby delimit its subtree; ranks of leaf pairs `()`
count leaves, and cumulative arrays of members and words give what the subtree shares.

Only nodes on a shard's first and last path, its spines, can go on in other shards. Each spine keeps, by depth, sums over
the subtrees that are complete. The spines of all shards in order are a trie again, of far fewer paths: they are folded in the
same way, level by level, until one shard holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, written

#: Characters of a turn's digest, and of a node's key.
DIGEST = 32
#: Turns of a shard's paths from which on it is closed, and paths that a shard of spines holds at least (over 2, which it leaves).
SHARD_TURNS, SHARD_SPINES = 200_000, 8
#: Ids of one piece of text that is digested.
PIECE = 1000
NONE = np.iinfo(np.int64).max
SUMS = ("ends", "convs", "kids", "leaves", "saved")
NODE = "conv_id long, depth long, parent_conv_id long, parent_key string, n_convs long, n_children long, n_leaves long, saved_tokens long, node_key string, n_ends long"
SPINE = "place long, path string, " + ", ".join(f"{name} array<long>" for name in (*SUMS, "low", "words"))
NODE_COLUMNS, SPINE_COLUMNS = ([field.split(" ")[0] for field in schema.split(", ")] for schema in (NODE, SPINE))
WORD = r"[^\x20\x09-\x0D]+"


class Parentheses:
    """Balanced parentheses of a trie in preorder, with a tree of the blocks' smallest excess."""

    BLOCK = 64

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.depth, self.open = depth, 2 * np.arange(n) - depth  # before node i, i nodes were opened and i - depth closed
        bits = np.zeros(-(-2 * n // self.BLOCK) * self.BLOCK, bool)
        bits[self.open] = True
        self.bits = np.packbits(bits, bitorder="little")
        excess = np.cumsum(np.where(bits, 1, -1))
        self.before = np.append(0, excess[self.BLOCK - 1 :: self.BLOCK])  # at each block's beginning
        low = excess.reshape(-1, self.BLOCK).min(1)
        self.levels = [low]
        while len(low) > 1:
            low = np.append(low, NONE) if len(low) % 2 else low
            low = low.reshape(-1, 2).min(1)
            self.levels.append(low)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def _scan(self, at: np.ndarray, excess: np.ndarray, target: np.ndarray) -> np.ndarray:
        """From places `at`, before which the excess is given, the first of the block where it is `target`; -1 if there is none."""
        found, live = np.full(len(at), -1, np.int64), np.arange(len(at))
        at, excess = at.copy(), excess.copy()
        while len(live):
            excess[live] += 2 * self.bit(at[live]).astype(np.int64) - 1
            hit = excess[live] == target[live]
            found[live[hit]] = at[live[hit]]
            at[live] += 1
            live = live[~hit & (at[live] % self.BLOCK != 0)]
        return found

    def findclose(self) -> np.ndarray:
        """For every node the place of its closing parenthesis: the first after it with an excess of the node's depth."""
        begin, target = self.open + 1, self.depth
        inside = np.flatnonzero(begin % self.BLOCK != 0)
        found = np.full(len(begin), -1, np.int64)
        found[inside] = self._scan(begin[inside], target[inside] + 1, target[inside])
        rest = np.flatnonzero(found < 0)
        node, level = -(-begin[rest] // self.BLOCK), np.zeros(len(rest), np.int64)
        live = np.arange(len(rest))
        while len(live):
            low = self._low(level[live], node[live])
            enough = low <= target[rest[live]]
            down, on = live[enough & (level[live] > 0)], live[~enough]
            level[down] -= 1
            node[down] *= 2
            node[on] += 1
            up = on[node[on] % 2 == 0]  # the next node is a first child: go on with its parent
            node[up] //= 2
            level[up] += 1
            live = np.concatenate([down, on])
        found[rest] = self._scan(node * self.BLOCK, self.before[node], target[rest])
        return found

    def _low(self, level: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(level), np.int64)
        for k in np.unique(level).tolist():
            out[level == k] = self.levels[k][node[level == k]]
        return out

    def subtrees(self) -> np.ndarray:
        """The end of each node's range in preorder: how many parentheses are opened up to its closing one."""
        return (self.findclose() + 1 + self.depth) // 2

    def leaves(self) -> np.ndarray:
        """True for nodes whose parenthesis is closed at once."""
        return self.bit(self.open + 1) == 0


def range_minima(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest of values[begin:end], each not empty, by minima over stretches of powers of two."""
    level = np.frexp((end - begin).astype(float))[1] - 1
    out, table = np.empty(len(begin), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            table = np.minimum(table[: -(1 << k - 1)], table[1 << k - 1 :])
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[begin[here]], table[end[here] - (1 << k)])
    return out


def _shared(a: str, b: str) -> int:
    """Turns that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _keys(path: str, depths: list[int]) -> list[str]:
    """Keys of the nodes of a path at growing depths: digests of the path so far."""
    state, at, keys = hashlib.sha256(), 0, []
    for d in depths:
        state.update(path[at * DIGEST : d * DIGEST].encode())
        at = d
        keys.append(state.hexdigest()[:DIGEST])
    return keys


class Shard:
    """The trie of paths in ascending order.

    paths: one text for each; words: the words of each path's turns, or by depth from 0 for spines; ids: who ends at the end of
    each path; sums: for spines instead of ids, arrays by depth of what is complete.
    """

    def __init__(self, paths: list[str], words: list, ids: np.ndarray | None, sums: dict[str, list] | None = None):
        self.paths = paths
        depth, parent, owner, stack, last = [], [], [], [], []
        for r, path in enumerate(paths):
            keep = _shared(paths[r - 1], path) + 1 if r else 0
            del stack[keep:]
            for d in range(keep, len(path) // DIGEST + 1):
                parent.append(stack[-1] if stack else -1)
                stack.append(len(depth))
                depth.append(d)
                owner.append(r)
            last.append(list(stack) if sums is not None or r in (0, len(paths) - 1) else stack[-1:])
        self.depth, self.parent, self.owner = (np.array(x, np.int64) for x in (depth, parent, owner))
        n = len(depth)
        self.first_path, self.last_path = last[0], last[-1]
        self.sums = {name: np.zeros(n, np.int64) for name in SUMS}
        self.low = np.full(n, NONE, np.int64)
        if sums is None:
            at = np.array([nodes[-1] for nodes in last], np.int64)
            self.sums["ends"] = np.bincount(at, minlength=n)
            self.sums["convs"] = self.sums["ends"].copy()
            np.minimum.at(self.low, at, ids)
            starts = np.cumsum([0, *map(len, words)])[:-1]
            flat = np.concatenate([np.zeros(1, np.int64), *(np.asarray(w, np.int64) for w in words)])
            self.words = np.where(self.depth > 0, flat[starts[self.owner] + self.depth], 0)
        else:
            at = np.concatenate([np.array(nodes) for nodes in last])
            for name in SUMS:
                np.add.at(self.sums[name], at, np.concatenate(sums[name]))
            np.minimum.at(self.low, at, np.concatenate(sums["low"]))
            self.words = np.zeros(n, np.int64)
            self.words[at] = np.concatenate(words)
        self._measure()

    def _measure(self) -> None:
        shape, n = Parentheses(self.depth), len(self.depth)
        nodes, end = np.arange(n), shape.subtrees()

        def below(values: np.ndarray) -> np.ndarray:
            """Sums over all subtrees."""
            total = np.append(0, np.cumsum(values))
            return total[end] - total[nodes]

        leaf = shape.leaves() & (self.sums["kids"] == 0)
        self.n_leaves = below(self.sums["leaves"] + leaf)
        self.n_convs = below(self.sums["convs"])
        self.conv_id = range_minima(self.low, nodes, end)
        self.n_children = self.sums["kids"] + np.bincount(self.parent[1:], minlength=n)
        self.own = (self.n_convs - 1) * self.words
        self.saved = below(self.sums["saved"] + self.own)

    def nodes(self, complete: np.ndarray, keyed: bool) -> dict[str, pa.Array]:
        """Columns of complete nodes. A key goes with nodes where conversations end, with all if `keyed`, and with open parents."""
        at = np.flatnonzero(complete)
        up = self.parent[at]
        known = (up >= 0) & complete[up]
        open_parent = (up >= 0) & ~known
        named = np.zeros(len(self.depth), bool)
        named[at] = keyed | (self.sums["ends"][at] > 0)
        asked = named.copy()
        asked[up[open_parent]] = True
        keys = np.full(len(self.depth), None, object)
        asked = np.flatnonzero(asked)
        owners, begin = np.unique(self.owner[asked], return_index=True)  # owners never fall in preorder
        for r, a, b in zip(owners.tolist(), begin.tolist(), [*begin[1:].tolist(), len(asked)][: len(begin)], strict=True):
            mine = asked[a:b]
            keys[mine] = _keys(self.paths[r], self.depth[mine].tolist())
        whole = {
            "conv_id": self.conv_id, "depth": self.depth, "n_convs": self.n_convs, "n_children": self.n_children,
            "n_leaves": self.n_leaves, "saved_tokens": self.saved, "n_ends": self.sums["ends"],
        }
        return {name: pa.array(values[at]) for name, values in whole.items()} | {
            "parent_conv_id": pa.array(self.conv_id[up], mask=~known),
            "parent_key": pa.array(np.where(open_parent, keys[up], None), pa.string()),
            "node_key": pa.array(np.where(named[at], keys[at], None), pa.string()),
        }

    def spines(self) -> tuple[np.ndarray, list[tuple[str, dict[str, np.ndarray]]]]:
        """Which nodes are complete, and the first and the last path with the sums of what is complete below their nodes."""
        complete = np.ones(len(self.depth), bool)
        complete[self.first_path] = complete[self.last_path] = False
        done = np.flatnonzero(complete)
        under = done[~complete[self.parent[done]]]
        up = self.parent[under]
        held = {name: self.sums[name].copy() for name in SUMS}
        for name, values in (("convs", self.n_convs), ("leaves", self.n_leaves), ("saved", self.saved), ("kids", np.ones_like(self.depth))):
            np.add.at(held[name], up, values[under])
        low = self.low.copy()
        np.minimum.at(low, up, self.conv_id[under])
        rows, seen = [], np.zeros(len(self.depth), bool)
        for path, nodes in ((self.paths[0], self.first_path), (self.paths[-1], self.last_path)):
            nodes = np.array(nodes)
            again = seen[nodes]  # what both paths share counts once
            seen[nodes] = True
            if rows and again.all():
                break
            row = {name: np.where(again, 0, held[name][nodes]) for name in SUMS}
            rows.append((path, row | {"low": np.where(again, NONE, low[nodes]), "words": self.words[nodes]}))
        return complete, rows


def _pack(nodes: dict[str, pa.Array], spines: list, place: int) -> pa.RecordBatch:
    """Nodes and spines as rows of one table."""
    n, m = len(nodes["depth"]), len(spines)
    out = {name: pa.concat_arrays([nodes[name], pa.nulls(m, nodes[name].type)]) for name in NODE_COLUMNS}
    own = {"place": pa.array(range(place, place + m), pa.int64()), "path": pa.array([p for p, _ in spines], pa.string())}
    own |= {name: pa.array([row[name] for _, row in spines], pa.list_(pa.int64())) for name in (*SUMS, "low", "words")}
    return pa.RecordBatch.from_pydict(out | {name: pa.concat_arrays([pa.nulls(n, x.type), x]) for name, x in own.items()})


def _fold(level: int, final: bool):
    """Shards of the rows of a partition, in order: what is complete, and the spines.

    Rows of level 0: path, conv_id, words; of later levels those of SPINE.
    """

    def shard(tables: list[pa.RecordBatch]) -> Shard:
        rows = pa.Table.from_batches(tables)
        column = lambda name: rows.column(name).to_pylist()
        if level == 0:
            return Shard(column("path"), column("words"), np.array(column("conv_id"), np.int64))
        sums = {name: [np.array(x, np.int64) for x in column(name)] for name in (*SUMS, "low")}
        return Shard(column("path"), [np.array(x, np.int64) for x in column("words")], None, sums)

    def finish(tables: list[pa.RecordBatch], place: int) -> pa.RecordBatch:
        trie = shard(tables)
        complete, spines = (np.ones(len(trie.depth), bool), []) if final else trie.spines()
        return _pack(trie.nodes(complete, level > 0), spines, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        held, turns, paths = [], 0, 0
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(batch.schema.get_field_index("words")).offsets)) + 1
            begin = 0
            for k, size in enumerate(sizes.tolist()):
                turns, paths = turns + size, paths + 1
                if not final and turns >= SHARD_TURNS and (level == 0 or paths >= SHARD_SPINES):
                    yield finish([*held, batch.slice(begin, k + 1 - begin)], place)
                    held, turns, paths, begin, place = [], 0, 0, k + 1, place + 2
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield finish(held, place)

    return run


def turn_paths(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of the digest of role and text, and the text's number of words.

    Turns are ordered by their number, nulls first; equal numbers by digest. Null roles and texts count as empty. Rows without a
    conversation id take no part. Other columns are not read. Texts stay where they are: only digests are shuffled, and those of a
    conversation are brought together in one row of about 50 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, DIGEST)
    rows = conversations.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.struct(F.col(turn_column).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("turn"),
    )
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _joined(turns: DataFrame) -> DataFrame:
    return turns.select(F.array_join("turns.digest", "").alias("path"), "conv_id", F.col("turns.words").alias("words"))


def members(turns: DataFrame) -> DataFrame:
    """(node_key, conv_id): the node at which each conversation ends."""
    rows = _joined(turns)
    return rows.select(F.substring(F.sha2("path", 256), 1, DIGEST).alias("node_key"), "conv_id")


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations in `turns` (as of `turn_paths`), the empty one included.

    conv_id: the smallest member; depth: turns of the prefix; parent_conv_id: the smallest member of the prefix without its last turn, null for the empty one;
    n_convs: members, that is conversations beginning with the prefix; n_children: prefixes one turn longer; n_leaves: prefixes in the
    subtree without children; saved_tokens: the sum over the subtree of members but one times words of the last turn; n_ends:
    members that are the prefix itself, and node_key, which `members` leads them to (null where nobody ends).

    Conversations without turns are members of the empty prefix. Conversation ids are expected once each; a repeated one
    counts as often. No conversations give no rows. However many conversations are equal, they are spread over the shards.
    """
    spark = turns.sparkSession
    rows = _joined(turns).repartitionByRange(shards or partitions(spark), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found, level, final = [], 0, False
    while True:
        done = written(rows.mapInArrow(_fold(level, final), f"{NODE}, {SPINE}"), f"trie-{level}")
        found.append(done.filter("place is null").select(*NODE_COLUMNS, F.lit(level).alias("level")))
        if final:
            break
        spines = done.filter("place is not null").select(*SPINE_COLUMNS)
        number, size = spines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        level, final = level + 1, number <= 2 * SHARD_SPINES or size <= SHARD_TURNS
        parts = 1 if final else max(1, min(-(-size // SHARD_TURNS), number // (2 * SHARD_SPINES)))
        rows = spines.repartitionByRange(parts, "place").sortWithinPartitions("place")
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    spine = nodes.filter("level > 0").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("up"))
    under = nodes.filter("parent_key is not null").join(spine, "parent_key").withColumn("parent_conv_id", F.col("up")).drop("up")
    nodes = nodes.filter("parent_key is null").unionByName(under)
    key = F.when(F.col("n_ends") > 0, F.col("node_key")).alias("node_key")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", key)


def ids_sha256(rows: DataFrame) -> DataFrame:
    """(node_key, sha256) of rows (node_key, conv_id): the digest of each key's ids in ascending order, joined by commas.

    Ids are sorted over the cluster and joined to pieces of text there, so that the one task that digests a frequent key gets a row for
    each PIECE of its ids, in order, and holds one batch of them at a time.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(partitions(spark), "node_key", "conv_id").sortWithinPartitions("node_key", "conv_id")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            keys, ids = frame["node_key"].to_numpy(), frame["conv_id"].to_numpy()
            new = np.append(True, keys[1:] != keys[:-1])
            starts = np.flatnonzero(new)
            inner = np.arange(len(ids)) - starts[np.cumsum(new) - 1]
            cuts = np.flatnonzero(inner % PIECE == 0)
            text = [",".join(map(str, part.tolist())) for part in np.split(ids, cuts[1:])]
            yield pd.DataFrame({"node_key": keys[cuts], "first": ids[cuts], "ids": text})

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            out = []
            for name, ids in zip(frame["node_key"], frame["ids"], strict=True):
                if name != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node_key", "sha256"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["node_key", "sha256"])

    pieces = ordered.mapInPandas(join, "node_key string, first long, ids string")
    pieces = pieces.repartition("node_key").sortWithinPartitions("node_key", "first")
    return pieces.mapInPandas(digest, "node_key string, sha256 string")
