"""The prefix trie of conversations against dictionaries of prefixes."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import prefix_trie as tries
from tidemark.llm.prefix_trie import Parentheses, ids_sha256, members, prefix_trie, range_minima, turn_paths

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]


def random_depths(rng, n):
    depth = [0]
    while len(depth) < n:
        depth.append(rng.randint(1, depth[-1] + 1) if rng.random() < 0.6 else depth[-1] + 1)
    return np.array(depth)


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 500, 3000])
def test_parentheses_close_where_a_stack_closes_them(n):
    rng = random.Random(n)
    for depth in (random_depths(rng, n), np.arange(n), np.minimum(np.arange(n), 1)):
        shape, stack, close, text = Parentheses(depth), [], np.zeros(n, int), []
        for node, d in enumerate([*depth.tolist(), 0]):
            while len(stack) > d:
                close[stack.pop()] = len(text)
                text.append(0)
            if node < n:
                stack.append(node)
                text.append(1)
        assert shape.findclose().tolist() == close.tolist()
        ends = [next((j for j in range(k + 1, n) if depth[j] <= depth[k]), n) for k in range(min(n, 600))]
        assert shape.subtrees()[:600].tolist() == ends
        assert shape.leaves()[:600].tolist() == [e == k + 1 for k, e in enumerate(ends)]
        assert [int(shape.bit(np.array([k]))[0]) for k in range(min(len(text), 200))] == text[:200]


def test_range_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 200)
    begin = rng.integers(0, 199, 300)
    end = begin + 1 + rng.integers(0, 200 - begin)
    assert range_minima(values, begin, end).tolist() == [values[a:b].min() for a, b in zip(begin, end, strict=True)]


def brute(turns):
    """Rows of the trie of {conversation: [(digest, words)]}, by dictionaries."""
    nodes = {}
    for c, path in turns.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, who in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * p[-1][1] if p else 0
    return sorted(
        (min(who), len(p), min(nodes[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p], sum(len(turns[c]) == len(p) for c in who))
        for p, who in nodes.items()
    )


def frame(spark, turns):
    rows = [(c, [(hashlib.sha256(str(t).encode()).hexdigest()[:32], w) for t, w in path]) for c, path in turns.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<digest:string,words:bigint>>")


def by_none(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("shard", "spines", "parts"), [(200_000, 8, 3), (40, 4, 5), (1, 6, 3)])
def test_equals_dictionaries_in_any_shards(spark, monkeypatch, shard, spines, parts):
    monkeypatch.setattr(tries, "SHARD_TURNS", shard)
    monkeypatch.setattr(tries, "SHARD_SPINES", spines)
    # Workers import the module anew: the limits go with the function.
    monkeypatch.setattr(tries, "_fold", lambda level, final: limited(level, final, shard, spines))
    rng = random.Random(shard)
    turns = {}
    for c in rng.sample(range(-50, 1000), 200):
        path = [(rng.randrange(3), 4) for _ in range(rng.choice([0, 1, 2, 3, 6]))]
        turns[c] = [(str(path[: k + 1]), len(path[0:k])) for k in range(len(path))]
    hot = [("hot", 7), ("hotter", 5), ("hottest", 3)]
    turns |= {c: hot[: 3 - (c % 10 == 0)] for c in range(2000, 2150)}  # a large group of copies
    turns[3000] = [(f"deep{k}", k % 5) for k in range(300)]
    turns[3001] = turns[3000][:250] + [("other", 2)]
    got = [tuple(r) for r in prefix_trie(frame(spark, turns), parts).select(*COLUMNS).collect()]
    assert by_none(got) == by_none(brute(turns))


def limited(level, final, shard, spines):
    def run(batches):
        from tidemark.llm import prefix_trie as there

        there.SHARD_TURNS, there.SHARD_SPINES = shard, spines
        return there._fold(level, final)(batches)

    return run


def test_turns_odd_cases(spark):
    rows = [
        (1, 1, "user", "b c", "x"), (1, None, "system", "a", "x"), (1, 2, None, None, "x"), (2, None, "system", "a", "x"), (2, 1, "user", "b c", "x"),
        (2, 2, "", "", "x"), (3, 0, "a", ":b", "x"), (4, 0, "a:", "b", "x"), (None, 0, "u", "t", "x"), (5, 1, "u", "w " * 50_000, None), (5, 1, "u", "w " * 50_000, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, words string")
    got = {r["conv_id"]: [(t["digest"], t["words"]) for t in r["turns"]] for r in turn_paths(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1] == got[2] and [w for _, w in got[1]] == [1, 2, 0]
    assert got[3] != got[4]  # role and text are told apart
    assert got[5] == [got[5][0]] * 2 and got[5][0][1] == 50_000
    assert turn_paths(df.limit(0)).count() == 0
    assert prefix_trie(turn_paths(df.limit(0))).count() == 0
    trie = [tuple(r) for r in prefix_trie(turn_paths(df)).select(*COLUMNS).collect()]
    assert by_none(trie) == by_none(brute(got))


def test_ids_of_a_node_are_digested_in_order(spark, monkeypatch):
    turns = {c: [("same", 1)] for c in range(5000)} | {7000: [], 7001: [("same", 1), ("more", 2)]}
    keys = {r["node_key"]: r["sha256"] for r in ids_sha256(members(frame(spark, turns))).collect()}
    lists = [range(5000), [7000], [7001]]
    assert sorted(keys.values()) == sorted(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in lists)
    ended = [r["node_key"] for r in prefix_trie(frame(spark, turns)).filter("n_ends > 0").collect()]
    assert sorted(ended) == sorted(keys)
