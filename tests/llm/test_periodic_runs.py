"""Periodic runs against trying every period."""

import random
import time

import numpy as np
import pytest

from tidemark.llm.periodic_runs import Pairs, _same_stretch, longest, periodic_runs, runs
from tidemark.llm.queries import with_periodic_tail


def brute(words, shortest=24, repeats=3):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 10 else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        for i in range(a, min(n, a + rng.randint(1, 6) * p)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize(("shortest", "repeats"), [(24, 3), (2, 2), (4, 2), (6, 3), (10, 4)])
def test_runs_of_random_documents(shortest, repeats):
    rng = random.Random(shortest)
    for _ in range(300):
        docs = [random_words(rng, rng.choice([0, 5, 30, 80, 200]), rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 4))]
        expected, begin = [], 0
        for d in docs:
            expected += [[s + begin, n, q] for s, n, q in brute(d, shortest, repeats)]
            begin += len(d)
        words = np.array([w for d in docs for w in d], np.int64)
        assert runs(words, np.array([len(d) for d in docs], np.int64), shortest, repeats).tolist() == expected


def test_own_class_is_skipped_in_steps_of_doubling_size():
    order, own = list(range(100)), [*range(20, 70), 90]
    assert _same_stretch(order, 20, own, 20, 1) == 50
    assert _same_stretch(order, 69, own, 69, -1) == 50
    assert _same_stretch(order, 90, own, 90, 1) == _same_stretch(order, 90, own, 90, -1) == 1
    assert _same_stretch(own, 50, own, 90, -1) == 51


def test_long_documents_take_no_quadratic_time():
    begin = time.perf_counter()
    line = [x for k in range(5000) for x in (100 + k, *range(40))]  # 5,000 places that share 40 words, all preceded by others
    for words, number in (([1] * 200_000, 1), ([k % 7 for k in range(200_000)], 1), (line, 0)):
        assert len(runs(np.array(words, np.int64), np.array([len(words)]))) == number
    assert time.perf_counter() - begin < 60


def test_pairs_of_one_word_are_few(monkeypatch):
    seen = []
    inner = Pairs.walk
    monkeypatch.setattr(Pairs, "walk", lambda self, *given: (inner(self, *given), seen.append(len(self.found))))
    runs(np.ones(3000, np.int64), np.array([3000]))
    assert seen == [1000]  # of the 1.5 million pairs within the distance the left-maximal ones: (0, 1), (0, 2), ...


def test_documents_with_odd_texts(spark):
    unit = "a b c d e f g h"
    texts = {
        1: f"x {unit} {unit} {unit} y", 2: " ".join(["da"] * 30), 3: None, 4: "", 5: f"\t{unit}\n{unit}\x0b{unit} {unit} z ",
        6: "é 日本 " * 15, 7: "no run here",
    }
    rows = [(i, t, "n", 7, 9) for i, t in texts.items()] + [(2, texts[2], "n", 7, 9), (None, texts[2], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs int, n_words int")
    got = periodic_runs(df).withColumn("best", longest()).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"], r["n_words"]) for r in got}
    assert by_id[1] == ([(1, 24, 8)], f"x {unit} y", 26)
    assert by_id[2] == by_id[None] == ([(0, 30, 1)], "da", 30)
    assert by_id[3] == by_id[4] == ([], "", 0)
    assert by_id[5] == ([(0, 31, 8)], f"{unit} h z", 32)  # a no-break space is part of a word
    assert by_id[6] == ([(0, 30, 2)], "é 日本", 30)
    assert by_id[7] == ([], "no run here", 3)
    assert {r["doc_id"]: r["best"] and tuple(r["best"]) for r in got}[1] == (1, 24, 8)
    assert sum(r["doc_id"] == 2 for r in got) == 2
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, repeats=1)


def test_longest_compares_exactly_and_takes_the_first_of_equals(spark):
    lists = [[(0, 30, 10), (5, 31, 10), (40, 62, 20)], [(0, 10**9 + 1, 10**9), (1, 10**9, 10**9 - 1)], []]
    df = spark.createDataFrame([(x,) for x in lists], "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    best = [r["best"] and tuple(r["best"]) for r in df.select(longest().alias("best")).collect()]
    assert best == [(5, 31, 10), (1, 10**9, 10**9 - 1), None]


def test_periodic_tails_of_a_tenth(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b c"), (7, None)]
    import zlib

    for r in with_periodic_tail(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r["doc_id"] is None or r["text"] is None:
            continue
        words, h = [f"w{k}" for k in range(r["doc_id"] % 40)], zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r["text"] == " ".join(words)
