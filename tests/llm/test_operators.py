"""Operators on small inputs with the odd cases, against brute force."""

import hashlib
import inspect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import license_scan, quality, toxicity
from tidemark.llm.common import folds
from tidemark.llm.components import components
from tidemark.llm.elias_fano import EliasFano, Trie, blend
from tidemark.llm.exact_dedup import exact_dedup, keep_one
from tidemark.llm.lm_score import DISCOUNTS, lm_score
from tidemark.llm.nearest import search
from tidemark.llm.packing import evolve, pack
from tidemark.llm.sentencepiece_codec import Codec, encode_decode
from tidemark.llm.simhash_dedup import fingerprint, simhash_classes, spanning, trie_links
from tidemark.llm.token_counts import LongestMatch, token_counts, vocabulary

SCHEMA = "doc_id long, text string, keep_id string, n long, words int"
BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "a", "A  b", " lead and trail ", "line\nbreak\ttab", "É é 日本 🎉", "x" * 400, "one two three four five " * 300]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, nulls, ties, a repeated row and extra columns with names the operators use."""
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(ODD)]
    rows += [(20, "Same Text here", "x", 1, 2), (21, "same text HERE", "x", 1, 2), (21, "same text HERE", "x", 1, 2)]
    rows += [(None, "no id", None, None, None), (30, None, "y", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(docs, empty):
    rows = collected(exact_dedup(docs))
    assert len(rows) == docs.count()
    same = [r for r in rows if r["doc_id"] in (20, 21)]
    assert {(r["keep_id"], r["group_size"]) for r in same} == {(21, 3)}
    assert sorted((r["doc_id"], r["kept"]) for r in same) == [(20, False), (21, False), (21, True)]
    blank = [r for r in rows if r["doc_id"] in (0, 30)]
    assert {(r["keep_id"], r["group_size"]) for r in blank} == {(30, 2)}
    assert exact_dedup(empty).count() == 0


def test_exact_dedup_compares_contents_of_equal_digests(docs):
    weak = exact_dedup(docs, digest=lambda c: F.unhex(F.lit("00")))
    strong = exact_dedup(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, weak.select(*columns).collect())) == sorted(map(str, strong.select(*columns).collect()))


def test_exact_dedup_keeps_whole_rows(docs):
    kept = collected(keep_one(docs))
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["None", "21", "30", *map(str, range(1, len(ODD)))])
    assert set(kept[0]) == set(docs.columns)


def test_packing_is_gapless_and_cuts_only_long_documents(docs, empty):
    rows = collected(pack(docs, BYTE_BPE, length=64, shard_size=4))
    reference = Tokenizer.from_file(BYTE_BPE)
    texts = [*ODD, "Same Text here", "same text HERE", "same text HERE", "no id", ""]
    ids = [[*reference.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    longest = ids[len(ODD) - 1]
    parts = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == len(ODD) - 1)
    assert [p[2] for p in parts][1:] == [64] * (len(parts) - 1)
    assert [p[3] for p in parts] == [zlib.crc32(np.array(longest[s : s + n], "<u4").tobytes()) for _, s, n, _ in parts]
    for sequence in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert pack(empty, BYTE_BPE).count() == 0


def test_nearest_neighbours_have_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[50:150] = vectors[50]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collected(search(df, F.col("vec_id") % 100 == 0, block=50))
    x, hits = vectors.astype(float), 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(r["score"] == d[r["vec_id"]] for r in got)
        hits += len({r["vec_id"] for r in got} & set(order))
    assert hits >= 54
    assert {r["query_id"] for r in found} == set(range(0, 600, 100))
    assert search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_license_scan_finds_whole_and_slightly_changed_notices(spark, empty):
    text = license_scan.TEMPLATES["GPL"].replace("free software", "open software")
    rows = [(1, "word " * 50 + license_scan.TEMPLATES["MIT-notice"]), (2, text), (3, "license software " * 9), (4, None), (5, "")]
    found = {(r["doc_id"], r["license"]): r["containment"] for r in collected(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert found[(1, "MIT-notice")] == 1.0
    assert 0.8 <= found[(2, "GPL")] < 1.0
    assert set(found) == {(1, "MIT-notice"), (2, "GPL")}
    assert license_scan.license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_sizes({"short": "two words"})


def test_sentencepiece_round_trip_equals_library(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in collected(encode_decode(docs, PIECES)):
        if r["doc_id"] is not None and r["doc_id"] < len(ODD):
            expected = library.encode(ODD[r["doc_id"]], add_bos=True, add_eos=True)
            assert np.frombuffer(r["ids"], "<u4").tolist() == expected
            assert (r["n_tokens"], r["decoded"]) == (len(expected), library.decode(expected))
    digest = collected(encode_decode(docs.filter("doc_id = 30"), PIECES, digest=True))
    assert digest[0]["ids_sha256"] == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest()
    assert encode_decode(empty, PIECES).count() == 0


def test_agenda_equals_library_on_random_words():
    codec, rng = Codec(PIECES), random.Random(4)
    texts = ["".join(rng.choice("abcehinorst é日\t▁-.") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    codec.encode(texts)
    assert codec.compared > 500 and codec.differing == 0


def test_lm_base_score_and_counts(docs, empty):
    rows = collected(lm_score(docs, F.coalesce(F.col("doc_id") % 3 == 2, F.lit(False))))
    texts = [(r["doc_id"], [*lowered(r["text"]).split(), "\n"]) for r in collected(docs)]
    texts = [(i, [w for w in t]) for i, t in texts]
    train = [w for i, t in texts if i is None or i % 3 != 2 for w in t]
    total, kinds = len(train), len(set(train))
    assert len(rows) == len(texts) and {r["train_tokens"] for r in rows} == {total}
    by_id = {i: t for i, t in texts}
    for r in rows:
        tokens = by_id[r["doc_id"]]
        base = sum(np.log10((train.count(w) + 1) / (total + kinds + 1)) for w in tokens)
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(w in train for w in tokens))
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    assert lm_score(empty, F.lit(False)).count() == 0


def test_trie_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    x, u, w = rng.integers(0, 5, 4000), rng.integers(0, 7, 4000), (rng.random(4000) ** 2 * 40).astype(np.int64)
    trie, words = Trie(x, u, w, 40, DISCOUNTS), np.arange(40)
    for context, before in ((0, 3), (4, 6), (9, 9)):
        found = trie.locate(np.full(40, context), np.full(40, before), words)
        assert blend(np.full(40, 1 / 40), *trie.codes(*found)).sum() == pytest.approx(1, abs=0.002)


def test_trie_finds_its_own_trigrams_where_they_stand():
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 5000):
        x, u, w = rng.integers(0, 300, n), rng.integers(0, 50, n), rng.integers(0, 400, n)
        trie = Trie(x, u, w, 400, DISCOUNTS)
        for own, found in zip(trie.own, trie.locate(x, u, w), strict=True):
            assert own.tolist() == found.tolist()
        assert {int(f[0]) for f in trie.locate(np.array([10**9]), np.array([0]), np.array([0]))} == {-1}


def naive_trigrams(texts, held):
    """log10 P of each text by dictionaries, with the quantised figures of the operator."""
    tokens = [["<s>", "<s>", *lowered(t).split(), "\n"] for t in texts]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    words = Counter(w for t in train for w in t[2:])
    total, kinds = sum(words.values()), len(words)
    levels = []
    for size in (2, 3):
        grams = Counter(tuple(t[k - size + 1 : k + 1]) for t in train for k in range(2, len(t)))
        contexts, after = Counter(), Counter()
        for gram, n in grams.items():
            contexts[gram[:-1]] += n
            after[gram[:-1]] += 1
        levels.append((grams, contexts, after))

    def quantised(p):
        return 10 ** (-round(-4096 * math.log10(p)) / 4096) if p > 0 else 0.0

    def probability(t, k):
        p = (words[t[k]] + 1) / (total + kinds + 1)
        for size, discount, (grams, contexts, after) in zip((2, 3), DISCOUNTS, levels, strict=True):
            gram = tuple(t[k - size + 1 : k + 1])
            n = contexts[gram[:-1]]
            if n:
                p = quantised(max(grams[gram] - discount, 0) / n) + quantised(discount * after[gram[:-1]] / n) * p
        return p

    return [sum(math.log10(probability(t, k)) for k in range(2, len(t))) for t in tokens]


def test_lm_scores_equal_a_naive_model_and_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) ** 1.3 for k in range(60)], k=rng.randint(0, 80))) for _ in range(250)]
    texts += ["of the " * 40 + "of w3 the"] * 12 + ["the of of of the unseen"] * 3
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = naive_trigrams(texts, held)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (1, 4, 16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = {r["doc_id"]: r for r in lm_score(df, folds("doc_id", 7, 2)).collect()}
            assert [rows[i]["held_out"] for i in range(len(texts))] == held
            scores = [rows[i]["score"] for i in range(len(texts))]
            assert scores == pytest.approx(expected, rel=1e-6)
            found.append(scores)
        assert found[0] == found[1] == found[2] == found[3]  # to the last bit
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_elias_fano_finds_what_it_holds():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 1), (40, 45), (500, 10**9)):
        values = np.unique(rng.integers(0, universe, n))
        held, asked = EliasFano(values, universe), rng.integers(0, universe, 300)
        place = {v: i for i, v in enumerate(values.tolist())}
        assert held.get(np.arange(len(values))).tolist() == values.tolist()
        assert held.find(asked).tolist() == [place.get(a, -1) for a in asked.tolist()]


@pytest.mark.parametrize("text", ["1D10T", "іdіоt", "ｉｄｉｏｔ", "ïdiot"])
def test_folding_undoes_disguises(text):
    assert toxicity.fold(text) == " idiot "


def test_toxicity_and_quality_learn_from_labels(spark, empty):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdefgh") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)]
        if i % 4 == 0:
            text[rng.randrange(60)] = "nastyword"
        rows.append((i, "!! ".join(text).upper() if i % 5 == 0 else " ".join(text), "src", int(i % 5 != 0), int(i % 4 == 0)))
    rows += [(900, None, "src", 1, 0), (901, "", "src", 1, 0), (901, "", "src", 1, 0), (None, "text", "src", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, quality int, toxic int")
    docs, labels = df.select("doc_id", "text", "score"), df.select("doc_id", "quality", "toxic")
    lexicon, model = toxicity.fit(docs, labels), quality.fit(docs, labels)
    toxic, good = collected(toxicity.score(docs, lexicon)), collected(quality.score(docs, model))
    assert len(toxic) == len(good) == len(rows)
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in toxic if r["doc_id"] is not None and r["doc_id"] < 400)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 != 0) for r in good if r["doc_id"] is not None and r["doc_id"] < 400)
    assert all(0 <= r["score"] <= 1 for r in toxic + good)
    disguised = spark.createDataFrame([(1, "a n4stуw0rd b")], "doc_id long, text string")
    assert toxicity.score(disguised, lexicon).first()["score"] >= 0.7
    nothing = labels.limit(0)
    assert toxicity.score(empty, toxicity.fit(docs, nothing)).count() == 0
    assert quality.score(empty, quality.fit(docs, nothing)).count() == 0


def test_exception_phrases_do_not_count():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 5.0})
    automaton = lexicon.automaton()
    assert lexicon.features("into the Trash can.", automaton)[0] == 0
    assert lexicon.features("trash", automaton)[0] == 1


def brute_fingerprint(text):
    words = lowered(text).split()
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_classes(spark, docs, empty):
    assert all(fingerprint(t) == brute_fingerprint(t) for t in ODD)
    base = [f"w{k}" for k in range(400)]
    near = [(100 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 40, 2)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = collected(simhash_classes(both, group_limit=5))
    prints = sorted({brute_fingerprint(t or "") for _, t in both.collect()})
    links = [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    root = spanning(len(prints), *(np.array(x, int) for x in (zip(*links, strict=True) if links else ((), ()))))
    group = {p: int(r) for p, r in zip(prints, root, strict=True)}
    smallest = {}
    for r in rows:
        g = group[r["print"] % 2**64]
        if r["doc_id"] is not None:
            smallest[g] = min(smallest.get(g, r["doc_id"]), r["doc_id"])
    assert len(rows) == both.count()
    assert all(r["component_id"] == smallest.get(group[r["print"] % 2**64]) for r in rows)
    assert simhash_classes(empty).count() == 0


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 2**63, 60, dtype=np.uint64)
    values = np.unique(np.concatenate([values, *(values ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(6))]))
    i, j = trie_links(values, np.zeros(len(values), np.int64), 4)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 4)
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}


def greedy(word, initial, continuing):
    count, at = 0, 0
    while at < len(word):
        pool = initial if at == 0 else continuing
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in pool), 0)
        if not size:
            return None
        count, at = count + 1, at + size
    return count


def union_find(links):
    root = {n: n for link in links for n in link}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return sorted((n, find(n)) for n in root)


def test_components_equal_union_find_on_chains_and_trees(spark):
    rng = random.Random(1)

    def chain(names):
        return list(zip(names, names[1:], strict=False))

    def tree(names):
        return [(names[k], names[rng.randrange(k)]) for k in range(1, len(names))]

    many = []
    for k in range(300):
        names = rng.sample(range(100 * k, 100 * k + 100), rng.randint(5, 20))
        many += (tree if k % 2 else chain)(names)
    # In the first one node 3 leads to the roots 1 and 2 after one step.
    graphs = [[(5, 4), (4, 3), (3, 2), (5, 1)], many, *(f(rng.sample(range(100), n)) for n in (6, 8, 10) for f in (chain, tree))]
    for links in graphs:
        found = components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
        assert sorted(map(tuple, found)) == union_find(links), links


def test_longest_match_equals_greedy(docs, empty):
    rng = random.Random(1)
    for _ in range(30):
        pool = [{"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(12)} for _ in range(2)]
        automaton = LongestMatch(*pool)
        for _ in range(100):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            expected = greedy(word, *pool)
            assert automaton.count(word) == ((1 << 40) + 1 if expected is None else expected)
    rows = collected(token_counts(docs, PIECES))
    assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 30)} == {0}
    assert token_counts(empty, PIECES).count() == 0


def greedy_with_bytes(word, pieces):
    count, at, word = 0, 0, "▁" + word
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in pieces), 0)
        count, at = count + (1 if size else len(word[at].encode())), at + max(1, size)
    return count


def test_token_counts_spell_words_without_an_initial_piece(spark):
    expected = {"1984": 5, "2024,": 6, "日本語": 4, "ñandú": 4, "😀": 2, "１２": 7, "x▁y": 2, "hello": 2}
    df = spark.createDataFrame([(k, w) for k, w in enumerate(expected)], "doc_id long, text string")
    rows = sorted(collected(token_counts(df, PIECES)), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_tokens"], r["n_unknown"]) for r in rows] == [(1, n, 0) for n in expected.values()]
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    pieces = {library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i))}
    automaton = LongestMatch(*vocabulary(PIECES))
    for _ in range(2000):
        word = "".join(rng.choice("abcehinorst019,é日本🎉１▁-.") for _ in range(rng.randint(1, 15)))
        assert automaton.count(word) == greedy_with_bytes(word, pieces), word
    # Beginnings of pieces that are no pieces themselves.
    for _ in range(30):
        pool = [{"".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(8)} for _ in range(2)]
        automaton = LongestMatch(pool[0] | {""}, pool[1], byte_fallback=True)
        pieces = {"▁" + p for p in pool[0]} | {"▁"} | pool[1]
        for _ in range(100):
            word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy_with_bytes(word, pieces)


def test_nearest_neighbours_reach_the_recall_on_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    held = {r["vec_id"]: r["embedding"] for r in table.collect()}
    ids, x = np.array(sorted(held)), np.array([held[i] for i in sorted(held)], float)
    found = {}
    for r in search(table, F.col("vec_id") % 4 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in sorted(found):
        order = [i for i in ids[np.lexsort((ids, ((x - x[np.searchsorted(ids, q)]) ** 2).sum(1)))] if i != q][:10]
        hits.append(len(found[q] & set(order)))
    assert len(found) == (ids % 4 == 0).sum()
    assert np.mean(hits) / 10 >= 0.9, np.mean(hits) / 10


@pytest.mark.parametrize("number", [11, 15])
def test_nearest_neighbours_of_few_rows_are_ten(spark, number):
    rng = np.random.default_rng(number)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(number, 8)))]
    repeated = [vectors[0]] * 3
    for rows in (vectors, vectors + repeated):
        got = collected(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)))
        assert [sum(r["query_id"] == q for r in got) for q in range(number)] == [10] * number


def test_packing_searches_by_default():
    """Sizes that fit in threes, where best fit alone wastes a fifth: the defaults, which the query and the pipeline use, must search."""
    given = {name: p.default for name, p in inspect.signature(pack).parameters.items()}
    bins = 0
    for seed in range(20):
        rng, sizes = random.Random(seed), []
        for _ in range(20):
            a = rng.randint(380, 490)
            b = rng.randint(250, (1000 - a) // 2)
            sizes += [a, b, 1000 - a - b]
        rng.shuffle(sizes)
        best = evolve(sizes, 1000, seed, None, given["population"], given["generations"])
        assert sorted(i for members in best.bins for i in members) == list(range(60))
        bins += len(best.bins)
    assert bins <= 460
