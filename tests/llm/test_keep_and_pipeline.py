"""What stays of groups of copies, long texts, and the pipeline stage by stage, against brute force."""

import math
import random
import time

import ahocorasick
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import exact_dedup, quality, simhash_dedup, toxicity
from tidemark.llm.common import Memo, table
from tidemark.llm.packing import pack
from tidemark.llm.sentencepiece_codec import Codec
from tidemark.llm.simhash_dedup import fingerprint, spanning
from tidemark.llm.token_counts import LongestMatch, vocabulary

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def kept_exact(rows):
    """(id, text) that stay: the largest id of each lower-cased text, null only if there is no other."""
    best = {}
    for i, t in rows:
        key = lowered(t)
        if key not in best or (i is not None and (best[key][0] is None or i > best[key][0])):
            best[key] = (i, t)
    return sorted(((i, lowered(t)) for i, t in best.values()), key=repr)


def kept_near(rows, budget=4):
    prints = sorted({fingerprint(t or "") for _, t in rows})
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= budget]
    root = dict(zip(prints, spanning(len(prints), *(np.array(x, int) for x in (zip(*links, strict=True) if links else ((), ())))).tolist(), strict=True))
    best = {}
    for i, t in rows:
        p = fingerprint(t or "")
        signed = p - 2**64 if p >= 2**63 else p
        rank = (i is None, i or 0, signed)
        if root[p] not in best or rank < best[root[p]]:
            best[root[p]] = rank
    return sorted(((None if none else i, p) for none, i, p in best.values()), key=repr)


ODD = "doc_id long, text string, _id long, _digest string, digest_of_row int, kept_id string, kept_digest int, kept_print long, PRINT_OF_ROW int, times int, root int"


def odd_rows():
    base = [f"w{k}" for k in range(300)]
    near = " ".join(["changed", *base[1:]])
    pairs = [
        (1, "a b c d e f"), (None, "a b c d e f"), (None, "another text"), (None, "another text"), (5, " ".join(base)), (5, near), (7, near),
        (8, "A B c"), (9, "a b C"), (9, "a b C"), (9, "quite different words stand here"), (10, None), (11, ""), (12, "x " * 30_000),
    ]
    return [(i, t, 1, "d", 2, "k", 3, 4, 5, 6, 7) for i, t in pairs]


def test_exact_copies_with_clashing_names_and_null_ids(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ODD)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], lowered(r["text"])) for r in kept.collect()), key=repr) == kept_exact([r[:2] for r in rows])


def test_near_copies_with_clashing_names_null_ids_and_repeated_ids(spark):
    for rows in (odd_rows(), [r for r in odd_rows() if r[0] is None], [(i, t, *[None] * 9) for i, t in ((5, "p q r s t"), (5, "p q r s t"), (1, "p q r s t"), (5, "u v w"))]):
        df = spark.createDataFrame(rows, ODD)
        kept = simhash_dedup.keep_one(df)
        assert kept.columns == df.columns

        def signed(text):
            p = fingerprint(text or "")
            return p - 2**64 if p >= 2**63 else p

        got = sorted(((r["doc_id"], signed(r["text"])) for r in kept.collect()), key=repr)
        assert got == kept_near([r[:2] for r in rows])
    assert simhash_dedup.keep_one(df.limit(0)).count() == 0


def naive_score(model, features):
    """The forward pass passage by passage."""
    p = model.p
    hidden, weights = [], []
    for x in features:
        h = [math.tanh(sum(max(-8, min(8, (a - m) / s)) * w for a, m, s, w in zip(x, model.mean, model.scale, p["W"][:, k], strict=True)) + p["b"][k]) for k in range(len(p["b"]))]
        gate = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, g], strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, g], strict=True)))) for g in range(len(p["w"]))]
        hidden.append(h)
        weights.append(math.exp(sum(a * b for a, b in zip(gate, p["w"], strict=True))))
    z = [sum(a * h[k] for a, h in zip(weights, hidden, strict=True)) / sum(weights) for k in range(len(p["o"]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["o"], strict=True)) + p["c"][0])))


def test_attention_equals_a_naive_pass_and_its_gradient_a_difference():
    rng = np.random.default_rng(3)
    model = quality.Attention(hidden=5, gates=3)
    model.p["o"] = rng.normal(size=5)
    x, counts, label = rng.normal(size=(9, quality.WIDTH)), np.array([4, 1, 4]), np.array([1.0, 0.0, 1.0])
    scores = model.forward(x, counts)["y"]
    for k, (a, b) in enumerate(((0, 4), (4, 5), (5, 9))):
        assert scores[k] == pytest.approx(naive_score(model, x[a:b]))

    def loss():
        y = model.forward(x, counts)["y"]
        return -np.mean(label * np.log(y) + (1 - label) * np.log(1 - y))

    for name, gradient in model.gradients(x, counts, label, 0.0).items():
        flat, at = model.p[name].reshape(-1), rng.integers(model.p[name].size)
        before = flat[at]
        flat[at] = before + 1e-6
        high = loss()
        flat[at] = before - 1e-6
        low = loss()
        flat[at] = before
        assert gradient.reshape(-1)[at] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_a_long_text_has_all_its_passages_and_a_bad_one_counts():
    clean = "The quick brown fox jumps over the lazy dog, and then it rests. " * 32_000
    hidden = clean[:1_000_000] + "$$$$ ##### !!!! " * 60 + clean[1_000_000:]
    features, counts = quality.measure([clean, "", "short"])
    assert counts.tolist() == [-(-len(clean) // 600), 1, 1] and counts[0] > 3000
    bad = quality.measure([hidden])[0]
    model = quality.Attention()
    model.mean, model.scale = features.mean(0), features.std(0) + 1e-3
    model.p["w"] *= 40
    model.p["o"][:] = 1
    assert model.forward(bad, np.array([len(bad)]))["y"][0] != pytest.approx(model.forward(features[: counts[0]], counts[:1])["y"][0], rel=1e-6)


def naive_toxicity(lexicon, text):
    folded = toxicity.fold(text)

    def places(term):
        return [(k, k + len(term)) for k in range(len(folded)) if folded.startswith(term, k)]

    safe = [p for e in lexicon.exceptions for p in places(e)]
    total = sum(w for t, w in lexicon.weights.items() for a, b in places(t) if not any(x <= a and b <= y for x, y in safe))
    return float(total > 0), float(np.log1p(1000 * total / max(1, folded.count(" ") - 1)))


def test_toxicity_matches_equal_naive_search():
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 5.0, " tras": 2.0, toxicity.fold("idiot"): 3.0}, ("trash can", "can of trash", "village idiot"))
    automaton = lexicon.automaton()
    assert isinstance(automaton, ahocorasick.Automaton)
    for _ in range(400):
        text = " ".join(rng.choice(["trash", "can", "of", "idiot", "village", "trashy", "Tr4sh", "x"]) for _ in range(rng.randint(0, 14)))
        assert lexicon.features(text, automaton) == pytest.approx(naive_toxicity(lexicon, text)), text


def test_long_texts_take_linear_time():
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 5.0})
    automaton, begin = lexicon.automaton(), time.perf_counter()
    assert lexicon.features("trash can " * 500_000, automaton)[0] == 0
    codec, cjk = Codec(PIECES), "日本語の文章がここにある" * 100_000
    assert codec.decode(codec.encode([cjk])[0]).decode() == cjk
    assert not any(len(word) > 64 for word in codec.memo) and codec.differing == 0
    memo = Memo(LongestMatch(*vocabulary(PIECES)).count)
    assert memo["日本" * 500_000] > 0 and not memo
    assert time.perf_counter() - begin < 120


def best_fit_decreasing(sizes, length):
    free = []
    for size in sorted(sizes, reverse=True):
        fitting = [k for k, f in enumerate(free) if f >= size]
        if fitting:
            free[min(fitting, key=lambda k: free[k])] -= size
        else:
            free.append(length - size)
    return len(free)


def test_packing_of_equal_and_empty_rows_needs_no_more_than_best_fit(spark):
    rng = random.Random(6)
    texts = ["", None] * 700 + ["word " * rng.randint(1, 700) for _ in range(150)] + ["word " * 5000]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    used, sizes = {}, []
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
        sizes.append(r["length"])
    assert max(used.values()) <= 1024
    assert -(-sum(sizes) // 1024) <= len(used) <= best_fit_decreasing(sizes, 1024)


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark, SF, "documents").limit(40).selectExpr("*", "1 as quality_score", "2 as toxicity_score", "3 as _quality", "4 as label", "5 as times")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and set(kept.select("quality_score", "toxicity_score", "times").distinct().collect()) == {(1, 2, 5)}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_every_stage_of_the_pipeline(spark):
    docs = table(spark, SF, "documents")
    rows = {"in": [tuple(r) for r in docs.select("doc_id", "text").collect()]}
    names, frame = [name for name, _ in corpus_pipeline.STAGES], docs
    assert names == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    held = "in"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == docs.columns
        rows[name] = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        assert set(rows[name]) <= set(rows[held])
        held = name
    labels = table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    good = []
    for i, t in rows["in"]:
        features, counts = quality.measure([t or ""])
        if naive_score(model, features) >= corpus_pipeline.GOOD:
            good.append((i, t))
    assert sorted(rows["quality"]) == sorted(good)
    lexicon = toxicity.fit(docs, labels)
    clean = [(i, t) for i, t in good if lexicon.score(np.array([naive_toxicity(lexicon, t or "")]))[0] < corpus_pipeline.TOXIC]
    assert sorted(rows["toxicity"]) == sorted(clean)
    assert sorted(((i, lowered(t)) for i, t in rows["exact_dedup"]), key=repr) == kept_exact(clean)
    near = kept_near(rows["exact_dedup"])
    assert sorted(i for i, _ in rows["near_dedup"]) == sorted(i for i, _ in near)
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows["near_dedup"]}
