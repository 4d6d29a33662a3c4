"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded texts.

Folding undoes disguises: compatibility forms and accents, look-alike letters of other scripts, digits and signs that
stand for letters. What can stand for several letters (1, l, i, |) folds to one of them, in lexicon and text alike. The
lexicon is learned from labels: whole words and beginnings of words that are much more frequent in toxic texts, each
weighted by its log odds. Matches inside an exception phrase do not count. The matched weight is taken per 1,000
words, and a logistic function of that density and of there being a match at all gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import record_batch, text_slices
from tidemark.llm.labelled import training_sample

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ø": "o", "ł": "l", "đ": "d", "ħ": "h",
}
#: Digits and signs that stand for letters; 1, l, i and | are one class.
SUBSTITUTES = {
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "@": "a", "$": "s", "!": "i", "|": "i",
}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "clown loach", "pathetic fallacy")
_SIGNS = re.compile(r"(?<=\w)[@$!|]+(?=\w)")
_GAPS = re.compile(r"[\W_]+")


def _folding() -> dict[int, str]:
    table = {}
    for code in range(0xC0, 0x250):  # accented Latin letters to their base letter
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isalpha():
            table[code] = base.lower()
    table |= {ord(a): b for a, b in HOMOGLYPHS.items()}
    table = {code: SUBSTITUTES.get(letter, letter) for code, letter in table.items()}
    return table | {ord(a): b for a, b in SUBSTITUTES.items() if a.isalnum()}


FOLDING = _folding()


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(sign in text for sign in "@$!|"):
        text = _SIGNS.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), text)
    return f" {_GAPS.sub(' ', text.translate(FOLDING)).strip()} "


def terms(folded: str, shortest: int = 4, longest: int = 8) -> set[str]:
    """Words (" word ") and beginnings of words (" wor")."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(" " + word[:k] for k in range(shortest, min(longest, len(word)) + 1))
    return out


class Lexicon:
    """Weighted terms, exception phrases and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions = weights, tuple(fold(e) for e in exceptions)
        self.coefficients = np.array([-8.0, 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found

    def features(self, text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
        """(is there a match, log of the matched weight per 1,000 words)."""
        folded = fold(text)
        hits = [(end - size + 1, end, weight) for end, (size, weight) in automaton.iter(folded)] if len(automaton) else []
        safe = sorted((start, end) for start, end, weight in hits if weight is None)
        starts, reach = [s for s, _ in safe], list(accumulate((e for _, e in safe), max))
        total = 0.0
        for start, end, weight in hits:
            if weight is not None:
                before = bisect_right(starts, start)  # exceptions that begin early enough; one has to reach the end
                total += 0 if before and reach[before - 1] >= end else weight
        words = max(1, folded.count(" ") - 1)
        return float(total > 0), float(np.log1p(1000 * total / words))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.coefficients[0] + features @ self.coefficients[1:])))


def _counts(sample: DataFrame, label: int, only: set[str] | None, at_least: int) -> Counter:
    """In how many texts of the label each term occurs, for terms in at least so many texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(fold(text))
                seen.update(found if only is None else found & only)
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": pa.array(list(seen.values()), pa.int64())})

    rows = sample.filter(F.col("label") == label).select("text").mapInArrow(count, "term string, n long")
    rows = rows.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)
    return Counter(dict(rows.toPandas().itertuples(index=False)))


def select_terms(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least_odds: float, precision: float) -> dict[str, float]:
    """Terms with log odds of at least `least_odds`, a share of `precision` of whose texts is toxic.

    Of a term and its extension with the same counts the extension is taken; otherwise the shorter term covers both.
    """
    weight = {t: np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean[t] + 0.5) / (n_clean + 1)) for t, n in toxic.items()}
    good = {t for t, w in weight.items() if w >= least_odds and toxic[t] >= precision * (toxic[t] + clean[t])}
    stretched = {t[:-1] for t in good if toxic[t[:-1]] == toxic[t] and clean[t[:-1]] == clean[t]}
    chosen: dict[str, float] = {}
    for term in sorted(good - stretched, key=lambda t: (len(t), t)):
        if not any(term[:k] in chosen for k in range(2, len(term))):
            chosen[term] = float(weight[term])
    return chosen


def fit(
    docs: DataFrame, labels: DataFrame, fold_out: tuple[int, int] = (3, 1), fit_rows: int = 20_000, support: float = 0.01, least_odds: float = 3.0, precision: float = 0.9,
) -> Lexicon:
    """Learn lexicon and coefficients from at most `fit_rows` labelled documents outside the fold.

    Terms have to occur in a share of `support` of the toxic texts. Without toxic labels the lexicon is empty, and
    every score is near 0.
    """
    sample = training_sample(docs, labels, "toxic", fold_out, fit_rows)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic:
        return Lexicon({})
    toxic = _counts(sample, 1, None, max(3, int(support * n_toxic)))
    clean = _counts(sample, 0, set(toxic), 1)
    lexicon = Lexicon(select_terms(toxic, clean, n_toxic, n_clean, least_odds, precision))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part, texts in text_slices(batches):
            a, b = zip(*(lexicon.features(t, automaton) for t in texts), strict=True)
            yield pa.RecordBatch.from_pydict({"a": list(a), "b": list(b), "label": part.column(1)})

    seen = sample.select("text", "label").mapInArrow(measure, "a double, b double, label int").toPandas()
    x, y = np.column_stack([np.ones(len(seen)), seen[["a", "b"]]]), seen["label"].to_numpy(float)
    beta = np.zeros(3)
    for _ in range(25):  # Newton steps of a ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (y - p) - 0.1 * beta
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), slope)
    lexicon.coefficients = beta
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, column: str = "score", text_column: str = "text") -> DataFrame:
    """The rows with their toxicity in `column`, 0 to 1.

    Null and empty texts match nothing and get the score of a text without matches. All columns and rows are kept as they
    are, repeated rows and null ids too; a column of the name `column` is replaced. An empty table stays empty.
    """
    rest = docs.drop(column) if column in docs.columns else docs
    schema = T.StructType([*rest.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for part, texts in text_slices(batches, text_column):
            scores = lexicon.score(np.array([lexicon.features(t, automaton) for t in texts]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, column])

    return rest.mapInArrow(run, schema)
