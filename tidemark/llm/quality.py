"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: measured (shares of character classes, word lengths, repeated
words) and passed through a small layer. Gated attention gives each passage a weight, learned from labels of
documents alone, and the weighted mean of the encoded passages is scored by a logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import text_slices
from tidemark.llm.labelled import training_sample

#: Bytes of a passage; passages that are measured at a time; passages of a document that the driver fits on, at most.
PASSAGE, STRETCH, FITTED = 600, 512, 64
#: Character classes, by the bytes that belong to them; what is in none is the class after the last.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:", b"!?", b"|", b"#$%&*", b"()[]{}<>", b"/\\_=+~^@", bytes(range(128, 256)))
LAGS = (1, 2, 3, 4)
WIDTH = len(CLASSES) + 1 + len(LAGS) + 3


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for k, members in enumerate(CLASSES):
        table[list(members)] = k
    return table


CLASS_OF = _class_table()
_LETTERS = np.random.default_rng(7).integers(1, 2**63, (16, 256), dtype=np.uint64).ravel()


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many passages each text has; an empty text has one of zeros.

    Every PASSAGE bytes are a passage, however long the text. A text is measured in stretches of STRETCH passages, which bounds the
    memory; a word that two stretches share is a word in both.
    """
    size = PASSAGE * STRETCH
    raw, owner = [], []
    for k, text in enumerate(texts):
        data = text.encode()
        raw += [data[at : at + size] for at in range(0, len(data), size)] or [b""]
        owner += [k] * (len(raw) - len(owner))
    features, counts, begin = [], np.zeros(len(texts), np.int64), 0
    while begin < len(raw):
        end, held = begin, 0
        while end < len(raw) and (end == begin or held + len(raw[end]) <= 2 * size):
            held, end = held + len(raw[end]), end + 1
        found, numbers = _measure(raw[begin:end])
        features.append(found)
        np.add.at(counts, owner[begin:end], numbers)
        begin = end
    return np.concatenate(features) if features else np.zeros((0, WIDTH)), counts


def _measure(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([max(1, len(r)) for r in raw], np.int64)
    data = np.frombuffer(b"".join(r or b" " for r in raw), np.uint8)
    counts = -(-sizes // PASSAGE)
    doc_start = np.cumsum(sizes) - sizes
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(doc_start, counts) + inner * PASSAGE
    n, width = len(starts), len(CLASSES) + 1
    length = np.diff(np.append(starts, len(data)))
    kind = CLASS_OF[data]
    passage = np.repeat(np.arange(n), length)
    shares = np.bincount(passage * width + kind, minlength=n * width).reshape(n, width) / length[:, None]
    word = kind != 3
    begins = word & np.append(True, ~word[:-1])
    begins[doc_start] = word[doc_start]
    first = np.flatnonzero(begins)
    features = np.zeros((n, WIDTH))
    features[:, :width] = shares
    if len(first):
        index = np.cumsum(begins) - 1
        place = np.arange(len(data)) - first[np.maximum(index, 0)]
        digest = np.where(word, _LETTERS[(place & 15) * 256 + data], np.uint64(0))
        digest = np.add.reduceat(digest, first)
        letters = np.add.reduceat(word.astype(np.int64), first)
        at = passage[first]
        words = np.bincount(at, minlength=n)
        for k, lag in enumerate(LAGS):
            again = np.zeros(len(first))
            again[lag:] = (digest[lag:] == digest[:-lag]) & (at[lag:] == at[:-lag])
            features[:, width + k] = np.bincount(at, again, minlength=n) / np.maximum(words, 1)
        mean = np.bincount(at, letters, minlength=n) / np.maximum(words, 1)
        features[:, -3], features[:, -2] = np.log1p(mean), words / length
    features[:, -1] = np.log(length)
    features[np.repeat([not r for r in raw], counts)] = 0
    return features, counts


class Attention:
    """Encoder, gated attention and output unit; parameters as a dictionary of arrays."""

    def __init__(self, hidden: int = 16, gates: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {
            "W": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden),
            "V": rng.normal(0, hidden**-0.5, (hidden, gates)), "U": rng.normal(0, hidden**-0.5, (hidden, gates)),
            "w": rng.normal(0, gates**-0.5, gates), "o": np.zeros(hidden), "c": np.zeros(1),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, start = self.p, np.cumsum(counts) - counts
        h = np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["o"] + p["c"])))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y, "bag": bag}

    def gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, decay: float) -> dict:
        p, f = self.p, self.forward(x, counts)
        h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
        d = (f["y"] - label) / len(label)
        dz = d[:, None] * p["o"]
        pull = (dz[bag] * h).sum(1)
        de = a * (pull - (dz * f["z"]).sum(1)[bag])
        dts = de[:, None] * p["w"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        g = {
            "o": f["z"].T @ d, "c": np.array([d.sum()]), "w": (t * s).T @ de, "V": h.T @ dt, "U": h.T @ ds,
            "W": ((x - self.mean) / self.scale).clip(-8, 8).T @ dh, "b": dh.sum(0),
        }
        return {k: v + decay * self.p[k] for k, v in g.items()}

    def fit(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Full-batch Adam."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for turn in range(1, steps + 1):
            for k, g in self.gradients(x, counts, label, decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, fold_out: tuple[int, int] = (5, 0), fit_rows: int = 6000) -> Attention:
    """Learn from at most `fit_rows` labelled documents outside the fold.

    What comes to the driver are the features of their passages: at most FITTED rows of WIDTH numbers for each of them, taken evenly
    from longer documents. Scoring takes all passages.
    With labels of one class only, or none, every score is that class's, or 0.5.
    """
    sample = training_sample(docs, labels, "quality", fold_out, fit_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            features, counts = measure(texts)
            rows = np.split(features.astype(np.float32), np.cumsum(counts)[:-1])
            rows = [r if len(r) <= FITTED else r[np.linspace(0, len(r) - 1, FITTED).round().astype(int)] for r in rows]
            yield pa.RecordBatch.from_pydict(
                {"bag": pa.array([r.tobytes() for r in rows], pa.binary()), "label": part.column(1).cast(pa.int32())}
            )

    rows: pd.DataFrame = sample.mapInArrow(extract, "bag binary, label int").toPandas()
    model = Attention()
    if rows["label"].nunique() < 2:
        model.p["c"][:] = 0 if rows.empty else 8 if rows["label"].iloc[0] == 1 else -8
        return model
    rows = rows.sort_values("bag")  # the result does not depend on the order of arrival
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["bag"]]
    model.fit(np.concatenate(bags).astype(float), np.array(list(map(len, bags))), rows["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Attention, column: str = "score", text_column: str = "text") -> DataFrame:
    """The rows with the probability of good quality in `column`, 0 to 1.

    Null and empty texts have one passage without features. All columns and rows are kept as they are, repeated rows and
    null ids too; a column of the name `column` is replaced. An empty table stays empty.
    """
    rest = docs.drop(column) if column in docs.columns else docs
    schema = T.StructType([*rest.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_column, 1_000_000):
            scores = model.forward(*measure(texts))["y"]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, column])

    return rest.mapInArrow(run, schema)
