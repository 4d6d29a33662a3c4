"""SentencePiece encoding and decoding for merge-type vocabularies by a score-ordered agenda of symbol pairs.

The agenda of a word holds its adjacent symbol pairs that form a piece. The pair of the best score, leftmost on ties, is
merged, and its two new neighbour pairs enter the agenda. Short words are worked on many at a time, each with its agenda
as a row of a matrix; longer ones with a heap. Results are remembered per word, and each new word is compared with the
sentencepiece library once; where they differ the library's answer holds and is counted.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LONG_WORD, record_batch, text_slices

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]*")
_SHARED: dict = {}
#: Longest word, in characters, that the matrix takes.
ROW = 24


def _key(word: str) -> str:
    """How a word is remembered: without its leading space, since nearly every word has just one."""
    if not word.startswith(SPACE):
        return word + SPACE
    return word if SPACE in word[1:] else word[1:]


def _word(key: str) -> str:
    if SPACE not in key:
        return SPACE + key
    return key if key.startswith(SPACE) else key[:-1]


class Codec:
    """Encoder and decoder of one model file.

    A text is cut before each run of spaces, and every part is encoded alone. This is exact if no piece of
    the vocabulary has a space after another character; for other vocabularies the whole text is one part.
    """

    def __init__(self, path: str, remember: int = 600_000):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        normal = [i for i in range(size) if not special[i]]
        self.ids_of = {self.pieces[i]: i for i in normal}
        self.scores = np.full(size + 1, -np.inf)
        self.scores[normal] = [lib.get_score(i) for i in normal]
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.splits = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal)
        plain = self.splits and not any(lib.is_unused(i) for i in range(size)) and len(self.bytes_of) == 256
        self.own = plain  # unused pieces are split again by the library; then only the library is asked
        self.memo: dict[str, bytes] = {}
        self.long: list[str] = []  # words that are forgotten after a batch
        self.remember, self.compared, self.differing = remember, 0, 0
        self._pair_table()
        # By decreasing score, equal scores alike; the last entry is for no piece.
        self.rank = np.append(np.unique(np.where(np.isfinite(self.scores), self.scores, 0), return_inverse=True)[1][:-1], -1).astype(np.int32)
        code = np.arange(0x110000, dtype=np.int32)
        self.char_ids = -2 - code
        self.char_ids[0] = -1
        for piece, i in self.ids_of.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        self.raw = [b"" if special[i] else self.pieces[i].replace(SPACE, " ").encode() for i in range(size)]
        for byte, i in self.bytes_of.items():
            self.raw[i] = bytes([byte])

    @classmethod
    def shared(cls, path: str) -> Codec:
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def _pair_table(self) -> None:
        """Sorted (left id, right id) keys of all pairs of pieces that form a piece."""
        keys, merged = [], []
        for piece, i in self.ids_of.items():
            for cut in range(1, len(piece)):
                left, right = self.ids_of.get(piece[:cut]), self.ids_of.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        order = np.argsort(keys)
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[order], 0)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank by score (-1 for none) and id of what each pair of ids forms."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        ids = np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)
        return self.rank[ids], ids

    def _agenda(self, word: str) -> list[str]:
        """The pieces of a word of any length: a heap of pairs over a linked list of symbols."""
        symbols = list(word)
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (i := self.ids_of.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(heap, (-self.scores[i], left, right, len(symbols[left]) + len(symbols[right])))

        for k in range(len(symbols) - 1):
            propose(k, k + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        return [s for s in symbols if s]

    def _matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words, a left-aligned row each, and the row lengths; a character without a piece is -2 - code."""
        n, width = len(words), max(map(len, words))
        symbol = self.char_ids[np.array(words, f"<U{width}").view("<u4").reshape(n, width)]
        length = np.array(list(map(len, words)))
        rank, form = np.full((n, width), -1, np.int32), np.full((n, width), -1, np.int32)
        if width > 1:
            rank[:, :-1], form[:, :-1] = self._pairs(symbol[:, :-1], symbol[:, 1:])
        done = np.full((n, width), -1, np.int32)
        rows, column = np.arange(n), np.arange(width)
        while len(rows):
            best = rank.argmax(1)
            each = np.arange(len(rows))
            more = rank[each, best] >= 0
            if not more.all():  # these rows' agendas are empty
                done[rows[~more]] = symbol[~more]
                rows, best, symbol, rank, form = (x[more] for x in (rows, best, symbol, rank, form))
                each = each[: len(rows)]
                if not len(rows):
                    break
            length[rows] -= 1
            symbol[each, best] = form[each, best]
            shift = np.minimum(column + (column > best[:, None]), width - 1)
            symbol, rank, form = (np.take_along_axis(x, shift, 1) for x in (symbol, rank, form))
            last = length[rows]
            symbol[column >= last[:, None]] = -1
            for left in (best - 1, best):
                at = np.maximum(left, 0)
                value, what = self._pairs(symbol[each, at], symbol[each, np.minimum(at + 1, width - 1)])
                ok = (left >= 0) & (left + 1 < last)
                put = left >= 0
                rank[each[put], at[put]] = np.where(ok, value, -1)[put]
                form[each[put], at[put]] = what[put]
        return done, length

    def _fall_back(self, symbol: str) -> list[int]:
        return [self.bytes_of[b] for b in symbol.encode()]

    def _new_words(self, keys: list[str]) -> None:
        words = list(map(_word, keys))
        if len(self.memo) + len(words) > self.remember:
            self.memo.clear()
        found: dict[str, list[int]] = {}
        for word in words:
            if len(word) > ROW or "\0" in word:
                ids = []
                for s in self._agenda(word):
                    i = self.ids_of.get(s)
                    ids += self._fall_back(s) if i is None else [i]
                found[word] = ids
        short = sorted((w for w in words if 0 < len(w) <= ROW and "\0" not in w), key=len)
        for start in range(0, len(short), 20_000):
            block = short[start : start + 20_000]
            symbol, length = self._matrix(block)
            flat = symbol[np.arange(symbol.shape[1]) < length[:, None]].tolist()
            begin = 0
            for word, end in zip(block, np.cumsum(length).tolist(), strict=True):
                ids = flat[begin:end]
                if min(ids) < 0:
                    ids = [j for i in ids for j in ([i] if i >= 0 else self._fall_back(chr(-2 - i)))]
                found[word], begin = ids, end
        # The library puts its own space before a text; a word that begins with one is asked without it.
        asked = [w for w in found if w.startswith(SPACE) and w != SPACE]
        answers = self.library.encode([w[1:] for w in asked], num_threads=1)
        self.compared += len(asked)
        for word, answer in zip(asked, answers, strict=True):
            if found[word] != answer:
                self.differing += 1
                found[word] = answer
        for word, ids in found.items():
            self.memo[_key(word)] = array("I", ids).tobytes()
            if len(word) > LONG_WORD:
                self.long.append(_key(word))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        if not self.own:
            return [np.array(x, "<u4").tobytes() for x in self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]
        parts = []
        for text in self.library.normalize(texts):
            if SPACE * 2 in text or not text.startswith(SPACE):
                parts.append([_key(w) for w in _WORD.findall(text) if w])
            else:
                parts.append(text.split(SPACE)[1:])
        new = set().union(*parts)
        missing = new - self.memo.keys()
        if missing:
            self._new_words(list(missing if len(self.memo) + len(missing) <= self.remember else new))
        encoded = [begin + b"".join(map(self.memo.__getitem__, words)) + end for words in parts]
        for word in self.long:
            self.memo.pop(word, None)
        self.long.clear()
        return encoded

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids in UTF-8, as the library decodes them."""
        listed = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.raw.__getitem__, listed))
        try:
            raw.decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8
            return self.library.decode(listed).encode()
        return raw[1:] if raw.startswith(b" ") and self.own else raw if self.own else self.library.decode(listed).encode()


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]
)


def encode_decode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False):
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text.

    With `digest` the last two are their SHA-256 as hexadecimal text, which keeps long texts out of the result. A null text
    counts as empty and has the begin and end ids only. Null ids and repeated rows are encoded like others; other columns
    are not read; an empty table gives no rows.
    """
    schema = SCHEMA if not digest else pa.schema([*list(SCHEMA)[:2], ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.shared(model)
        for part, texts in text_slices(batches):
            ids = codec.encode(texts)
            decoded = list(map(codec.decode, ids))
            counts = [len(i) // 4 for i in ids]
            if digest:
                ids = [hashlib.sha256(i).hexdigest() for i in ids]
                decoded = [hashlib.sha256(t).hexdigest() for t in decoded]
            else:
                decoded = [t.decode() for t in decoded]
            yield record_batch(schema, part.column(0), counts, ids, decoded)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, ddl)
