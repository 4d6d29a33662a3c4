"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for the pieces that begin a word and one for those that continue it. A node's
failure link leads to the node that greedy matching stands on after the longest pieces have been taken off the node's
text, and each node holds how many pieces that takes off. A word is read once, character by character, and the counts
are added up; no piece is built and nothing is read twice. The bare space mark is a piece, too: a word whose first character
has no piece with the mark is the mark and what continues it. With byte fallback a character without a piece counts as
its bytes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, record_batch, text_slices

START, CONTINUE = 0, 1
#: In a word's value, the bits from here on count unknown words.
UNKNOWN = 1 << 40
_SHARED: dict = {}


class LongestMatch:
    """Number of pieces that greedy longest-match gives for a word; a word that cannot be spelled is one unknown piece.

    An empty initial piece is the bare space mark: it stands for itself before any continuing piece. With `byte_fallback`
    a character that no continuing piece spells is as many pieces as it has bytes in UTF-8.
    """

    def __init__(self, initial: Iterable[str], continuing: Iterable[str], byte_fallback: bool = False):
        self.byte_fallback = byte_fallback
        self.child: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, vocabulary in ((START, initial), (CONTINUE, continuing)):
            for text in vocabulary:
                node = root
                for char in text:
                    follower = self.child[node].get(char)
                    if follower is None:
                        follower = self.child[node][char] = len(self.child)
                        self.child.append({})
                        piece.append(False)
                    node = follower
                piece[node] = bool(text) or root == START or piece[node]
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        if piece[START]:
            self.fail[START], self.popped[START] = CONTINUE, 1
        # Breadth first over both tries: a failure link always leads to a node nearer to a root.
        queue = deque((root, char, node) for root in (START, CONTINUE) for char, node in self.child[root].items())
        while queue:
            parent, char, node = queue.popleft()
            if piece[node]:
                self.fail[node], self.popped[node] = CONTINUE, 1
            elif byte_fallback and parent == CONTINUE:
                self.fail[node], self.popped[node] = CONTINUE, len(char.encode())
            else:
                back, taken = self.fail[parent], self.popped[parent]
                while back >= 0 and char not in self.child[back]:
                    if back == CONTINUE and byte_fallback:
                        self.fail[node], self.popped[node] = CONTINUE, taken + len(char.encode())
                        break
                    taken += self.popped[back]
                    back = self.fail[back]
                else:
                    if back >= 0:
                        self.fail[node], self.popped[node] = self.child[back][char], taken
            queue.extend((node, c, n) for c, n in self.child[node].items())

    def count(self, word: str) -> int:
        """Pieces of the word, or UNKNOWN + 1."""
        child, fail, popped = self.child, self.fail, self.popped
        node, taken = START, 0
        if not word:
            return 0
        for char in word:
            while (follower := child[node].get(char)) is None:
                if node == CONTINUE and self.byte_fallback:
                    taken += len(char.encode())
                    follower = CONTINUE
                    break
                taken += popped[node]
                node = fail[node]
                if node < 0:
                    return UNKNOWN + 1
            node = follower
        while node != CONTINUE:
            taken += popped[node]
            node = fail[node]
            if node < 0:
                return UNKNOWN + 1
        return taken


def vocabulary(model: str) -> tuple[list[str], list[str], bool]:
    """What LongestMatch takes, from a sentencepiece file.

    The pieces that begin a word, without their space mark (the bare mark is ""); all pieces, of which those with a
    mark continue a word that has one inside; and whether every byte has a piece.
    """
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(lib.get_piece_size())
    normal = [lib.id_to_piece(i) for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    return [p[1:] for p in normal if p.startswith("▁")], normal, sum(map(lib.is_byte, ids)) == 256


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown (words that are one unknown token; none with byte pieces).

    Words are what stands between the white space characters of ASCII. Null and empty texts have no words and no tokens.
    Null ids and repeated rows are counted like others; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _SHARED:
            automaton = LongestMatch(*vocabulary(model))
            _SHARED[model] = Memo(lambda word: automaton.count(word.decode()), 600_000)
        memo = _SHARED[model]
        for part, texts in text_slices(batches):
            words = [t.encode().split() for t in texts]
            sums = [sum(map(memo.__getitem__, w)) for w in words]
            yield record_batch(
                SCHEMA, part.column(0), list(map(len, words)), [s % UNKNOWN for s in sums], [s // UNKNOWN for s in sums]
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
