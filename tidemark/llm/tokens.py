"""Encoding with the files of the tokenizers library."""

from __future__ import annotations

import json
from array import array

import tiktoken
from tokenizers import Tokenizer

_SHARED: dict = {}
#: Fixed value: how byte-level BPE splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rank_engine(path: str) -> tiktoken.Encoding | None:
    """The merges of a byte-level BPE file as ranks, if its ids are in the order of its merges; else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, alphabet = model.get("vocab", {}), byte_alphabet()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    in_order = [vocab.get(m) for m in merged] == list(range(256, 256 + len(merged)))
    if model.get("type") != "BPE" or model.get("ignore_merges") or not in_order or sorted(vocab[c] for c in alphabet) != list(range(256)):
        return None
    ranks = {bytes(alphabet[c] for c in t): vocab[t] for t in [*alphabet, *merged]}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of a tokenizer file as little-endian unsigned 32-bit integers, the same as the tokenizers library gives.

    Byte-level files are encoded by ranks, which takes a third of the time. Texts that hold an added token, and files of
    another kind, go through the tokenizers library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = str(self.tokenizer.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.ranks = rank_engine(path) if plain and self.tokenizer.normalizer is None else None

    @classmethod
    def shared(cls, path: str) -> Encoder:
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def ids(self, text: str) -> bytes:
        if self.ranks is None or any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.ranks.encode_ordinary(text)).tobytes()
