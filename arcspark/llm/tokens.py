"""Counting and locating tokens: a fixed word rule and public tokenizers from a folder given as parameter."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

#: A run of letters, digits and underscores of any script, or one other character that isn't white space.
WORD_RULE = re.compile(r"\w+|[^\w\s]")
#: Fixed value: how the byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k.tiktoken"


def _clean(text: str) -> str:
    """Text as the libraries take it: lone surrogates become U+FFFD."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


class WordRule:
    """The word rule as a tokenizer."""

    def count(self, text: str) -> int:
        return len(WORD_RULE.findall(text))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in WORD_RULE.finditer(text)]

    def located(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins, and whether it begins with a character rather than inside one; the other tokenizers' too."""
        starts = np.array(self.starts(text), np.int64)
        return starts, np.ones(len(starts), bool)


class Ranked:
    """A byte-level vocabulary in a .tiktoken file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        # By token: the characters that begin in it, and whether its first byte continues one.
        self.chars, self.inside = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, bool)
        for b, i in ranks.items():
            self.chars[i], self.inside[i] = sum(x & 0xC0 != 0x80 for x in b), b[0] & 0xC0 == 0x80

    def count(self, text: str) -> int:
        return len(self.own.encode_ordinary(_clean(text)))

    def starts(self, text: str) -> list[int]:
        text = _clean(text)
        return self.own.decode_with_offsets(self.own.encode_ordinary(text))[1]

    def located(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.own.encode_ordinary(_clean(text)), np.int64)
        return np.cumsum(self.chars[ids]) - self.chars[ids] - self.inside[ids], ~self.inside[ids]


class Json:
    """A vocabulary in a tokenizer .json file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True

    def count(self, text: str) -> int:
        return len(self.own.encode(_clean(text), add_special_tokens=False))

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.own.encode(_clean(text), add_special_tokens=False).offsets]

    def located(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(self.own.encode(_clean(text), add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 0] >= np.maximum.accumulate(np.append(0, at[:-1, 1]))[: len(at)]


class Pieces:
    """A sentence-piece .model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.own.encode(_clean(text), num_threads=1))

    def starts(self, text: str) -> list[int]:
        text = _clean(text)
        begins = [p.begin for p in self.own.encode(text, return_type="proto").pieces]
        if text.isascii():
            return begins
        # Offsets are in bytes; a token inside a character begins where the character does.
        ends = np.cumsum([len(c.encode()) for c in text])
        return np.searchsorted(ends, begins, side="right").tolist()

    def located(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        starts = np.array(self.starts(text), np.int64)
        return starts, starts > np.maximum.accumulate(np.append(-1, starts[:-1]))[: len(starts)]


@lru_cache(maxsize=4)
def load(name: str = NAME, folder: str = FOLDER) -> WordRule | Ranked | Json | Pieces:
    """The tokenizer of a file in the folder, or the word rule for the name 'words'; kept by each worker."""
    if name == "words":
        return WordRule()
    kind = {".tiktoken": Ranked, ".json": Json, ".model": Pieces}[os.path.splitext(name)[1]]
    return kind(os.path.join(folder, name))
