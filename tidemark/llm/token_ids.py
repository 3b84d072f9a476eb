"""Token ids of whole texts as the ``tokenizers`` library gives them.

``tiktoken`` encodes with the ranks of the same vocabulary file, several times as fast. Stretches of rarer scripts, whose
character classes may differ between the libraries' Unicode versions, go to ``tokenizers`` itself, as do long runs of
white space, on which the other's pattern runs out of stack, and vocabularies of another kind.
"""

from __future__ import annotations

import json
import re
from itertools import groupby

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm.bpe import BYTE_LEVEL_PATTERN, byte_alphabet, cut

#: Scripts beyond the Latin ones.
_ODD = re.compile("[\u0250-\U0010ffff]")
#: Runs of white space of this length go to ``tokenizers``; shorter texts than _SHORT have none that could do harm.
_BLANKS = re.compile(r"\s{1000}")
_SHORT = 50_000

_CODERS: dict[tuple[str, int | None], TokenIds] = {}


class TokenIds:
    """Ids without added special tokens; special strings inside texts are special tokens, as is the library's default.

    ``end`` is an id appended to every text.
    """

    def __init__(self, path: str, end: int | None = None) -> None:
        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        byte_level = "ByteLevel" in str(self.coder.pre_tokenizer) and self.coder.normalizer is None
        self.ranks = self._ranked(path) if byte_level else None

    @staticmethod
    def _ranked(path: str) -> tiktoken.Encoding | None:
        """The vocabulary as ranks; none if its ids don't follow the order of the merges."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(set(made)) or len(ranks) != len(made) + 256:
            return None
        return tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _library(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _common(self, text: str) -> bytes:
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def _one(self, text: str) -> bytes:
        if self.ranks is None:
            return self._library(text)
        if (text.isascii() or not _ODD.search(text)) and (len(text) < _SHORT or not _BLANKS.search(text)):
            return self._common(text)
        # joined again, chunks that are alike encode as they do apart
        chunks = cut(text)
        chunks[1:] = [f" {c}" for c in chunks[1:]]
        runs = groupby(chunks, key=lambda c: _ODD.search(c) is not None or _BLANKS.search(c) is not None)
        return b"".join((self._library if odd else self._common)("".join(run)) for odd, run in runs)

    def wide(self) -> bool:
        """Whether some id of the vocabulary takes more than 16 bits."""
        return self.coder.get_vocab_size(with_added_tokens=True) > 1 << 16

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self._one(t) + self.end for t in texts]


def coder(path: str, end: int | None = None) -> TokenIds:
    """This worker's encoder."""
    if (path, end) not in _CODERS:
        _CODERS[path, end] = TokenIds(path, end)
    return _CODERS[path, end]


def encoded(batches, path: str, end: int | None, size: int = 2 << 20):
    """(doc ids, ids of each text) in groups of about ``size`` characters from batches with columns id and text."""
    of = coder(path, end)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < size):
                chars += len(texts[stop] or "")
                stop += 1
            yield ids[start:stop], of.encode([t or "" for t in texts[start:stop]])
            start = stop
