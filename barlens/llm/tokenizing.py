"""Ids and bytes of public tokenizers inside tasks: a byte-level BPE and a piece BPE, each from its own file.

The driver opens the files; executors get their content.  The byte-level encoder takes vocabulary and merges from the
tokenizer's JSON and runs them through ``tiktoken``, which gives the ids of the ``tokenizers`` library about four times
as fast (tests compare the two).  Texts that hold a special token's string go to ``tokenizers`` itself when special
tokens are to be recognised.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken
import tokenizers

from barlens.llm.token_rollup import PATTERN, _pieces

_SPACE_MARK = "▁"
_LONG = 200_000


def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The tokenizer of a byte-level BPE file (JSON).  ``special``: whether strings of special tokens are recognised
    in texts; else they are ordinary text."""

    def __init__(self, raw: bytes, special: bool = False):
        spec = json.loads(raw)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items()}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
        if any(a >= b for a, b in zip(made, made[1:])) or sum(len(b) == 1 for b in ranks) != 256:
            raise ValueError("the vocabulary's ids don't follow the order of its merges, or lack single bytes")
        self._bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._special = tuple(t["content"] for t in spec["added_tokens"]) if special else ()
        self._raw, self._full = raw, None
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for b, i in ranks.items():
            self.bytes[i] = b

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text, no special tokens added."""
        if self._special and any(s in text for s in self._special):
            if self._full is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"
                self._full = tokenizers.Tokenizer.from_str(self._raw.decode("utf-8"))
            return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) <= _LONG:
            return self._bpe.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([self._bpe.encode_to_numpy(p, disallowed_special=()) for p in _pieces(text, _LONG)])


class PieceBpe:
    """The tokenizer of a sentencepiece model: U+2581 stands for a space, <0xHH> for a byte; it adds a space in front."""

    def __init__(self, raw: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size = self._model.vocab_size()
        self.bytes = [self._bytes(self._model.id_to_piece(i)) for i in range(self.size)]

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(_SPACE_MARK, " ").encode("utf-8")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(raw: bytes, special: bool = False) -> ByteBpe:
    return ByteBpe(raw, special)


@lru_cache(maxsize=2)
def piece_bpe(raw: bytes) -> PieceBpe:
    return PieceBpe(raw)
