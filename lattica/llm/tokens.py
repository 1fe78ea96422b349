"""Token ids of whole texts, by the tokenizers library.

A text is encoded piece by piece, and pieces seen before are looked up: for a vocabulary that drops
white space, the ids of a text are those of its space-separated pieces, one after another. Pieces of
plain Latin letters go to the library's BPE model directly; all others go through the whole library.
``Encoder`` finds out from the vocabulary file whether this holds and encodes whole texts if not.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import regex

from lattica.llm.shared import resident

#: Fixed values of the vocabulary files this shortcut knows: normaliser steps and the split pattern.
WORD_STEPS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this letter, lower-casing and NFC look at one letter alone.
PLAIN_BELOW = "İ"


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level BPE: printable bytes stand for themselves, others follow from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces; a missing one is encoded, and kept while there is room."""

    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.encode = encoder.piece

    def __missing__(self, piece: str) -> bytes:
        return self.encode(piece)


class Encoder:
    """Ids of texts. Keeps the first ``most`` pieces, so the frequent ones; starts afresh after eight times as many misses."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = ("<u2", "H") if small else ("<u4", "I")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.by_piece = steps == WORD_STEPS and split == WORD_SPLIT and not spec.get("post_processor")
        self.special = any("<" in x["content"] for x in spec.get("added_tokens", []))
        self.words, self.letters = regex.compile(WORD_SPLIT).findall, _byte_letters()
        self.model = self.tokenizer.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.pieces, self.parts, self.misses = _Pieces(self), {}, 0

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            seen = part if part.isascii() else part.encode().decode("latin1").translate(self.letters)
            got = array(self.code, [x.id for x in self.model(seen)]).tobytes()
            if len(self.parts) < self.most:
                self.parts[part] = got
        return got

    def piece(self, piece: str) -> bytes:
        """Ids of a piece without spaces that is not kept."""
        self.misses += 1
        if len(piece) > 100:
            return self._whole(piece)
        if (piece.isascii() or max(piece) < PLAIN_BELOW) and not (self.special and "<" in piece):
            got = b"".join(map(self._part, self.words(piece.lower())))
        else:
            got = self._whole(piece)
        if len(self.pieces) < self.most:
            self.pieces[piece] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned integers."""
        if not self.by_piece:
            return np.frombuffer(self._whole(text), self.kind)
        if self.misses > 8 * self.most:
            self.forget()
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" "))), self.kind)


@resident(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a vocabulary file in each Python worker."""
    return Encoder(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
