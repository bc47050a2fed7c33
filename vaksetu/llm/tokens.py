"""Token ids by the tokenizers library, one library call for each distinct word.

A text is cut into the tokenizer's own pre-tokens; a pre-token's ids do not depend on its neighbours, so they are kept by
pre-token (at most ``KEPT`` of up to ``LONGEST`` characters). Texts with characters for which the cut is not stated here go to the library whole.
Ids are held as little-endian 16-bit values (both vocabularies have fewer than 65,536).
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT = 800_000
#: Characters of a pre-token that is kept.
LONGEST = 64
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Appended to each document.
END_ID = 2


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_L, _N, _S = _class("L"), _class("N"), r"\t\n\r \xa0"
#: Latin texts without control characters or literal special tokens; others take the library's own way.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ſ]|İ|<\|")
_BYTE_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Words:
    """Ids of whole texts as 16-bit little-endian bytes.

    One pass: the text is cut, each pre-token is looked up, and only new ones go to the library's model. What the cut is not stated for is seen
    in new pre-tokens, too, as these are never kept; their texts go to the library whole.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.lower = json.load(f)["normalizer"] is not None
        self.cut = _WORD_CUT if self.lower else _BYTE_CUT
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.kept: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        got = array("H", [t.id for t in self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            got.byteswap()
        return got.tobytes()

    def ids(self, text: str) -> bytes:
        pieces = self.cut.findall(text.lower() if self.lower else text)
        kept = self.kept
        parts = list(map(kept.get, pieces))
        if None in parts:
            new = {p for p, ids in zip(pieces, parts, strict=True) if ids is None}
            if any(map(_OTHER.search, new)):
                return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
            got = {p: self.piece(p) for p in new}
            parts = [got[p] if ids is None else ids for p, ids in zip(pieces, parts, strict=True)]
            if len(kept) + len(got) > KEPT:
                kept.clear()
            kept.update((p, ids) for p, ids in got.items() if len(p) <= LONGEST)
        return b"".join(parts)


@lru_cache(maxsize=4)
def words(name: str) -> Words:
    """One for each Python worker and vocabulary."""
    return Words(name)
