"""Words as this project defines them, and where each stands in the original text.

A word is a longest run of letters or digits after compatibility decomposition
(NFKD), lower-casing and removal of combining marks and invisible format
characters.  Null texts have no words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_DROPPED = regex.compile(r"[\p{M}\p{Cf}]+")


def folded(text: str) -> str:
    """``text`` decomposed and lower-cased, without marks and format characters."""
    if text.isascii():
        return text.lower()
    return _DROPPED.sub("", unicodedata.normalize("NFKD", text).lower())


def words(text: str | None) -> list[str]:
    """The words of ``text``, in order."""
    if not text:
        return []
    return _ASCII_WORD.findall(text.lower()) if text.isascii() else _WORD.findall(folded(text))


@lru_cache(maxsize=65536)
def _folded_char(char: str) -> str:
    return folded(char)


def word_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Words with the half-open range of original characters each one comes from."""
    if not text:
        return []
    if text.isascii():
        return [(m.group(), m.start(), m.end()) for m in _ASCII_WORD.finditer(text.lower())]
    pieces, origin = [], []
    for at, char in enumerate(text):
        piece = _folded_char(char)
        pieces.append(piece)
        origin.extend([at] * len(piece))
    return [(m.group(), origin[m.start()], origin[m.end() - 1] + 1) for m in _WORD.finditer("".join(pieces))]
