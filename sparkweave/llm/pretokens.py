"""Cutting texts into the pre-tokens of the byte-level vocabularies.

A piece of a text is cut before every space that follows a non-space
character: no match of the pre-token pattern spans such a place, and none
looks back over it, so pieces can be cut into pre-tokens (and encoded) on
their own and remembered.  Texts in which some space follows white space are
taken as one piece.
"""

from __future__ import annotations

import re

import regex
from public_tokenizers import PATTERN, path

#: The added token; the library cuts it out of a text before anything else.
SPECIAL = "<|endoftext|>"
_PATTERN = regex.compile(PATTERN)
_SPACE_AFTER_WHITE = re.compile(r"\s ")


def pieces(text: str) -> list[str]:
    """Pieces whose concatenation is ``text``; an occurrence of the special
    string is a piece of its own."""
    if SPECIAL in text:
        out: list[str] = []
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                out.append(SPECIAL)
            out += pieces(part)
        return out
    if not text:
        return []
    if _SPACE_AFTER_WHITE.search(text):
        return [text]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


def pretokens(piece: str) -> list[str]:
    """Pre-tokens of one piece."""
    return [piece] if piece == SPECIAL else _PATTERN.findall(piece)


def vocabulary_path(name: str) -> str:
    """Place, on the machine that asks, of a public vocabulary file, or of any
    other by its whole path."""
    return path(name)
