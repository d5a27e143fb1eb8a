"""Texts as letters: code points in lower case, each run of anything else as one space."""

from __future__ import annotations

from functools import cache

import numpy as np

_SPACE = 32


@cache
def _fold() -> np.ndarray:
    """Of each code point, its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, _SPACE, dtype=np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters after one another, and each text's length in it.

    Each text begins and ends with one space; one without letters is a single space.
    """
    # A line separator on either side of each text marks where it ends.
    raw = np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    folded = _fold()[raw]
    starts = np.cumsum(sizes) - sizes
    keep = np.empty(len(folded), dtype=bool)
    keep[0] = True
    np.logical_or(folded[1:] != _SPACE, folded[:-1] != _SPACE, out=keep[1:])
    keep[starts] = True
    kept = np.add.reduceat(keep, starts, dtype=np.int64)
    return folded[keep], kept


def slices(texts: list[str], size: int = 1 << 19) -> list[tuple[np.ndarray, list[str]]]:
    """The texts in groups of about `size` code points at most: (owner of each piece, pieces).

    What is longer alone comes in several pieces, each a text of its own to what follows, so that memory stays bounded.
    """
    out, owners, held, total = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), size):
            piece = text[at : at + size]
            if held and total + len(piece) > size:
                out.append((np.array(owners), held))
                owners, held, total = [], [], 0
            owners.append(k)
            held.append(piece)
            total += len(piece)
    return [*out, (np.array(owners), held)] if held else out
