"""Byte-level BPE ids as the tokenizers library gives them, through a bounded memo of short runs of text.

Pre-tokens are encoded independently of each other, so a text's ids are its
runs' ids put together. Runs are encoded by a second library from the same vocabulary,
which is much faster on short strings, if the vocabulary's merges come in the order
of its ids. Texts with characters on whose class two regular expression engines
might differ go through the first library whole.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from recordloom.llm.common import for_tasks
from recordloom.llm.memo import Memo

#: ASCII and the Latin letters up to U+024F, on which the pattern below and the library's agree.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*")
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
#: The pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_WIDE = ("  ", "\n\n", " \n", "\n ", "\t", "\r")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a vocabulary stands for: printable ones are themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class ByteCodec:
    """Special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.runs = Memo(self._encoder(path), 300_000)

    def _encoder(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != sorted(made):
            return lambda run: np.array(self.whole(run), dtype="<u4").tobytes()
        of = _bytes_of()
        ranks = {bytes(of[c] for c in t): k for t, k in vocab.items() if t not in special}
        encode = tiktoken.Encoding("runs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda run: struct.pack(f"<{len(ids := encode(run))}I", *ids)

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit numbers.

        Where white space stands alone, a run is a space or line break with the word behind it.
        """
        if not _PLAIN.fullmatch(text):
            return np.array(self.whole(text), dtype="<u4").tobytes()
        own = self.runs
        if any(s in text for s in _WIDE):
            return b"".join([own[r] for r in _RUNS(text)])
        return b"".join([own[r] for r in text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")])


@for_tasks
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)
