"""SentencePiece BPE encoding and decoding over a prefix table.

For each prefix of a text the encoding is unique, and so is its last token. A
token t that ends a prefix is that last token if t encodes as itself and is
compatible with the last token of what precedes it: encoding the two alone
gives the two again. An Aho-Corasick automaton lists the tokens that end at
each position; the table of last tokens then gives the ids backwards. This
holds for any merging by a fixed priority, leftmost first, as here, where the
piece of the highest score is merged.

Spaces only begin pieces, so a text is encoded unit by unit: a run of spaces
with the word behind it, or a line break. Units are kept in a bounded memo.

Null and empty texts have no ids and decode to the empty text. Characters that
no piece holds become their UTF-8 byte pieces. A literal U+2581 counts as a space, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BATCH_ROWS, cut, in_parts, table
from recordloom.llm.memo import Memo

SPACE = "▁"
_UNITS = re.compile(r"\n| *[^ \n]+| +")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.ids = {self.pieces[i]: i for i in normal}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.control = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = {i for i in range(len(self.pieces)) if sp.is_unknown(i)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("a piece holds a space or line break inside; units can't be encoded apart")
        # Characters inside pieces that are no pieces themselves take part in merges, and fall back to bytes if left over.
        self.tokens = [*self.score, *sorted({c for p in self.score for c in p} - self.score.keys())]
        self.number = {t: k for k, t in enumerate(self.tokens)}
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            if len(t) == 1 or self.merged(t) == [t]:  # others never come out of merging
                self.automaton.add_word(t, (k, len(t)))
        self.automaton.make_automaton()
        self.alphabet = {c for t in self.tokens for c in t}
        self.fits = Memo(self._fits, 150_000, longest=0)
        self.units = Memo(self._unit)

    def merged(self, text: str) -> list[str]:
        """Merging step by step; for single tokens and pairs of tokens only."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, pair: int) -> bool:
        a, b = self.tokens[pair >> 20], self.tokens[pair & 0xFFFFF]
        return self.merged(a + b) == [a, b]

    def _run(self, text: str) -> list[int]:
        """Ids of a text whose characters all occur in pieces."""
        room = (lambda x: [x] * (len(text) + 1)) if len(text) < 1 << 16 else (lambda x: array("i", [x]) * (len(text) + 1))
        last, size, fits = room(-1), room(0), self.fits
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:  # the valid one is unique: no other is tried once it is found
                start = end - n
                if not start or (before := last[start]) >= 0 and fits[before << 20 | token]:
                    last[end], size[end] = token, n
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= size[end]
        ids: list[int] = []
        for k in reversed(out):
            t = self.tokens[k]
            ids += [self.ids[t]] if t in self.ids else [self.byte_ids[b] for b in t.encode()]
        return ids

    def unit_ids(self, unit: str) -> list[int]:
        unit, ids, start = unit.replace(" ", SPACE), [], 0
        if self.alphabet.issuperset(unit):
            return self._run(unit)
        for k, c in enumerate(unit):
            if c not in self.alphabet:
                ids += self._run(unit[start:k]) if k > start else []
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                start = k + 1
        return ids + (self._run(unit[start:]) if start < len(unit) else [])

    def _unit(self, unit: str) -> str:
        """The ids as text, and behind a NUL what they decode to, where that isn't the unit itself."""
        ids = self.unit_ids(unit)
        back = self.surface(ids)
        return ",".join(map(str, ids)) + ("" if back == unit else "\0" + back)

    def surface(self, ids: list[int]) -> str:
        """The text of ids, without taking away the leading space."""
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append("" if i in self.control else " ⁇ " if i in self.unknown else self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    @staticmethod
    def split(text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        if "  " in text or "\0" in text:
            return _UNITS.findall(text)
        return [u for u in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if u]  # the same, cheaper

    def encode(self, text: str) -> list[int]:
        return [i for u in self.split(text) for i in self.unit_ids(u)]

    def decode(self, ids: list[int]) -> str:
        return self.surface(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text; unit by unit through the memo."""
        units, kept = self.split(text), self.units
        own = [kept[u] for u in units]
        ids = ",".join(own)
        if "\0" in ids:
            pairs = [o.partition("\0") for o in own]
            ids, units = ",".join(p[0] for p in pairs), [p[2] if p[1] else u for p, u in zip(pairs, units)]
        back = "".join(units).removeprefix(" ")
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return ids.count(",") + 1 if ids else 0, sha(ids), sha(back)


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(text: Column, path: str | None = None) -> Column:
    """The ids of a text, as array<int>."""
    path = path or model_path()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([codec(path).encode(t or "") for t in texts], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of ids; null for null."""
    path = path or model_path()

    @F.pandas_udf("string")
    def back(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else codec(path).decode(list(r)) for r in rows], dtype=object)

    return back(ids)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    path = path or model_path()

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for texts in in_parts(batches):
            yield pd.DataFrame([own.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col(id_col).alias("doc_id"), digests(F.coalesce(F.col(text_col), F.lit(""))).alias("r")).select("doc_id", "r.*")
    return cut(found, "pieces", BATCH_ROWS)


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, digested; null texts are empty, repeated rows have a result each."""
    return round_trip(table(spark, sf_dir, "documents"))
