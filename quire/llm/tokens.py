"""Byte-level BPE ids of whole texts, by pre-token, with a bounded memo of pre-tokens.

A pre-token's ids depend on it alone, so a text's ids are those of its pre-tokens in order. Words
repeat; a memo from pre-token to its packed ids makes encoding a matter of splitting and lookups.
The memo is emptied at MEMO entries. Texts with characters for which the standard regex classes
might part from the tokenizer's own (numbers other than plain digits, separators from U+001C, and
anything from U+0250 on) are encoded whole by the tokenizer itself.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

MEMO = 400_000
#: The split of byte-level BPE, for texts of characters below U+0250 without ODD ones.
SPLIT = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+")
ODD = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")

#: The same split for any text, by the regex library's properties.
FULL = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Pre-token to its ids as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, encode_piece) -> None:
        super().__init__()
        self._encode_piece = encode_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self._encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Encoder:
    """Ids as the tokenizer of the given file gives them.

    Its merges are applied to single pre-tokens by a second library from the same file's vocabulary,
    where a token's id is its rank; a text that SPLIT isn't right for goes through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in special}
        bpe = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(bpe._core_bpe.encode_single_piece)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        """Whether SPLIT gives the tokenizer's own pre-tokens of the text."""
        return not ODD.search(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of any text, in order; joined they are the text."""
        if self.plain(text):
            return SPLIT.findall(text)
        import regex

        return regex.findall(FULL, text)

    def packed(self, text: str) -> bytes:
        """All ids of the text, packed."""
        return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text))) if self.plain(text) else self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
