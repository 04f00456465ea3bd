"""Token ids by the tokenizers library, with a cache of pieces.

A byte-level BPE never lets a token cross from a non-space character into a following space, so a text may be cut before each such space
and the pieces encoded apart; equal pieces (words) are encoded once. Tests compare with whole-text encoding by the library. A text that holds one
of the vocabulary's added tokens (such as `<|endoftext|>`) is encoded whole, as the library does it: added tokens are single ids there.
"""

from __future__ import annotations

import re
from string import punctuation
from struct import pack

_PAIR = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S) ")
#: No more pieces are kept than CACHE (the frequent ones come early), none longer than LONGEST.
CACHE, LONGEST = 700_000, 48


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Piece -> ids as little-endian unsigned 32-bit integers, filled on demand; `before` stands before each piece."""

    def __init__(self, tokenizer, before: str):
        super().__init__()
        self.tokenizer, self.before, self.merge, self.letters = tokenizer, before, tokenizer.model.tokenize, byte_letters()
        self.spelt_before = "".join(self.letters[b] for b in before.encode())

    def __missing__(self, x: str) -> bytes:
        head = x.rstrip(punctuation)
        if head.isalpha():  # letters alone go straight to the merges; punctuation after letters is a run of its own
            if len(head) < len(x):
                got = self[head] + self.tail(x[len(head) :])
            else:
                ids = [t.id for t in self.merge(self.spelt_before + (x if x.isascii() else x.encode().decode("latin-1").translate(self.letters)))]
                got = pack(f"<{len(ids)}I", *ids)
        else:
            ids = self.tokenizer.encode(self.before + x, add_special_tokens=False).ids
            got = pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE and len(x) <= LONGEST:
            self[x] = got
        return got

    def tail(self, x: str) -> bytes:
        ids = self.tokenizer.encode(x, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """encode(text) gives the text's ids as little-endian unsigned 32-bit integers in one bytes object."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.whole, self.added = tokenizer, re.compile("|".join(map(re.escape, added))) if added else None
        self.bare, self.spaced = _Pieces(tokenizer, ""), _Pieces(tokenizer, " ")
        self.bare.tail = self.spaced.tail = _Pieces(tokenizer, "").__getitem__
        self.newline = self.bare["\n"]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added and self.added.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        bare, spaced = self.bare, self.spaced.__getitem__
        if _PAIR.search(text):
            first, *rest = _CUT.split(text)
            return bare[first] + b"".join(map(spaced, rest))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(bare[first] + b"".join(map(spaced, rest)))
        return self.newline.join(lines)


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary; kept on the library's module, since functions are pickled by value."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_lamellar_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]
