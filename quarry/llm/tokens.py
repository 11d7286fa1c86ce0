"""Token ids of texts, by the tokenizers library with caches of text parts.

A text is cut where its tokenizer always ends a token: at white space for a
tokenizer that drops it; for a byte-level one, whose tokens hold a space at their
start only, before single spaces and around single line breaks.  A part that a
worker has not seen is cut into the pieces that the vocabulary's own pattern
gives, and pieces go to the library's BPE model, each once.  Parts of other kinds
(text that normalisation may change, strings of special tokens), and texts with
longer runs of white space for the byte-level tokenizer, are encoded whole by the
library.

Defined cases: an empty text has no ids; texts of any length are taken whole; a
vocabulary of more than 65,536 entries is refused.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable

import regex
from public_tokenizers import PATTERN

#: Parts and pieces that a worker remembers, some 200 bytes each; then it forgets the later
#: half, in which the rare ones are.
CACHE_PARTS, CACHE_PIECES = 900_000, 250_000
#: Closing signs that are a piece of their own at the end of a part.
CLOSING = frozenset(",.;:!?")
#: Runs of white space that are not cut, and the mark of a line break in a list of parts.
RUNS, BREAK = ("  ", " \n", "\n ", "\n\n", "\0"), "\0"
#: White space other than spaces and line breaks; beside one of those it makes a run that is not cut.
OTHER_SPACE = tuple(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")
SPACE_RUN = re.compile(r"\s[ \n]|[ \n]\s")
#: How a tokenizer that drops white space cuts normalised text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable Latin-1 stands for itself; the other bytes follow from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = (b for b in range(256) if b not in set(plain))
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(other)}}


def packed(ids: Iterable[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PartEncoder:
    """``batch(texts)``: little-endian ids, two bytes each (vocabularies of up to 65,536)."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids need more than two bytes")
        self.drops_space, self.pieces = drops_space, {}
        self.symbols, self.model = byte_symbols(), self.tokenizer.model
        self.symbols_of_first = {c: self.symbols[ord(c)] for c in map(chr, range(128))}
        self.fixed = {"": b""} if drops_space else {"\n": b"", BREAK: self._whole("\n")}
        self.known = dict(self.fixed)
        self.cut = regex.compile(WORD_PATTERN if drops_space else PATTERN).findall

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of what the pattern matches as one piece."""
        if (ids := self.pieces.get(piece)) is None:
            tail = piece[1:]
            if tail.isascii() and tail.isalpha() and piece[0] in self.symbols_of_first:
                symbols = self.symbols_of_first[piece[0]] + tail
            else:
                symbols = "".join([self.symbols[b] for b in piece.encode()])
            ids = self.pieces[piece] = packed([t.id for t in self.model.tokenize(symbols)])
        return ids

    def _learn(self, part: str) -> bytes:
        text = part
        if self.drops_space:
            # Lower case depends on the library but for Latin letters.
            if max(part) >= "ɐ" or "İ" in part:
                return self._whole(part)
            text = unicodedata.normalize("NFC", part).lower()
        else:
            text = part[1:] if part[0] == "\n" else " " + part
        core = text if self.drops_space or text[0] != " " else text[1:]
        if core.isalpha():
            return self._piece(text)
        if text[-1] in CLOSING and core[:-1].isalpha():
            return self._piece(text[:-1]) + self._piece(text[-1])
        if "<|" in text:
            return self._whole(text)
        return b"".join([self._piece(p) for p in self.cut(text)])

    def _encode(self, text: str) -> bytes:
        if self.drops_space:
            parts = text.replace("\n", " ").split(" ")
        elif text.endswith(" ") or any(r in text for r in RUNS) or (any(c in text for c in OTHER_SPACE) and SPACE_RUN.search(text)):
            return self._whole(text)
        else:
            # A key that begins with a line break stands for a part without a space before it.
            parts = ("\n" + text.replace("\n", f" {BREAK} \n")).split(" ")
        known = self.known
        try:
            return b"".join(map(known.get, parts))
        except TypeError:
            for p in parts:
                if p not in known:
                    known[p] = self._learn(p)
            return b"".join(map(known.get, parts))

    def batch(self, texts: list[str]) -> list[bytes]:
        for held, most in ((self.known, CACHE_PARTS), (self.pieces, CACHE_PIECES)):
            if len(held) > most:
                kept = list(itertools.islice(held.items(), most // 2))
                held.clear()
                held.update(kept)
        self.known.update(self.fixed)
        return [self._encode(t) for t in texts]


_encoders: dict[tuple[str, bool], PartEncoder] = {}


def encoder(path: str, drops_space: bool) -> Callable[[list[str]], list[bytes]]:
    """The worker's encoder for a vocabulary file, kept between tasks."""
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = PartEncoder(path, drops_space)
    return _encoders[path, drops_space].batch
