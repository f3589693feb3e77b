"""Encode whole texts through a table of chunks.

A byte-level BPE pre-tokenizer never lets a token run over a space between two
characters that are not white space, so a text can be cut there and each chunk
(its leading space included) encoded once. Chunks are kept in a bounded table;
ids are little-endian unsigned 32-bit integers, ready to be joined and hashed.
"""

from __future__ import annotations

from collections.abc import Callable

#: Not white space to every library, so a cut beside them is avoided.
DOUBTFUL = frozenset("᠎​﻿\x85\x1c\x1d\x1e\x1f")


class Loose(Exception):
    """A piece whose edge is white space: its neighbours belong to the same chunk."""


def loose(char: str) -> bool:
    return char.isspace() or char in DOUBTFUL


class ChunkTable(dict):
    """Ids by piece. When full, the table becomes the older generation, from which pieces in use come back."""

    def __init__(self, encode: Callable[[str], bytes], prefix: str, limit: int):
        super().__init__()
        self.encode, self.prefix, self.limit, self.older = encode, prefix, limit, {}

    def __missing__(self, piece: str) -> bytes:
        if not piece.isalpha() and (not piece or loose(piece[0]) or loose(piece[-1])):
            raise Loose
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(self.prefix + piece)
        if len(piece) <= 32:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ChunkedEncoder:
    """encode(text) -> ids as bytes, the same as encode_chunk(text) in one call."""

    def __init__(self, encode_chunk: Callable[[str], bytes], limit: int = 150_000):
        self.encode_chunk = encode_chunk
        self.spaced = ChunkTable(encode_chunk, " ", limit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        head = pieces[0]
        if head and not loose(head[0]) and not loose(head[-1]):
            try:
                del pieces[0]
                return self.encode_chunk(head) + b"".join(map(self.spaced.__getitem__, pieces))
            except Loose:
                pieces.insert(0, head)
        return b"".join(self._merged(pieces))

    def _merged(self, pieces: list[str]):
        chunk, clean = pieces[0], False
        for piece in pieces[1:]:
            if piece and chunk and not loose(piece[0]) and not loose(chunk[-1]):
                yield self._one(chunk, clean)
                chunk, clean = piece, True
            else:
                chunk, clean = (" " * clean) + chunk + " " + piece, False
        yield self._one(chunk, clean)

    def _one(self, chunk: str, spaced: bool) -> bytes:
        if not spaced:
            return self.encode_chunk(chunk)
        return self.encode_chunk(" " + chunk) if loose(chunk[-1]) else self.spaced[chunk]
