"""Operator 4: exact BPE encoding and decoding by per-prefix dynamic programming.

The last token of the BPE encoding of a prefix is unique. Token t ends prefix i
exactly if the prefix's text ends with t and t is compatible with the last token
of the prefix before t: merging the two texts together gives back those two
tokens. An automaton over the vocabulary lists the tokens that end at each
position; the pair test walks the merge trees of both tokens along their common
border. Following the stored last tokens backwards gives the ids.

Defined results: a null text counts as empty and has no ids; repeated rows each
give a row; other columns of the input are ignored; an empty table gives an
empty result. Added tokens that stand in a text get their id, as the tokenizers
library does.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinsight.llm.chunked import ChunkedEncoder, loose
from kinsight.llm.common import sparing

NEVER = 1 << 62
#: The pre-tokenizer's pattern over ASCII and Latin letters; texts with others go through the library's own splitter.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
BLANK = r" \t\n\r\x0b\x0c"
SIMPLE = re.compile(rf"[\x00-\x7f{LATIN}]*")
SIMPLE_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{BLANK}{LATIN}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PrefixBpe:
    """A byte-level BPE vocabulary that encodes by last tokens of prefixes."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.alphabet = byte_alphabet()
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.mapping = {b: c for b, c in enumerate(self.alphabet)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for order, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.rank[a, b] = order
            self.parts[vocab[left + right]] = a, b
            self.made[vocab[left + right]] = order
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self.whole = self._reachable(vocab)
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if i in self.whole:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        back = {c: b for b, c in self.mapping.items()}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in text)
        for text, i in self.added.items():
            self.token_bytes[i] = text.encode()
        self.pieces: dict[str, bytes] = {}
        self.table = ChunkedEncoder(self.encode_chunk)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one border of a merge tree, innermost first, each with the rank of the merge that takes it in."""
        if (known := self._spines.get((token, side))) is None:
            chain, consumed, at = [], NEVER, token
            while True:
                chain.append((at, consumed))
                if at not in self.parts:
                    break
                consumed, at = self.made[at], self.parts[at][side]
            known = self._spines[token, side] = chain[::-1]
        return known

    def border_holds(self, a: int, b: int, until: int = NEVER) -> bool:
        """No merge across the border of a and b comes before those within them (nor before rank `until`)."""
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            if x_until == y_until == NEVER:
                return across >= until
            # of equal pairs the leftmost merges first
            if across < x_until and across <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _reachable(self, vocab: dict[str, int]) -> set[int]:
        """Tokens that their own text encodes to."""
        whole = {i for i in vocab.values() if i not in self.parts}
        for token, order in sorted(self.made.items(), key=lambda x: x[1]):
            a, b = self.parts[token]
            if a in whole and b in whole and self.border_holds(a, b, order):
                whole.add(token)
        return whole

    def _fit(self, key: int, a: int, b: int) -> bool:
        if len(self._fits) >= 400_000:
            self._fits.clear()
        fit = self._fits[key] = self.border_holds(a, b)
        return fit

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token, given in the byte alphabet."""
        n, known = len(piece), self._fits.get
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(piece):
            end += 1
            if last[end] >= 0:
                continue
            if start := end - length:
                if (before := last[start]) < 0:
                    continue
                key = before << 20 | token
                fit = known(key)
                if fit is None:
                    fit = self._fit(key, before, token)
                if not fit:
                    continue
            last[end], back[end] = token, length
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= back[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def _ordinary(self, text: str) -> bytes:
        if SIMPLE.fullmatch(text):
            parts, out = SIMPLE_SPLIT.findall(text), []
            if len(parts) == 1:
                return self.encode_piece(self._mapped(text))
            spaced, pieces = self.table.spaced, self.pieces
            for part in parts:
                if part[0] == " " and len(part) > 1 and not loose(part[1]) and not loose(part[-1]):
                    out.append(spaced[part[1:]])
                else:
                    ids = pieces.get(part)
                    if ids is None:
                        if len(pieces) >= 100_000:
                            pieces.clear()
                        ids = pieces[part] = self.encode_piece(self._mapped(part))
                    out.append(ids)
            return b"".join(out)
        return b"".join(self.encode_piece(x) for x, _ in self.splitter.pre_tokenize_str(text))

    def _mapped(self, part: str) -> str:
        return part.translate(self.mapping) if part.isascii() else part.encode().decode("latin-1").translate(self.mapping)

    def encode_chunk(self, text: str) -> bytes:
        if self.added_split is None or not any(a in text for a in self.added):
            return self._ordinary(text)
        return b"".join(
            np.array([self.added[x]], "<u4").tobytes() if x in self.added else self._ordinary(x)
            for x in self.added_split.split(text) if x
        )

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.table.encode(text or "")

    def decode(self, ids: bytes) -> str:
        names = self.token_bytes
        return b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: its id column, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids themselves.

    Documents stay where they are read: no shuffle, and memory for one Arrow batch.
    """
    source = docs.select(id_col, text_col)
    schema = f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(vocab_path)
        for batch in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                kept.append(ids if keep_ids else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(sparing(run), schema)
