"""Byte-level BPE encoding and decoding with the exact merges of a rank file, in linear time.

The vocabulary's tokens, mapped byte by byte to Latin-1, form an Aho-Corasick
automaton that gives the longest token at every position of a piece. Encoding
starts with the longest token and takes a token only if it may stand after the
one before it: merging the bytes of two such tokens yields those two tokens
again. Otherwise it tries the next shorter token, or steps back. A position
that was left once is never tried again, so the work is linear in the piece.
Compatibility of adjacent tokens is worked out once for each pair and kept.

Null is the empty text: no token. Empty texts give no token either. Rows are
independent, so ties, repeated rows and other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

KEPT_PIECES = 100_000
KEPT_UNITS = 400_000
KEPT_PIECE_BYTES = 64
KEPT_PAIRS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of `base64 rank` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def _blank(part: str) -> bool:
    return not part or part[0].isspace()


class Tokenizer:
    """Encode and decode as the merges of the ranks do.

    spaced: the pattern begins a match at every space that other text follows.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False):
        self.ranks, self.spaced = ranks, spaced
        self.tokens = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.sizes = [0] * (max(ranks.values()) + 1)
        # The longest token that begins a token and is not all of it; -1 if none does.
        self.shorter = [-1] * len(self.sizes)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.sizes[rank] = len(token)
            begins = (ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in begins if r >= 0), -1)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._units: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves, lowest rank first; quadratic, for a few bytes only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min(((r, i) for r, i in ranked if r is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the same two tokens."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            known = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The tokens of one match of the pattern."""
        body = piece.encode("utf-8")
        whole = self.ranks.get(body)
        if whole is not None:
            return [whole]
        n, sizes, shorter, pairs = len(body), self.sizes, self.shorter, self._pairs
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(body.decode("latin-1")):
            longest[end - sizes[rank] + 1] = rank
        closed = bytearray(n + 1)
        taken: list[int] = []
        at, before, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if not closed[end]:
                    if before < 0:
                        break
                    known = pairs.get(before << 32 | token)
                    if self.compatible(before, token) if known is None else known:
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at, before, token = end, token, longest[end]
                continue
            closed[at] = 1
            if not taken:
                raise ValueError("the ranks lack a single byte of the text")
            last = taken.pop()
            at -= sizes[last]
            before = taken[-1] if taken else -1
            token = shorter[last]
        return taken

    def _packed(self, piece: str) -> bytes:
        ranks = self.encode_piece(piece)
        return struct.pack(f"<{len(ranks)}I", *ranks)

    def _pieces_of(self, text: str) -> bytes:
        """Ids of a stretch of text, match by match of the pattern."""
        kept, out = self._pieces, []
        for piece in self.split(text):
            ids = kept.get(piece)
            if ids is None:
                ids = self._packed(piece)
                if len(piece) <= KEPT_PIECE_BYTES:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _unit(self, part: str) -> bytes:
        """Ids of a space and the part after it; short ones are remembered."""
        word, *rest = self.split(" " + part)
        ids = self._units.get(word[1:]) if rest else None
        if ids is None:
            ids = self._remember(word[1:], self._packed(word))
        if not rest:
            return ids
        return self._remember(part, ids + self._pieces_of("".join(rest)))

    def _remember(self, part: str, ids: bytes) -> bytes:
        if len(part) <= KEPT_PIECE_BYTES and "\n" not in part:
            if len(self._units) >= KEPT_UNITS:
                self._units.clear()
            self._units[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers.

        With `spaced` the text falls into units at those spaces, looked up as a whole.
        """
        if not self.spaced:
            return self._pieces_of(text)
        parts = text.split(" ")
        found = list(map(self._units.get, parts))
        found[0] = None
        done = 0
        for i in [i for i, ids in enumerate(found) if ids is None]:
            if i < done:
                continue
            # A part without own text at its start belongs to the stretch before it.
            start, done = (i - 1 if i and _blank(parts[i]) else i), i + 1
            while done < len(parts) and _blank(parts[done]):
                done += 1
            if start and done == start + 1:
                found[start] = self._unit(parts[start])
            else:
                lead = " " if start else ""
                found[start] = self._pieces_of(lead + " ".join(parts[start:done]))
                found[start + 1 : done] = [b""] * (done - start - 1)
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids, packed as encode() does, stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[tuple[str, str, bool], Tokenizer] = {}


def tokenizer(path: str, pattern: str, spaced: bool) -> Tokenizer:
    """One tokenizer for each rank file and pattern in a Python worker."""
    key = (path, pattern, spaced)
    if key not in _loaded:
        _loaded[key] = Tokenizer(read_ranks(path), pattern, spaced)
    return _loaded[key]


def encode(docs: DataFrame, path: str, pattern: str, spaced: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text as packed little-endian 32-bit integers: (id, ids binary)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, pattern, spaced)
        for batch in batches:
            ids = [known.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    out = source.mapInArrow(rows, f"id {_type(source)}, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """The bytes that packed ids stand for: (id, body binary); null ids give no byte."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, pattern, False)
        for batch in batches:
            bodies = [known.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(bodies, pa.binary())], ["id", "body"])

    source = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    out = source.mapInArrow(rows, f"id {_type(source)}, body binary")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, spaced: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and give digests of both.

    Returns (id, n_tokens, ids_sha256, decoded_sha256), one row for each input row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path, pattern, spaced)
        for batch in batches:
            sizes, packed, back = [], [], []
            for text in batch.column(1):
                ids = known.encode(text.as_py() or "")
                sizes.append(len(ids) // 4)
                packed.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(known.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed), pa.array(back)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    schema = f"id {_type(source)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def _type(source: DataFrame) -> str:
    return source.schema["id"].dataType.simpleString()
