"""Phrase collocation mining over count streams in prefix and suffix order.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs
into words. For each language the operator counts words and phrases of two to LONGEST words within
pieces, takes those found at least LEAST times as candidates and scores a candidate of count a by
its weakest cut into a first part of count l and a rest of count r: floor(SCALE * a / (l + r)).
Candidates that a longer one explains (COVERED percent of their occurrences) are dropped.

Counting goes level by level. What occurs less than LEAST times cannot be part of a candidate, so a
level only ships the phrases whose own parts may be frequent. Whether they are is looked up in a
screen, a bit field of fixed size over hashes of the frequent phrases of the level before; it may let
others pass, whose counts then show it, and never loses one. Counts are of the phrases themselves.

The streams of two neighbouring levels are then merged in lockstep, by sort-merge joins without hash
tables. In prefix order a phrase meets what it begins with: that gives the counts of all its first
parts, one more at each level, and the largest count among its extensions to the right. In suffix order
it meets what it ends with, which gives the counts of the rests and the largest extension to the left.
A phrase that two more words extend is also extended by one of them at least as often, so one level
decides what is dropped.

Null languages are `und`; null and empty texts have no words; texts are read whole, whatever their
length. Repeated rows count every time. Ties in score go to the larger count, then to the smaller
phrase in byte order. No id is read. An empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanloom.llm.arrays import Chunk, chunks, gathered, mixed
from loanloom.llm.frames import written

LONGEST = 4
LEAST = 30
SCALE = 2_000_000
COVERED = 80
FIRST = 2000
UNKNOWN = "und"
CHUNK_BYTES = 3 << 19
SLICE_ROWS = 500
SCREEN_BITS = 1 << 26
SALTS = 16

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_SPACE = 0x20


class Pieces:
    """The words of a chunk; `begins` marks the first word of every piece."""

    def __init__(self, chunk: Chunk, langs: np.ndarray):
        """langs: a 64-bit number for the language of each text, mixed into the words' keys."""
        lowered = chunk.lowered()
        cut = _CUT[lowered.data]
        self.data = np.append(np.where(cut, np.uint8(_SPACE), lowered.data), np.uint8(_SPACE))
        words = Chunk(0, self.data[:-1], chunk.bounds).words()
        self.starts, self.ends, self.doc = words.starts, words.ends, words.doc()
        self.keys = mixed(words.hashes() ^ langs[self.doc])
        before = np.concatenate([[0], np.cumsum(cut)])
        self.begins = np.ones(len(words), bool)
        self.begins[1:] = before[self.starts[1:]] != before[self.ends[:-1]]
        first = words.first[:-1]
        self.begins[first[first < len(words)]] = True

    def follows(self) -> np.ndarray:
        """Words whose next word is in the same piece."""
        out = np.zeros(len(self.begins), bool)
        out[:-1] = ~self.begins[1:]
        return out

    def longer(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Keys of one word more, from those of `size` words, by first word; garbage past the end."""
        out = keys.copy()
        if len(keys) > size:
            out[:-size] = mixed(mixed(keys[:-size]) ^ self.keys[size:])
        return out

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of `size` words at the given first words, joined by single spaces."""
        parts = 2 * size - 1
        starts = np.full((len(at), parts), len(self.data) - 1, np.int64)
        ends = starts + 1
        for i in range(size):
            starts[:, 2 * i], ends[:, 2 * i] = self.starts[at + i], self.ends[at + i]
        offsets = np.concatenate([[0], np.cumsum((ends - starts).sum(axis=1))])
        body = gathered(self.data, starts.ravel(), ends.ravel())
        binary = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]
        )
        return binary.cast(pa.binary()).cast(pa.string())


def number(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode("utf-8"), digest_size=8).digest(), "little")


def numbers(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = np.array([number(x) for x in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def passes(screen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys % np.uint64(SCREEN_BITS)
    return (screen[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _counted(docs: DataFrame, sizes: tuple[int, ...], screens: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, k, a) of the phrases of the given sizes that pass the screens of smaller ones.

    With sizes (1,) a row without a phrase counts all words of the language.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            langs, coded = batch.column(0), numbers(batch.column(0))
            for chunk in chunks(batch.column(1), CHUNK_BYTES):
                end = chunk.first + len(chunk)
                pieces = Pieces(chunk, coded[chunk.first : end])
                own = langs.slice(chunk.first, len(chunk))
                if not len(pieces.keys):
                    continue
                if sizes == (1,):
                    doc, n = np.unique(pieces.doc, return_counts=True)
                    yield _batch(own.take(pa.array(doc)), pa.nulls(len(doc), pa.string()), 0, n)
                yield from _found(pieces, own, sizes, screens)

    found = docs.mapInArrow(rows, "lang string, phrase string, k int, n long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("a"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches a few at a time, so that what is made of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def _found(pieces: Pieces, langs: pa.Array, sizes: tuple[int, ...], screens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys, follows = pieces.keys, pieces.follows()
    here = np.ones(len(keys), bool)
    for size in range(1, max(sizes) + 1):
        if size in sizes:
            at = np.flatnonzero(here)
            _, first, n = np.unique(keys[at], return_index=True, return_counts=True)
            at = at[first]
            yield _batch(langs.take(pa.array(pieces.doc[at])), pieces.phrases(at, size), size, n)
        if size < max(sizes):
            # A phrase goes on if both of its parts with one word less may be frequent.
            if size <= len(screens):
                here &= passes(screens[size - 1], keys)
            on = np.zeros(len(keys), bool)
            on[:-1] = here[:-1] & here[1:] & follows[:-1]
            keys, here = pieces.longer(keys, size), on


def _batch(langs: pa.Array, phrases: pa.Array, size: int, n: np.ndarray) -> pa.RecordBatch:
    k = pa.array(np.full(len(n), size, np.int32))
    return pa.record_batch([langs, phrases, k, pa.array(n.astype(np.int64))], ["lang", "phrase", "k", "n"])


def _screen(frequent: DataFrame, size: int) -> np.ndarray:
    """The bit field of the keys of all phrases; at most SCREEN_BITS bits, whatever their number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = numbers(batch.column(0))
            for chunk in chunks(batch.column(1), CHUNK_BYTES):
                pieces = Pieces(chunk, coded[chunk.first : chunk.first + len(chunk)])
                keys = pieces.keys
                for n in range(1, size):
                    keys = pieces.longer(keys, n)
                place = np.unique(keys[pieces.begins] % np.uint64(SCREEN_BITS))
                slot = (place >> np.uint64(6)).astype(np.int32)
                mask = np.uint64(1) << (place & np.uint64(63))
                first = np.flatnonzero(np.diff(slot, prepend=-1))
                both = np.bitwise_or.reduceat(mask, first) if len(first) else mask
                yield pa.record_batch([pa.array(slot[first]), pa.array(both.view(np.int64))], ["slot", "mask"])

    slots = frequent.select("lang", "phrase").mapInArrow(rows, "slot int, mask long")
    table = slots.groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    screen = np.zeros(SCREEN_BITS // 64, np.uint64)
    screen[table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return screen


def _merged(level: DataFrame, below: DataFrame, part: str, new: str, before: str) -> DataFrame:
    """A level's phrases with the counts of their parts, where `part` names the phrase one word shorter.

    Both streams are ordered by language and that part and run through side by side.
    """
    other = below.select(F.col("lang").alias("o_lang"), F.col("phrase").alias("o_phrase"),
                         F.col("a").alias("o_a"), F.col(before).alias("o_before"))
    on = (F.col("lang") == F.col("o_lang")) & (F.col(part) == F.col("o_phrase"))
    joined = level.join(other.hint("merge"), on)
    parts = F.concat("o_before", F.array("o_a")) if new == "ls" else F.concat(F.array("o_a"), "o_before")
    return joined.select(*level.columns, parts.alias(new))


def weakest_cut() -> Column:
    """(score, cut, l, r) of the lowest-scoring cut of a phrase with counts a, ls and rs."""
    return F.expr(
        f"array_min(transform(sequence(1, size(ls)), c -> struct((cast(a AS decimal(20,0)) * {SCALE}) "
        "div cast(ls[c - 1] + rs[c - 1] AS decimal(20,0)) AS score, c AS cut, ls[c - 1] AS l, rs[c - 1] AS r)))"
    )


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score."""
    own = docs.select(F.coalesce(docs[lang_col], F.lit(UNKNOWN)).alias("lang"), docs[text_col].alias("text"))
    one = written(_counted(own, (1,), []).filter((F.col("a") >= least) | F.col("phrase").isNull()), "phrases-1")
    words, totals = one.filter("k = 1"), one.filter("k = 0").selectExpr("lang", "a AS n")
    screens = [_screen(words, 1)]
    two = written(_counted(own, (2,), screens).filter(F.col("a") >= least), "phrases-2")
    screens.append(_screen(two, 2))
    more = written(_counted(own, (*range(3, LONGEST + 1),), screens).filter(F.col("a") >= least), "phrases-more")
    none = F.array().cast("array<long>")
    below = words.select("lang", "phrase", "a", none.alias("ls"), none.alias("rs"))
    merged = []
    for size in range(2, LONGEST + 1):
        counts = two if size == 2 else more.filter(F.col("k") == size)
        level = counts.select(
            "lang", "phrase", "a", F.substring_index("phrase", " ", size - 1).alias("head"),
            F.substring_index("phrase", " ", 1 - size).alias("tail"),
        )
        with_first = _merged(level, below, "head", "ls", "ls")
        below = written(_merged(with_first, below, "tail", "rs", "rs"), f"phrases-merged-{size}")
        merged.append(below)
    extended = [
        longer.select(F.col("lang").alias("e_lang"), F.col(part).alias("e_phrase"), F.col("a").alias("longer"))
        for longer in merged[1:] for part in ("head", "tail")
    ]
    most = reduce(DataFrame.unionByName, extended).groupBy("e_lang", "e_phrase").agg(F.max("longer").alias("most"))
    same = (F.col("lang") == F.col("e_lang")) & (F.col("phrase") == F.col("e_phrase"))
    covered = _exact(F.col("most")) * 100 >= _exact(F.col("a")) * COVERED
    candidates = reduce(DataFrame.unionByName, merged)
    kept = candidates.join(most.hint("merge"), same, "left").filter(~F.coalesce(covered, F.lit(False)))
    scored = kept.select("lang", "phrase", "a", weakest_cut().alias("best")).select("lang", "phrase", "a", "best.*")
    return _ranked(scored, first).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _ranked(scored: DataFrame, first: int) -> DataFrame:
    """Each language's first rows, cut within SALTS parts of it before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    near = salted.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= first).withColumn("rank", F.col("rank").cast("long"))
