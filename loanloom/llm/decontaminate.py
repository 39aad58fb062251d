"""Benchmark decontamination with SimHash over item-sized windows.

Texts and items are words (`[^\\x20\\x09-\\x0D]+`, in lower case) and shingles of SHINGLE
words. A window of a text with as many words as an item is a candidate if their 64-bit SimHashes
differ in at most RADIUS bits. The index cuts fingerprints into BLOCKS blocks: within RADIUS
some block differs in at most two bits, so each item is entered in every block under all values
within two bits, and looking up a window's own values finds every item within the radius.
Candidates are verified by the weighted Jaccard similarity of their shingles, each weighted by
how often it occurs: LEAST_SIMILAR or more is a leak.

Only windows that hold a shingle of an item of their size are hashed; no other can be similar
at all. A text shorter than an item is one window. Items go to the workers in blocks of at most
BLOCK_BYTES of text, one pass over the documents each; documents are never shuffled.

Null and empty texts have no window. Items of fewer than SHINGLE words, null ones included,
match nothing. Items with equal texts are reported each. Repeated documents are reported each;
an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.arrays import Chunk, Rolling, chunks

SHINGLE = 5
LEAST_SIMILAR = 0.8
BLOCKS = 6
RADIUS = 3 * BLOCKS - 1
BLOCK_BYTES = 8 * 1024 * 1024
STARTS_AT_ONCE = 1 << 14
SCREEN_BITS = 20


def shingle_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, first word of it, first word of each text) of a chunk."""
    words = chunk.words()
    hashes = words.hashes()
    if len(hashes) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), words.first
    doc = words.doc()
    at = np.flatnonzero(doc[SHINGLE - 1 :] == doc[: len(doc) - SHINGLE + 1])
    return Rolling(hashes).spans(at, at + SHINGLE), at, words.first


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def _bits(hashes: np.ndarray) -> np.ndarray:
    big = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(big, axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that more than half of the shingles have, each occurrence counted."""
    return int(_packed((2 * _bits(hashes).sum(axis=0, dtype=np.int64) > len(hashes))[None, :])[0])


class HammingIndex:
    """Items of one size under all block values within two bits of their own."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        edges = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
        self.cuts = [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]
        self.tables = []
        for low, mask in self.cuts:
            width = mask.bit_length()
            flips = [0, *(1 << i for i in range(width))]
            flips += [1 << i | 1 << j for i in range(width) for j in range(i)]
            own = (prints >> np.uint64(low)).astype(np.int64) & mask
            values = (own[:, None] ^ np.array(flips)).ravel()
            items = np.repeat(np.arange(len(prints)), len(flips))
            order = np.argsort(values, kind="stable")
            self.tables.append((np.searchsorted(values[order], np.arange(mask + 2)), items[order]))

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within RADIUS, nearest first."""
        pairs = []
        for (low, mask), (bounds, items) in zip(self.cuts, self.tables):
            value = (windows >> np.uint64(low)).astype(np.int64) & mask
            size = bounds[value + 1] - bounds[value]
            window = np.repeat(np.arange(len(windows)), size)
            at = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(window * len(self.prints) + items[np.repeat(bounds[value], size) + at])
        both = np.unique(np.concatenate(pairs))
        window, item = both // len(self.prints), both % len(self.prints)
        distance = np.bitwise_count(windows[window] ^ self.prints[item]).astype(np.int64)
        near = np.flatnonzero(distance <= RADIUS)
        order = near[np.lexsort((window[near], distance[near]))]
        return window[order], item[order], distance[order]


class Items:
    """The searchable form of one block of items."""

    def __init__(self, ids: list, texts: list[str]):
        chunk = next(chunks(lowered(pa.array(texts, pa.large_string())), limit=1 << 62))
        hashes, at, first = shingle_hashes(chunk)
        of = np.searchsorted(first, at, side="right") - 1
        sizes = np.diff(first)
        self.ids, self.sizes = ids, sizes
        # By size: items, index, and each item's shingles with their numbers.
        self.by_size: dict[int, tuple[list[int], HammingIndex]] = {}
        self.shingles = _counted(hashes, of, len(ids))
        prints = {i: _simhash_of(c) for i, c in enumerate(self.shingles) if c}
        for size in sorted({int(sizes[i]) for i in prints}):
            own = [i for i in prints if sizes[i] == size]
            self.by_size[size] = (own, HammingIndex(np.array([prints[i] for i in own], np.uint64)))
        pairs = sorted({(h, int(sizes[i])) for i, c in enumerate(self.shingles) for h in c})
        self.known = np.array([h for h, _ in pairs], np.uint64)
        self.known_size = np.array([s for _, s in pairs], np.int64)
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        self.screen[(self.known >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)] = True

    def leaks(self, chunk: Chunk) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item, first word, distance, similarity) for each leak in a lower-cased chunk."""
        hashes, at, first = shingle_hashes(chunk)
        maybe = np.flatnonzero(self.screen[(hashes >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)])
        low = np.searchsorted(self.known, hashes[maybe], side="left")
        high = np.searchsorted(self.known, hashes[maybe], side="right")
        hit = np.repeat(maybe, high - low)
        step = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        size = self.known_size[np.repeat(low, high - low) + step]
        doc = np.searchsorted(first, at[hit], side="right") - 1
        order = np.lexsort((hit, size, doc))
        hit, size, doc = hit[order], size[order], doc[order]
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(size) != 0)) + 1
        for part in np.split(np.arange(len(hit)), cut) if len(hit) else []:
            text, n = int(doc[part[0]]), int(size[part[0]])
            begin = int(np.searchsorted(at, first[text]))
            end = int(np.searchsorted(at, first[text + 1]))
            own = hashes[begin:end]
            width = min(n - SHINGLE + 1, len(own))
            # Windows that hold a hit, as a union of ranges of starts.
            last = len(own) - width
            marks = np.zeros(last + 2, np.int32)
            place = hit[part] - begin
            np.add.at(marks, np.clip(place - width + 1, 0, last), 1)
            np.add.at(marks, np.minimum(place, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(marks[: last + 1]) > 0)
            yield from self._near(text, own, starts, width, n)

    def _near(self, text: int, own: np.ndarray, starts: np.ndarray, width: int, size: int):
        items, index = self.by_size[size]
        found: set[int] = set()
        for k in range(0, len(starts), STARTS_AT_ONCE):
            part = starts[k : k + STARTS_AT_ONCE]
            base = int(part[0])
            stretch = own[base : int(part[-1]) + width]
            sums = np.zeros((len(stretch) + 1, 64), np.int32)
            np.cumsum(_bits(stretch), axis=0, out=sums[1:])
            prints = _packed(2 * (sums[part - base + width] - sums[part - base]) > width)
            for window, item, distance in zip(*index.within(prints)):
                which = items[item]
                if which in found:
                    continue
                at = int(part[window])
                similar = weighted_jaccard(Counter(own[at : at + width].tolist()), self.shingles[which])
                if similar >= LEAST_SIMILAR:
                    found.add(which)
                    yield text, which, at, int(distance), similar


def _counted(hashes: np.ndarray, of: np.ndarray, n: int) -> list[Counter]:
    limits = np.searchsorted(of, np.arange(n + 1))
    return [Counter(hashes[a:b].tolist()) for a, b in zip(limits, limits[1:])]


def _simhash_of(counted: Counter) -> int:
    return simhash(np.array(list(counted.elements()), np.uint64))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    """Common weight over total weight, a shingle's weight being its number."""
    both = sum((a & b).values())
    return both / (a.total() + b.total() - both) if both else 0.0


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    source = items.filter(F.col(text_col).isNotNull()).select(id_col, text_col).distinct()
    for row in source.orderBy(id_col, text_col).toLocalIterator():
        text, more = row[1], len(row[1].encode("utf-8"))
        if ids and size + more > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += more
    if ids:
        yield ids, texts


_built: list[tuple[object, Items]] = []


def _items(token: object, ids: list, texts: list[str]) -> Items:
    if not _built or _built[0][0] != token:
        _built[:] = [(token, Items(ids, texts))]
    return _built[0][1]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, at, distance, similarity), one row for each document and item found in it.

    `at` is the first word of the nearest verified window, `distance` that of the SimHashes.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    kind = source.schema["id"].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, at long, distance long, similarity double"
    out = None
    for ids, texts in _blocks(items, item_col, item_text):
        found = source.mapInArrow(_search(ids, texts), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = source.select("id", F.lit(None).cast(item_kind).alias("item")).filter("false")
        for name, of in (("at", "long"), ("distance", "long"), ("similarity", "double")):
            out = out.withColumn(name, F.lit(None).cast(of))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _search(ids: list, texts: list[str]):
    token = hash((tuple(map(str, ids)), tuple(texts)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(token, ids, texts)
        for batch in batches:
            for chunk in chunks(lowered(batch.column(1))):
                found = list(known.leaks(chunk))
                which = pa.array([chunk.first + f[0] for f in found], pa.int64())
                yield pa.record_batch(
                    [batch.column(0).take(which), pa.array([ids[f[1]] for f in found], _kind(ids)),
                     *[pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)],
                     pa.array([f[4] for f in found], pa.float64())],
                    ["id", "item", "at", "distance", "similarity"],
                )

    return rows


def _kind(ids: list) -> pa.DataType:
    return pa.array(ids).type


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    at = docs.columns.index(text_col)
    for ids, texts in _blocks(items, item_col, item_text):
        docs = docs.mapInArrow(_without(ids, texts, at), T.StructType(docs.schema.fields))
    return docs


def _without(ids: list, texts: list[str], at: int):
    token = hash((tuple(map(str, ids)), tuple(texts)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _items(token, ids, texts)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for chunk in chunks(lowered(batch.column(at))):
                keep[[chunk.first + f[0] for f in known.leaks(chunk)]] = False
            yield batch.filter(pa.array(keep))

    return rows
