"""Substring dedup of words by suffix trees over prefix-partitioned suffixes.

A suffix starts at every window of WINDOW words and is followed through WINDOW words. Its
prefix, of variable length, runs up to the end of the window's anchor (`segments`), so suffixes
with different prefixes share no window, and a suffix whose prefix nobody shares is never
shuffled with its words. Copies are combined before any tree is built: of equal runs of windows
only the first one is kept as leaves, since all windows of the others start earlier elsewhere.
The remaining suffixes are cut into memory-sized groups of neighbouring prefixes by range
partitioning; within a group the sorted leaves and their common depths are the suffix tree, and
its internal nodes of depth WINDOW or more are the repeats: all leaves but the first go.

A word goes if a window that covers it also starts earlier: at a smaller id, or earlier in the
same document. Null is an empty text. A null id is smaller than all ids; rows that share an id
and a text are one document, rows that share only the id are ordered by a hash of their text.
Texts of fewer than WINDOW words lose nothing. Empty tables give empty results; other columns
are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.arrays import Rolling, chunks, gathered
from loanloom.llm.frames import written
from loanloom.llm.segments import (
    changes, chosen_runs, covered, expanded, pooled_texts, shared_runs, with_spans, word_symbols,
)

WINDOW = 20
GRAM = 6


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.hash(body).alias("version"), body.alias("body"))


def _suffixes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(prefix, rest, id, version, at): suffixes that start in the pooled runs.

    prefix is the hash of the words up to the anchor's end; rest holds four bytes for each word
    from there to the window's end, so equal bytes up to a place mean a common path to that depth.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                words, bounds, found = chosen_runs(chunk, batch.column(3), word_symbols, window, gram)
                run, step = expanded(found)
                begin = bounds[found.doc][run] + found.start[run] + step
                middle = bounds[found.doc][run] + found.start[run] + found.place[run] + gram
                rest = gathered((words >> np.uint64(32)).astype(">u4"), middle, begin + window)
                sizes = np.concatenate([[0], np.cumsum(4 * (begin + window - middle))])
                of = pa.array(found.doc[run] + chunk.first)
                yield pa.record_batch(
                    [pa.array(Rolling(words).spans(begin, middle).view(np.int64)),
                     pa.Array.from_buffers(pa.binary(), len(run), [
                         None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(rest.tobytes())]),
                     batch.column(0).take(of), batch.column(1).take(of),
                     pa.array((found.start[run] + step).astype(np.int32))],
                    ["prefix", "rest", "id", "version", "at"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(rows, f"prefix long, rest binary, id {kind}, version int, at int")


def meeting_depths(prefix: np.ndarray, rest: pa.Array, window: int) -> np.ndarray:
    """How many words each sorted leaf has in common with the one before it (0 if prefixes differ)."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(rest)) // 4)])
    words = np.frombuffer(b"".join(rest.to_pylist()), ">u4")
    depth = np.zeros(len(prefix), np.int64)
    both = np.flatnonzero(prefix[1:] == prefix[:-1]) + 1
    size = ends[both + 1] - ends[both]
    depth[both] = window - size
    for word in range(int(size.max()) if len(size) else 0):
        both = both[size > word]
        equal = words[ends[both] + word] == words[ends[both - 1] + word]
        both = both[equal]
        depth[both] += 1
        size = ends[both + 1] - ends[both]
    return depth


def _repeats(window: int):
    """Leaves of deep nodes but for the first, and (open) the first ones of the outer two nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not any(p.num_rows for p in parts):
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        # Rows that repeat a document repeat its suffixes.
        own = np.zeros(table.num_rows, bool)
        for n in ("prefix", "rest", "id", "version", "at"):
            own |= changes(table.column(n).combine_chunks())
        table = table.filter(pa.array(own)).combine_chunks()
        prefix = np.asarray(table.column("prefix"))
        depth = meeting_depths(prefix, table.column("rest").combine_chunks(), window)
        first = depth < window
        node = np.cumsum(first) - 1
        outer = (node == 0) | (node == node[-1])
        table = table.append_column("open", pa.array(first & outer)).filter(pa.array(~first | outer))
        yield from table.combine_chunks().to_batches()

    return rows


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, version, at, size): series of `size` windows, from word `at` on, that start earlier elsewhere."""
    own = _documents(docs, id_col, text_col)
    shared = shared_runs(own, word_symbols, window, gram, "words")
    place = F.struct("id", "version", "at")
    later = shared.runs.filter("copies = 0").select("id", "version", "at", "size")
    heads = shared.runs.filter("copies > 0")
    others = heads.join(shared.kinds.select("anchor", "content", "lead"), ["anchor", "content"])
    others = others.filter(place != F.col("lead")).select("id", "version", "at", "size")
    texts = pooled_texts(own, shared.pool())
    suffixes = _suffixes(texts, window, gram)
    order = ["prefix", "rest", "id", "version", "at"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema)
    leaves = written(
        suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_repeats(window), schema + ", open boolean"),
        "leaves",
    )
    outer = leaves.filter("open")
    least = outer.groupBy("prefix", "rest").agg(F.min(place).alias("lead"))
    late = outer.join(least, ["prefix", "rest"]).filter(place != F.col("lead"))
    alone = leaves.filter("not open").unionByName(late.select(*leaves.columns))
    single = alone.select("id", "version", "at", F.lit(1).alias("size"))
    return later.union(others).union(single)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), one row for each input row."""
    spans = repeated_words(docs, id_col, text_col, window, gram)
    joined = with_spans(_documents(docs, id_col, text_col), spans)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, digests = [], [], []
            for text, own in zip(batch.column(1), batch.column(2)):
                words = text.as_py().encode("utf-8").split()
                out = covered(len(words), own, window)
                totals.append(len(words))
                gone.append(int(out.sum()))
                kept = b" ".join(compress(words, (~out).tolist()))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(digests)],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = joined.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(rows, f"id {kind}, n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
