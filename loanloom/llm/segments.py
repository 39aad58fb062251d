"""Windows of a text grouped by their least gram, the common ground of the two dedup operators.

A window is `window` consecutive symbols (words or bytes) of one text. Its anchor is the gram
of `gram` symbols inside it with the least hash, the leftmost of equals. Equal windows have
equal anchors at equal offsets, so only windows with the same anchor can be equal. Neighbouring
windows mostly share their anchor: a run is a maximal series of them, and a text has few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.arrays import CHUNK_BYTES, Chunk, Rolling, chunks
from loanloom.llm.frames import written

Symbols = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


@dataclass
class Runs:
    """Runs of windows: start of the first window, number of windows, anchor's place, hashes."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    content: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of `width` values, the index of its least value, leftmost first."""
    at = np.arange(len(values), dtype=np.int32)
    low, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, low[step:], low[: len(low) - step])
        reach += step
    return at


def runs(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Runs:
    """All runs of a chunk; bounds are the texts' limits among the symbols."""
    none = np.zeros(0, np.int64)
    if len(symbols) < window:
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    rolling = Rolling(symbols)
    starts = np.arange(len(symbols) - gram + 1)
    grams = rolling.spans(starts, starts + gram)
    place = least(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    whole = np.flatnonzero(np.arange(len(place)) + window <= bounds[doc + 1])
    place, doc = place[whole], doc[whole]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(place)))
    start, at = whole[first], place[first]
    content = rolling.spans(start, start + size - 1 + window)
    return Runs(doc[first], start - bounds[doc[first]], size, at - start, grams[at], content)


def word_symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    words = chunk.words()
    return words.hashes(), words.first


def byte_symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    return chunk.symbols(), chunk.bounds


RUN = ["anchor", "content", "id", "version", "at", "size"]


def _all_runs(docs: DataFrame, symbols: Symbols, window: int, gram: int, limit: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), limit):
                found = runs(*symbols(chunk), window, gram)
                of = pa.array(found.doc + chunk.first)
                yield pa.record_batch(
                    [pa.array(found.anchor.view(np.int64)), pa.array(found.content.view(np.int64)),
                     batch.column(0).take(of), batch.column(1).take(of),
                     pa.array(found.start.astype(np.int32)), pa.array(found.size.astype(np.int32))],
                    RUN,
                )

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"anchor long, content long, id {kind}, version int, at int, size int"
    return docs.select("id", "version", "body").mapInArrow(rows, schema)


def _shared_in_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted runs, those whose anchor occurs again here or may occur next door.

    `copies` is the number of equal runs here on the first of them and 0 on the others,
    whose hashes are left out.
    """
    parts = list(batches)
    if not any(p.num_rows for p in parts):
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    # Rows that repeat a document repeat its runs.
    changed = {n: changes(table.column(n).combine_chunks()) for n in RUN[:5]}
    new_anchor = changed["anchor"]
    new_content = new_anchor | changed["content"]
    table = table.filter(pa.array(new_content | changed["id"] | changed["version"] | changed["at"]))
    table = table.combine_chunks()
    new_anchor = changes(table.column("anchor").combine_chunks())
    new_content = new_anchor | changes(table.column("content").combine_chunks())
    group = np.cumsum(new_anchor) - 1
    keep = (np.bincount(group) > 1)[group] | (group == 0) | (group == group[-1])
    first = np.flatnonzero(new_content)
    copies = np.zeros(table.num_rows, np.int64)
    copies[first] = np.diff(np.append(first, table.num_rows))
    table = table.append_column("copies", pa.array(copies)).filter(pa.array(keep))
    head = np.asarray(table.column("copies")) > 0
    for n in ("anchor", "content"):
        values = np.asarray(table.column(n))
        table = table.set_column(table.column_names.index(n), n, pa.array(values, mask=~head))
    yield from table.combine_chunks().to_batches()


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; null equals null."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
        nulls = np.asarray(pc.is_null(column))
        out[1:] = np.asarray(differ) | (nulls[1:] != nulls[:-1])
    return out


@dataclass
class Shared:
    """Runs with shared anchors, as tables in the shared folder.

    runs: (anchor, content, id, version, at, size, copies), see `_shared_in_partition`.
    kinds: one row for each distinct run, (anchor, content, lead, size, copies), where
    lead is the smallest (id, version, at) that has it and copies how many have it.
    """

    runs: DataFrame
    kinds: DataFrame

    def pool(self) -> DataFrame:
        """(id, version, at): the lead of each kind whose anchor has other kinds too."""
        several = self.kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
        return self.kinds.join(several, "anchor", "left_semi").select("lead.*")


def shared_runs(docs: DataFrame, symbols: Symbols, window: int, gram: int, name: str,
                limit: int = CHUNK_BYTES) -> Shared:
    """Runs of docs (id, version int, body) that share their anchor with another run.

    Texts are taken about `limit` bytes at a time.

    One shuffle of hashes and places, range-partitioned on all of them: a run that a third of
    all documents hold spreads over many partitions. Runs whose anchor is alone go at once.
    """
    found = _all_runs(docs, symbols, window, gram, limit)
    order = RUN[:5]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    marked = (
        found.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_shared_in_partition, schema + ", copies long")
    )
    table = written(marked, f"{name}-runs")
    kinds = (
        table.filter("copies > 0").groupBy("anchor", "content")
        .agg(F.min(F.struct("id", "version", "at")).alias("lead"),
             F.first("size").alias("size"), F.sum("copies").alias("copies"))
    )
    return Shared(table, written(kinds, f"{name}-kinds"))


def pooled_texts(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """(id, version, body, starts): each text with runs in the pool, and where they start."""
    starts = pool.groupBy("id", "version").agg(F.collect_set("at").alias("starts"))
    on = docs["id"].eqNullSafe(starts["id"]) & (docs["version"] == starts["version"])
    return docs.join(starts, on).select(docs["id"], docs["version"], docs["body"], starts["starts"])


def chosen_runs(chunk: Chunk, starts: pa.Array, symbols: Symbols, window: int, gram: int):
    """(symbols, bounds, runs) of a chunk, only the runs at the listed starts."""
    own, bounds = symbols(chunk)
    found = runs(own, bounds, window, gram)
    part = starts.slice(chunk.first, len(chunk))
    lists = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
    wanted = lists.astype(np.int64) << 32 | np.asarray(part.flatten()).astype(np.int64)
    which = np.flatnonzero(np.isin(found.doc.astype(np.int64) << 32 | found.start, wanted))
    picked = Runs(*[getattr(found, f)[which] for f in Runs.__dataclass_fields__])
    return own, bounds, picked


def expanded(found: Runs) -> tuple[np.ndarray, np.ndarray]:
    """(run, step) of each window of the runs."""
    run = np.repeat(np.arange(len(found)), found.size)
    step = np.arange(len(run)) - np.repeat(np.cumsum(found.size) - found.size, found.size)
    return run, step


def expanded_pieces(found: Runs, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, step) of each window of the runs, at most `most` windows at a time."""
    ends = np.cumsum(found.size)
    total = int(found.size.sum())
    for low in range(0, total, most):
        window = np.arange(low, min(low + most, total))
        run = np.searchsorted(ends, window, side="right")
        yield run, window - (ends - found.size)[run]


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(id, version, spans): the windows that go, as (at, size) lists."""
    return spans.groupBy("id", "version").agg(
        F.collect_list(F.struct("at", "size")).alias("spans")
    )


def covered(length: int, spans: pa.Scalar, window: int) -> np.ndarray:
    """Which of a text's symbols lie in a window that goes."""
    steps = np.zeros(length + 1, np.int32)
    if spans.is_valid and len(spans.values):
        at = np.asarray(spans.values.field(0))
        size = np.asarray(spans.values.field(1))
        np.add.at(steps, at, 1)
        np.add.at(steps, at + size - 1 + window, -1)
    return np.cumsum(steps[:length]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, body, spans) for every row of docs (id, version, body)."""
    listed = spans_by_document(spans)
    on = docs["id"].eqNullSafe(listed["id"]) & (docs["version"] == listed["version"])
    return docs.join(listed, on, "left").select(docs["id"], docs["body"], listed["spans"])
