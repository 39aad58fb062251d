"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every window of WINDOW bytes begins a suffix that is ordered only through its first WINDOW
bytes, by most-significant-digit passes over three digits: the anchor (a gram of GRAM bytes,
with its offset in the window, see `segments`), the bytes before it and the bytes after it. The
first pass is the range partitioning of the cluster, the others run inside a partition; a suffix
that is alone after a pass is done. What is still equal after the last pass are exactly the
windows that occur more than once. Runs of windows that are equal as a whole are settled before,
so copies bring no suffix of their own.

All bytes of a window that also starts anywhere else go, in all places. Null is empty. Rows that
share an id and a text are one document and no repeat of each other; null ids are one id. Texts
shorter than WINDOW lose nothing. Empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.arrays import Rolling, chunks, mixed
from loanloom.llm.frames import written
from loanloom.llm.segments import (
    byte_symbols, chosen_runs, covered, expanded_pieces, pooled_texts, shared_runs, with_spans,
)
from loanloom.llm.suffixtree import _documents

WINDOW = 400
GRAM = 300
DIGITS = ["first", "before", "after"]
# Suffixes in one batch, and bytes of text at a time (a longer text is taken whole): a byte takes some
# hundred bytes of arrays.
SUFFIXES, BYTES = 1 << 16, 1 << 19


def _suffixes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(first, before, after, id, version, at): the digits of the suffixes in pooled runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2), BYTES):
                own, bounds, found = chosen_runs(chunk, batch.column(3), byte_symbols, window, gram)
                rolling, begins = Rolling(own), bounds[found.doc] + found.start
                for run, step in expanded_pieces(found, SUFFIXES):
                    begin = begins[run] + step
                    anchor = begins[run] + found.place[run]
                    first = mixed(found.anchor[run] + (anchor - begin).astype(np.uint64))
                    digits = [first, rolling.spans(begin, anchor), rolling.spans(anchor + gram, begin + window)]
                    of = pa.array(found.doc[run] + chunk.first)
                    yield pa.record_batch(
                        [*[pa.array(d.view(np.int64)) for d in digits],
                         batch.column(0).take(of), batch.column(1).take(of),
                         pa.array((found.start[run] + step).astype(np.int32))],
                        [*DIGITS, "id", "version", "at"],
                    )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        rows, f"first long, before long, after long, id {kind}, version int, at int"
    )


def equal_groups(digits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes: (suffixes that are not alone, their group), groups together."""
    left = np.arange(len(digits[0]))
    group = np.zeros(len(left), np.int64)
    for digit in digits:
        order = np.lexsort((digit[left], group))
        left, group = left[order], group[order]
        value = digit[left]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new) - 1
        alone = np.bincount(group) == 1 if len(group) else np.zeros(0, bool)
        keep = ~alone[group]
        left, group = left[keep], group[keep]
    return left, group


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of equal groups (open false); single ones that may have an equal next door (open true)."""
    parts = list(batches)
    if not any(p.num_rows for p in parts):
        return
    # Rows that repeat a document repeat its suffixes.
    table = pa.Table.from_batches(parts)
    table = table.group_by(table.column_names).aggregate([]).combine_chunks()
    digits = [np.asarray(table.column(n)) for n in DIGITS]
    repeated = np.zeros(table.num_rows, bool)
    repeated[equal_groups(digits)[0]] = True
    order = np.lexsort(digits[::-1])
    outer = np.zeros(table.num_rows, bool)
    for end in (order[0], order[-1]):
        outer |= (digits[0] == digits[0][end]) & (digits[1] == digits[1][end]) & (digits[2] == digits[2][end])
    table = table.append_column("open", pa.array(outer & ~repeated))
    table = table.append_column("outer", pa.array(outer))
    yield from table.filter(pa.array(repeated | outer)).combine_chunks().to_batches()


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, version, at, size): series of `size` windows, from byte `at` on, that occur elsewhere too."""
    own = _documents(docs, id_col, text_col)
    shared = shared_runs(own, byte_symbols, window, gram, "bytes", BYTES)
    later = shared.runs.filter("copies = 0").select("id", "version", "at", "size")
    several = shared.kinds.filter("copies > 1").select("anchor", "content")
    heads = shared.runs.filter("copies > 0").join(several, ["anchor", "content"], "left_semi")
    texts = pooled_texts(own, shared.pool())
    suffixes = _suffixes(texts, window, gram)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suffixes.schema)
    groups = written(
        suffixes.repartitionByRange(*DIGITS, "id", "version", "at")
        .mapInArrow(_sorted_groups, schema + ", open boolean, outer boolean"),
        "groups",
    )
    # A window that is alone at a partition's edge has an equal one next door if its key is there too.
    edges = groups.filter("outer").groupBy(*DIGITS).agg(F.count("*").alias("n")).filter("n > 1")
    late = groups.filter("open").join(edges, DIGITS, "left_semi")
    found = groups.filter("not open").unionByName(late)
    single = found.select("id", "version", "at", F.lit(1).alias("size"))
    return later.union(heads.select("id", "version", "at", "size")).union(single)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), one row for each input row."""
    spans = repeated_bytes(docs, id_col, text_col, window, gram)
    joined = with_spans(_documents(docs, id_col, text_col), spans)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, str]] = []
            for text, own in zip(batch.column(1), batch.column(2)):
                body = text.as_py().encode("utf-8")
                gone = covered(len(body), own, window)
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                digest = hashlib.sha256(kept).hexdigest()
                out.append((len(body), int(gone.sum()), int(begins.sum()), digest))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = joined.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
