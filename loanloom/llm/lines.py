"""Line dedup: hashes in range partitions, sorted by document and position, give keep bitmaps.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at both ends and
with A-Z in lower case. Keys of at least `min_chars` code points that occur in at
least `min_docs` documents lose all their lines except in the largest document
id that holds them. Only hashes, ids and positions are shuffled. They are
range-partitioned on the whole sort key, so one frequent line spreads over many
partitions; what a partition cannot decide alone, because its first or last key
may go on next door, is settled by one small aggregate over those rows.

Null and empty texts are one empty line. A null id is the smallest id, shared by
all rows without one. Rows with the same id and text are one document; rows that
share only the id count as one document for `min_docs`. Empty tables give empty
results; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.frames import identified, same, with_text, written

MIN_CHARS = 20
MIN_DOCS = 3
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8")) < min_chars:
        return None
    return key


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, version, at) for each line with a key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, which, at = [], [], []
            for i, text in enumerate(batch.column(2)):
                for n, line in enumerate(text.as_py().encode("utf-8").split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                        which.append(i)
                        at.append(n)
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            of = pa.array(which, pa.int64())
            yield pa.record_batch(
                [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])),
                 batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32())],
                ["h1", "h2", "id", "version", "at"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"h1 long, h2 long, id {kind}, version long, at int")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; null equals null."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column[1:], column[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = np.asarray(pc.is_null(column))
        out[1:] = differ | (nulls[1:] != nulls[:-1])
    return out


def _streamed(min_docs: int):
    """Decide each key while its sorted lines pass by.

    Emits (h1, h2, id, version, at, open, many): lines that go (open false), and
    the lines of the first min_docs - 1 documents of the partition's first and last key
    (open true), where `many` says whether the key already has min_docs documents here.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_many, begins = None, False, True
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            if not table.num_rows:
                continue
            column = {n: table.column(n).combine_chunks() for n in ("h1", "h2", "id")}
            run_starts = _changes(column["h1"]) | _changes(column["h2"])
            run = np.cumsum(run_starts) - 1
            doc = np.cumsum(run_starts | _changes(column["id"]))
            nth = doc - doc[run_starts][run]
            most = np.maximum.reduceat(nth, np.flatnonzero(run_starts))
            many = most >= min_docs - 1
            many[0] |= held_many
            last = run == run[-1]
            first = (run == 0) & begins
            gone = np.where(last | first, nth >= min_docs - 1, (nth >= 1) & many[run])
            yield _marked(table, gone, False, many[run])
            held = table.filter(pa.array(last & (nth < min_docs - 1)))
            held_many = bool(many[-1])
            if run[-1] > 0:
                yield _marked(table, first & (nth < min_docs - 1), True, many[run])
                begins = False
        if held is not None:
            yield _marked(held, np.ones(held.num_rows, bool), True, np.full(held.num_rows, held_many))

    return rows


def _marked(table: pa.Table, which: np.ndarray, open_: bool, many: np.ndarray) -> pa.RecordBatch:
    part = table.filter(pa.array(which)).combine_chunks()
    columns = [part.column(n).combine_chunks() for n in ("h1", "h2", "id", "version", "at")]
    flags = [pa.array(np.full(part.num_rows, open_)), pa.array(many[which])]
    return pa.record_batch(columns + flags, ["h1", "h2", "id", "version", "at", "open", "many"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, version, keep): a compressed keep bitmap for each document that loses a line.

    keep is zlib over packed bits, one for each line, in whole bytes up to the last line
    that goes; the lines after it stay. min_docs is 2 at least. `version` is the hash of the text (see `identified`).
    """
    own = identified(docs, id_col, text_col)
    keys = _keys(own, min_chars)
    order = [F.col("h1"), F.col("h2"), F.col("id").desc_nulls_last(), F.col("version"), F.col("at")]
    kinds = f"{keys.schema['id'].dataType.simpleString()}"
    schema = f"h1 long, h2 long, id {kinds}, version long, at int, open boolean, many boolean"
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ordered.mapInArrow(_streamed(min_docs), schema), "line-keys")
    who = F.struct(F.col("id").isNotNull().alias("some"), F.col("id"))
    opened = found.filter("open")
    settled = opened.groupBy("h1", "h2").agg(
        F.max(who).alias("stays"),
        (F.max("many") | (F.count_distinct(who) >= min_docs)).alias("enough"),
    )
    late = (
        opened.join(settled.filter("enough"), ["h1", "h2"])
        .filter(who != F.col("stays"))
        .select("id", "version", "at")
    )
    gone = found.filter("not open").select("id", "version", "at").union(late)
    listed = gone.groupBy("id", "version").agg(F.collect_set("at").alias("gone"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lines in batch.column(2):
                at = np.asarray(lines.values)
                keep = np.ones((at.max() // 8 + 1) * 8, bool)
                keep[at] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(maps, pa.binary())],
                ["id", "version", "keep"],
            )

    return listed.mapInArrow(packed, f"id {kinds}, version long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> list[str]:
    """The lines of a text that its bitmap keeps; no bitmap keeps all."""
    lines = text.split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    return [x for x, bit in zip(lines, bits) if bit] + lines[len(bits) :]


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of docs, the text without the lines that go."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)

    def change(texts: pa.Array, keeps: pa.Array) -> pa.Array:
        return pa.array(
            [t if k is None else "\n".join(kept_lines(t or "", k))
             for t, k in zip(texts.to_pylist(), keeps.to_pylist())],
            pa.string(),
        )

    return with_text(docs, text_col, maps, "keep", id_col, change)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256), one row for each input row."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    own = identified(docs, id_col, text_col)
    joined = own.join(maps, same(own, maps), "left").select(own["id"], own["body"], maps["keep"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, digests = [], [], []
            for text, keep in zip(batch.column(1), batch.column(2)):
                body = text.as_py()
                kept = kept_lines(body, keep.as_py())
                total.append(body.count("\n") + 1)
                dropped.append(total[-1] - len(kept))
                digests.append(hashlib.sha256("\n".join(kept).encode("utf-8")).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(digests)],
                ["id", "n_lines", "n_dropped", "kept_sha256"],
            )

    kind = own.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(rows, f"id {kind}, n_lines long, n_dropped long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
