"""SimHash near-duplicates linked by Golay-code fuzzy hashing.

A text's fingerprint has a bit set if more than half of its word shingles' XXH64
hashes have it set. Two documents are linked if their fingerprints differ in at
most three bits; the result is the connected component of every document.

A fingerprint is cut into five segments. In the perfect binary Golay code of 23-bit words
every word has one codeword within distance 3. Of two segments that differ in one bit, either
both have the same nearest codeword, or each one's nearest lies at distance 4 from the other.
A key leaves out one segment, decodes two to codeword indices and takes two as they are.
The ten choices in CUTS are such that, however three errors fall, one of them has at most
one error in each decoded segment and none in those taken whole. A text has its nearest
codewords as a key on both sides of the join; the left side's further keys replace the first
index by those of the codewords at distance 4, the right side's the second, so two errors meet
in the middle. That is about 53 keys on a side, equal keys find every link, and the join verifies
the distance. Two whole segments and two decoded ones hold some 36 bits, so that pairs of
unrelated texts that share a key number 6e-10 times the square of the texts.

Work stays linear in groups of copies: equal fingerprints are one node; nodes that
share a neighbour at distance 1 are joined first through that neighbour (a bit mask
per neighbour, no pairs); the key join only returns links between different such groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.components import components
from loanloom.llm.frames import fresh, written

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42

# Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xAE3
LENGTH, CHECK_BITS = 23, 11
# (shift, bits) of each segment; (two decoded, two whole) of each key, the fifth left out.
SEGMENTS = ((51, 13), (38, 13), (25, 13), (12, 13), (0, 12))
CUTS = tuple(
    (((x + a) % 5, (x - a) % 5), ((x + 3 - a) % 5, (x - 3 + a) % 5)) for x in range(5) for a in (1, 2)
)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    body = b" ".join(words)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(body, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(body[s:e], SEED) for s, e in zip(starts, ends[shingle_words - 1 :].tolist())]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(n, 8), axis=1)
    packed = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n)
    return int.from_bytes(packed.tobytes(), "big")


class Golay:
    """Codewords near 23-bit words, as indices of 12 bits."""

    def __init__(self) -> None:
        powers = [self._remainder(1 << i) for i in range(LENGTH)]
        low, high = LENGTH - CHECK_BITS, CHECK_BITS
        self.low = self._xor_table(powers[:low])
        self.high = self._xor_table(powers[low:])
        assert len(self.high) == 1 << high
        self.nearest = np.full(1 << CHECK_BITS, -1, np.int64)
        self.others = np.full((1 << CHECK_BITS, 5), -1, np.int64)
        filled = np.zeros(1 << CHECK_BITS, int)
        for weight in range(5):
            for at in combinations(range(LENGTH), weight):
                error, syndrome = sum(1 << i for i in at), 0
                for i in at:
                    syndrome ^= powers[i]
                if weight < 4:
                    self.nearest[syndrome] = error
                else:
                    self.others[syndrome, filled[syndrome]] = error
                    filled[syndrome] += 1

    @staticmethod
    def _remainder(word: int) -> int:
        for i in range(LENGTH - 1, CHECK_BITS - 1, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - CHECK_BITS)
        return word

    @staticmethod
    def _xor_table(parts: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for part in parts:
            table = np.concatenate([table, table ^ part])
        return table

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Six indices for each word: nearest codeword, then those at distance 4 (-1: none)."""
        low = LENGTH - CHECK_BITS
        syndrome = self.low[words & ((1 << low) - 1)] ^ self.high[words >> low]
        out = np.empty((len(words), 6), np.int64)
        out[:, 0] = (words ^ self.nearest[syndrome]) >> CHECK_BITS
        others = self.others[syndrome]
        out[:, 1:] = np.where(others < 0, -1, (words[:, None] ^ others) >> CHECK_BITS)
        return out


_codes: list[Golay] = []


def link_keys(prints: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of every fingerprint on the left (0) or right (1) side of the join."""
    if not _codes:
        _codes.append(Golay())
    own = prints.view(np.uint64)
    whole = [(own >> np.uint64(s) & np.uint64((1 << bits) - 1)).astype(np.int64) for s, bits in SEGMENTS]
    near = [_codes[0].keys(x) for x in whole]
    rows, found = [], []
    for n, (decoded, taken) in enumerate(CUTS):
        rest = (n << 13 | whole[taken[0]]) << 13 | whole[taken[1]]
        words, fixed = near[decoded[side]], near[decoded[1 - side]][:, 0]
        row, at = np.nonzero(words >= 0)
        pair = (words[row, at], fixed[row])
        rows.append(row)
        found.append((rest[row] << 12 | pair[side]) << 12 | pair[1 - side])
    return np.concatenate(rows), np.concatenate(found)


def fingerprints(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and `print`, the signed 64-bit fingerprint of every row's text."""
    mark = fresh(docs.select(*keep), "body")
    source = docs.select(*keep, docs[text_col].alias(mark))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint((t.as_py() or "").encode("utf-8")) for t in batch.column(len(keep))],
                np.uint64,
            )
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*own, pa.array(prints.view(np.int64))], [*keep, "print"])

    schema = T.StructType([*source.drop(mark).schema.fields, T.StructField("print", T.LongType())])
    return source.mapInArrow(rows, schema)


def _close(nodes: DataFrame) -> DataFrame:
    """Edges that connect all nodes sharing a neighbour at distance 1, or being one."""
    bit = F.expr("CASE WHEN i < 64 THEN shiftleft(1L, i) ELSE 0L END")
    around = nodes.select("print", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    near = (
        around.select(F.col("print").bitwiseXOR(bit).alias("near"), bit.alias("bit"))
        .groupBy("near")
        .agg(F.bit_or("bit").alias("bits"), F.max(F.col("bit") == 0).alias("itself"))
        .filter(F.bit_count("bits") + F.col("itself").cast("int") > 1)
    )
    of = F.expr(
        "concat(IF(itself, array(near), array()), transform("
        "filter(sequence(0, 63), i -> getbit(bits, i) = 1), i -> near ^ shiftleft(1L, i)))"
    )
    members = near.select(F.explode(of).alias("a"), F.array_min(of).alias("b"))
    return members.filter("a <> b").distinct()


def _keyed(nodes: DataFrame, side: int) -> DataFrame:
    """(key, print, class): every key of every node on one side of the join."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                row, key = link_keys(np.asarray(part.column(0)), side)
                at = pa.array(row)
                columns = [pa.array(key), part.column(0).take(at), part.column(1).take(at)]
                yield pa.record_batch(columns, ["key", "print", "class"])

    return nodes.select("print", "class").mapInArrow(rows, "key long, print long, class long")


def link_classes(prints: DataFrame) -> DataFrame:
    """(print, class): the component, as its smallest fingerprint, of every distinct fingerprint."""
    # Few bytes become many rows below, so their number of partitions is not left to their size.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(prints.select("print").distinct(), "prints")
    near = components(_close(nodes.repartition(parts, "print")), "a", "b").withColumnRenamed("node", "print")
    classed = written(
        nodes.join(near, "print", "left").select("print", F.coalesce("root", "print").alias("class")),
        "classes",
    )
    spread = classed.repartition(parts, "print")
    # The keys are some 53 times the rows that Spark sizes them by, so neither side is broadcast.
    left, right = (_keyed(spread, i).alias(side).hint("merge") for i, side in enumerate("lr"))
    apart = F.expr("bit_count(l.print ^ r.print)")
    links = (
        left.join(right, F.expr("l.key = r.key AND l.class <> r.class") & (apart <= RADIUS))
        .select(F.greatest("l.class", "r.class").alias("a"), F.least("l.class", "r.class").alias("b"))
        .distinct()
    )
    far = components(links, "a", "b").withColumnRenamed("node", "class")
    return classed.join(far, "class", "left").select(
        "print", F.coalesce("root", "class").alias("class")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row for each input row.

    component_id is the smallest id that links reach, the row's own included. Texts
    without a word have fingerprint zero and are linked like any other. Repeated rows
    fall into the same component; component_id is null only where no row of the component has
    an id. An empty table gives an empty result.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    prints = written(fingerprints(own, "text", ["id"]), "fingerprints")
    classes = written(link_classes(prints), "link-classes")
    least = (
        prints.groupBy("print").agg(F.min("id").alias("id"))
        .join(classes, "print").groupBy("class").agg(F.min("id").alias("component_id"))
    )
    of = classes.join(least, "class").select("print", "component_id")
    return prints.join(of, "print").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: that of the smallest id, null ids last.

    Rows that repeat an id and a text are one; rows that share only the id are told apart by
    hashes of both.
    """
    first, second = fresh(docs, "identity"), fresh(docs, "version")
    body = F.coalesce(docs[text_col], F.lit(""))
    marked = docs.withColumns({first: F.xxhash64(docs[id_col], body), second: F.hash(body)})
    own = marked.select(
        F.col(id_col).alias("id"), F.col(first).alias("first"), F.col(second).alias("second"),
        F.col(text_col).alias("text"),
    )
    prints = written(fingerprints(own, "text", ["id", "first", "second"]), "fingerprints")
    classes = written(link_classes(prints), "link-classes")
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "first", "second")).alias("one")
    chosen = (
        prints.groupBy("print").agg(order).join(classes, "print")
        .groupBy("class").agg(F.min("one").alias("one"))
        .select(F.col("one.first").alias(first), F.col("one.second").alias(second))
    )
    kept = marked.join(chosen.distinct(), [first, second], "left_semi")
    return kept.dropDuplicates([first, second]).select(*docs.columns)
