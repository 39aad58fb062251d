"""Quality rules: robust multivariate outliers of text statistics.

Every text gives counts (words, their characters, symbols, repeated lines, words in repeated
three-word windows) and from them a vector of transformed statistics. For each language and
source a minimum-covariance-determinant estimate of centre and spread is found by concentration
steps: start from medians and median deviations, then repeatedly take the mean and covariance
of the SUBSET part of the rows that are nearest by the last estimate. All rows take part in
each step, as aggregates that combine on the map side, so a source with a third of all rows
costs no more than others. Texts beyond CUTOFF in squared Mahalanobis distance are rejected.

Groups of fewer than LEAST_ROWS rows are judged together with the other small groups of their
language; if those are still too few, the rules on counts alone decide. Null language or
source is a group of its own. Null and empty texts have no word and fail. Repeated rows count
as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.arrays import Chunk, Rolling, chunks, mixed
from loanloom.llm.frames import written

SUBSET = 0.75
STEPS = 4
LEAST_ROWS = 50
CUTOFF = 50.0
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
ACCURACY = 2000

# Least standard deviation of each statistic, so that one that hardly varies rejects nothing by itself.
STATISTICS = ("log_words", "word_length", "symbols", "repeats", "repeated_lines")
FLOORS = (0.5, 0.4, 0.08, 0.12, 0.12)
# Variance of all rows of a normal distribution of five statistics against that of its nearest three quarters.
WIDEN = 1.6

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def counts(chunk: Chunk) -> list[np.ndarray]:
    """COUNTS of each text of a chunk."""
    data, bounds, n = chunk.data, chunk.bounds, len(chunk)
    words = chunk.words()
    first = words.first
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    inside = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    chars = _per_doc(inside & ((data & 0xC0) != 0x80), bounds)
    symbols = _per_doc(_SYMBOL[data], bounds)
    # Lines: cut at every newline and at the ends of the texts.
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([bounds[1:], breaks]))
    rolling = Rolling(chunk.symbols())
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    lines = _per_doc(data == 10, bounds) + 1
    line_hash = rolling.spans(starts[has_word], ends[has_word])
    owner = np.searchsorted(bounds, starts[has_word], side="right") - 1
    distinct = _distinct_per_doc(line_hash, owner, n)
    dup_lines = np.bincount(owner, minlength=n)[:n] - distinct
    # Three-word windows: equal ones inside a text mark their words.
    per_doc = words.counts()
    repeat = np.zeros(n, np.int64)
    if len(words) >= 3:
        hashes = rolling.spans(words.starts, words.ends)
        doc = words.doc()
        whole = doc[2:] == doc[:-2]
        at = np.flatnonzero(whole)
        windows = Rolling(hashes).spans(at, at + 3)
        key = mixed(windows ^ mixed(doc[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        twin = np.zeros(len(ranked), bool)
        if len(ranked) > 1:
            equal = ranked[1:] == ranked[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
        marked = np.zeros(len(words) + 3, np.int32)
        hit = at[order[twin]]
        np.add.at(marked, hit, 1)
        np.add.at(marked, hit + 3, -1)
        covered = np.cumsum(marked[: len(words)]) > 0
        repeat = _per_doc(covered, first)
    return [per_doc, chars, symbols, dup_lines, repeat, lines]


def _distinct_per_doc(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n)[:n]


def text_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                ) -> DataFrame:
    """The kept columns of docs and COUNTS of every whole text."""
    source = docs.select(*[docs[c] for c in keep], docs[text_col].alias("body_of_text"))
    last = len(keep)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(last)):
                part = batch.slice(chunk.first, len(chunk))
                own = [pa.array(x.astype(np.int64)) for x in counts(chunk)]
                yield pa.record_batch([*part.columns[:last], *own], [*keep, *COUNTS])

    schema = source.drop("body_of_text").schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return source.mapInArrow(rows, schema)


def _statistics() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words")),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    ]


def _distance(width: int) -> Column:
    """Squared Mahalanobis distance of columns x0.. from `centre` by the matrix `inverse`."""
    total = F.lit(0.0)
    d = [F.col(f"x{i}") - F.col("centre")[i] for i in range(width)]
    for i in range(width):
        for j in range(i, width):
            times = 1.0 if i == j else 2.0
            total = total + F.lit(times) * d[i] * d[j] * F.col("inverse")[i * width + j]
    return total


def _estimates(moments: DataFrame, width: int) -> DataFrame:
    """(part, centre, inverse) from the sums of the nearest rows of each group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, inverses = [], []
            for n, sums, products in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                centre = np.array(sums) / n
                spread = np.zeros((width, width))
                upper = np.triu_indices(width)
                spread[upper] = np.array(products) / n - np.outer(centre, centre)[upper]
                spread = spread + np.triu(spread, 1).T
                # The nearest rows are too narrow for all rows: widen, then apply the floors.
                spread = spread * WIDEN + np.diag(np.square(FLOORS))
                centres.append(centre.tolist())
                inverses.append(np.linalg.inv(spread).ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.record_batch(
                [batch.column(0), pa.array(centres, kind), pa.array(inverses, kind)],
                ["part", "centre", "inverse"],
            )

    return moments.mapInArrow(rows, "part string, centre array<double>, inverse array<double>")


def fit(rows: DataFrame) -> DataFrame:
    """(part, centre, inverse) for each part of rows (part, x0, x1, ..)."""
    width = len(STATISTICS)
    xs = [f"x{i}" for i in range(width)]
    half = rows.groupBy("part").agg(
        *[F.percentile_approx(x, 0.5, ACCURACY).alias(f"m_{x}") for x in xs]
    )
    apart = rows.join(written(half, "medians"), "part").groupBy("part").agg(
        F.array(*[F.first(f"m_{x}") for x in xs]).alias("centre"),
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, ACCURACY).alias(f"s_{x}") for x in xs],
    )
    cells = [
        1 / (F.pow(F.col(f"s_x{i}") * 1.4826, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)
        for i in range(width)
        for j in range(width)
    ]
    model = written(apart.select("part", "centre", F.array(*cells).alias("inverse")), "start")
    for _ in range(STEPS):
        near = rows.join(model, "part").withColumn("d", _distance(width))
        limit = near.groupBy("part").agg(F.percentile_approx("d", SUBSET, ACCURACY).alias("limit"))
        inner = near.join(written(limit, "limits"), "part").filter("d <= limit")
        products = [F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(width) for j in range(i, width)]
        moments = inner.groupBy("part").agg(
            F.count("*").alias("n"),
            F.array(*[F.sum(x) for x in xs]).alias("sums"),
            F.array(*products).alias("products"),
        )
        model = written(_estimates(moments, width), "centres")
    return model


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source") -> DataFrame:
    """Counts, distance and verdict of every row.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance); distance is null where no group is large enough.
    """
    source = docs.select(
        docs[id_col].alias("id"), docs[text_col].alias("text"),
        F.to_json(F.struct(docs[lang_col].alias("l"))).alias("lang"),
        F.to_json(F.struct(docs[lang_col].alias("l"), docs[source_col].alias("s"))).alias("part"),
    )
    counted = text_counts(source, "text", ("id", "lang", "part"))
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    stats = [c.alias(f"x{i}") for i, c in enumerate(_statistics())]
    table = written(counted.select("*", base.alias("base_failed"), *stats), "statistics")
    usable = table.filter("n_words > 0")
    sizes = usable.groupBy("part", "lang").agg(F.count("*").alias("rows"))
    small = F.when(F.col("rows") >= LEAST_ROWS, F.col("part")).otherwise(F.col("lang"))
    group = written(sizes.select("part", small.alias("group")), "groups")
    ranked = usable.join(group, "part").select(
        F.col("group").alias("part"), *[f"x{i}" for i in range(len(STATISTICS))]
    )
    enough = ranked.groupBy("part").agg(F.count("*").alias("rows")).filter(F.col("rows") >= LEAST_ROWS)
    model = fit(ranked.join(enough.select("part"), "part", "left_semi"))
    verdicts = group.join(model.withColumnRenamed("part", "group"), "group", "left")
    out = table.join(verdicts.select("part", "centre", "inverse"), "part", "left")
    far = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return out.withColumn("distance", _distance(len(STATISTICS))).select(
        F.col("id").alias(id_col), *COUNTS[:5], "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "distance",
    )
