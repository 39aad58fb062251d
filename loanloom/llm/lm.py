"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of a text (`[^\\x20\\x09-\\x0D]+`, A-Z in lower case), then one end. The
probability of a token is that of its class given the tokens before it, times its probability
within the class. Classes are ranges of the most frequent training tokens with about
equal numbers of occurrences, and one class for all others. The class is predicted by a
maximum-entropy model over hashed n-gram and skip features (the last token, the two before it
each with a gap, the last two together). Within a class the model has one feature for each
token, whose optimum is the relative frequency; the last class holds every token that training saw once, and keeps a
Good-Turing share for tokens never seen. How many tokens are sent does not change that share.

Counts cover all training texts. Weights are trained in ROUNDS passes, each over its own part of
the training texts: every task runs stochastic gradient updates over its texts and sends the
change of the rows it touched; changes are summed in two steps and averaged. Frequent tokens,
FREQUENT at most, and the weights, ROWS x CLASSES, are sent to the tasks; counts of all other
tokens are joined.

Null and empty texts are one end token. With no training text at all every token is unknown. A
null id is in training. Repeated rows get equal scores; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.arrays import Chunk, chunks, mixed
from loanloom.llm.frames import written

FREQUENT = 1 << 18
GIVEN = 0.9  # part of the occurrences of tokens seen once that unseen tokens get
STEPS = 16  # steps of frequency to a doubling
NAMED = 1 << 12  # tokens that are a feature of their own; others count as their class
CLASSES = 64
ROWS = 1 << 15
FEATURES = 5
ROUNDS = 2
BATCH = 4096
FEW = 8
RATE = 0.25
BLOCK_ROWS = 512
SALTS = 16

END = int(mixed(np.array([0xE0F], np.uint64))[0])
BEGIN = np.uint64(0xB0B)


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text) of a chunk; every text ends with END."""
    words = chunk.lowered().words()
    hashes = words.hashes()
    first = words.first + np.arange(len(chunk) + 1)
    out = np.full(len(words) + len(chunk), END, np.uint64)
    out[np.arange(len(words)) + words.doc()] = hashes
    return out, first


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(token, n): occurrences of every token hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, counts = [], []
            for chunk in chunks(batch.column(0)):
                own, n = np.unique(tokens(chunk)[0], return_counts=True)
                seen.append(own)
                counts.append(n)
            if not seen:
                continue
            own, inverse = np.unique(np.concatenate(seen), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(counts), len(own)).astype(np.int64)
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(n)], ["token", "n"])

    found = docs.select(docs[text_col].alias("body")).mapInArrow(rows, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent tokens in order of their hash, with counts and classes, and the totals."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    ranks: np.ndarray
    total: int
    distinct: int
    once: int

    @property
    def tail(self) -> int:
        """Occurrences of the tokens of the last class."""
        return self.total - int(self.counts.sum())

    @property
    def unseen(self) -> float:
        """Share of the last class for tokens that training never saw: GIVEN * once / total of all."""
        if not self.tail:
            return 1.0
        return GIVEN * self.once / self.tail if self.once else GIVEN / (self.tail + 1)

    def seen(self, n: Column) -> Column:
        """Share of the last class for a token of it that training saw n times.

        Only tokens seen once give to the unseen ones, so that no share depends on FREQUENT.
        """
        rest = 1.0 if self.once else 1.0 - self.unseen
        return F.when(n == 1, 1.0 - GIVEN).otherwise(n * rest) / float(max(self.tail, 1))

    def mass(self) -> np.ndarray:
        out = np.bincount(self.classes, self.counts, CLASSES)
        out[CLASSES - 1] += self.tail
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent ones; -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent part of the counts and the totals of all of them."""
    total = counts.agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")
    ).first()
    # Whole steps of frequency, from the highest down, that hold FREQUENT tokens at most.
    step = F.floor(F.log2("n") * STEPS)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, held = 64 * STEPS, 0
    for at, size in sorted(sizes, reverse=True):
        held += size if at else 0
        if held > FREQUENT:
            break
        least = at
    # Tokens seen once are in the last class at every size.
    top = counts.filter((step >= least) & (F.col("n") > 1)).toPandas()
    top = top.sort_values(["n", "token"], ascending=[False, True])
    n = top["n"].to_numpy(np.int64)
    # Classes: equal shares of the occurrences, the most frequent tokens first.
    share = (np.cumsum(n) - n / 2) / max(int(n.sum()), 1)
    classes = np.minimum((share * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
    hashes = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(
        hashes[order], n[order], classes[order], order, total["n"] or 0, total["v"], total["once"]
    )


def examples(chunk: Chunk, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows, class, place) of every token of a chunk, and the first token of each text."""
    hashes, first = tokens(chunk)
    place = words.find(hashes)
    known = place >= 0
    classes = np.full(len(hashes), CLASSES - 1, np.int64)
    classes[known] = words.classes[place[known]]
    rank = np.full(len(hashes), FREQUENT, np.int64)
    rank[known] = words.ranks[place[known]]
    name = np.where(rank < NAMED, hashes, classes.astype(np.uint64))
    back = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))

    def before(steps: int) -> np.ndarray:
        out = np.full(len(hashes), BEGIN, np.uint64)
        out[steps:] = name[: len(hashes) - steps]
        out[back < steps] = BEGIN
        return out

    last, second, third = before(1), before(2), before(3)
    keys = [np.zeros(len(hashes), np.uint64), last, second, third, mixed(last) ^ second]
    rows = [mixed(k + np.uint64(i << 56)) % np.uint64(ROWS - 1) + np.uint64(1) for i, k in enumerate(keys)]
    rows[0][:] = 0
    return np.stack(rows, axis=1).astype(np.int32), classes, place, first


def start_weights(words: Vocabulary) -> np.ndarray:
    """Weights that give every class its share of the training tokens."""
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[0] = np.log((words.mass() + 0.5) / (words.total + 0.5 * CLASSES))
    return weights


def class_logs(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural logarithms of all class probabilities for each row of features."""
    logits = weights[rows[:, 0]]
    for i in range(1, FEATURES):
        logits = logits + weights[rows[:, i]]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def grouped_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches of rows that begin at starts; most are one or a few rows long."""
    size = np.diff(np.append(starts, len(values)))
    sums = values[starts]
    few = np.flatnonzero((size > 1) & (size <= FEW))
    for step in range(1, FEW):
        few = few[size[few] > step]
        sums[few] += values[starts[few] + step]
    for long in np.flatnonzero(size > FEW):
        sums[long] = values[starts[long] : starts[long] + size[long]].sum(axis=0)
    return sums


def update(weights: np.ndarray, scale: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step over a batch; scale collects squared gradients of each row."""
    slope = weights[rows[:, 1]]
    for i in range(2, FEATURES):
        slope += weights[rows[:, i]]
    slope += weights[0]
    slope -= slope.max(axis=1, keepdims=True)
    np.exp(slope, out=slope)
    slope /= -slope.sum(axis=1, keepdims=True)
    slope[np.arange(len(classes)), classes] += 1.0
    # The first feature is the same everywhere; the others are summed by row.
    flat = rows[:, 1:].astype(np.uint16).ravel()
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sums = grouped_sums(slope[order // (FEATURES - 1)], starts)
    sums = np.concatenate([slope.sum(axis=0, keepdims=True), sums])
    own = np.append(0, ranked[starts].astype(np.int64))
    scale[own] += np.einsum("ij,ij->i", sums, sums)
    weights[own] += sums * (RATE / np.sqrt(scale[own] + 1.0))[:, None]


def _trained(words: Vocabulary, weights: np.ndarray):
    """Changes of the weights after one pass over a task's texts, by block of rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scale = weights.copy(), np.zeros(ROWS, np.float32)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                found, classes, _, _ = examples(chunk, words)
                for i in range(0, len(classes), BATCH):
                    update(own, scale, found[i : i + BATCH], classes[i : i + BATCH])
        touched = scale > 0
        if touched.any():
            yield from _changes_of(own - weights, touched.astype(np.float32))

    return rows


def _changes_of(change: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = np.arange(ROWS // BLOCK_ROWS)
    change = change.astype(np.float16).reshape(len(blocks), -1)
    times = times.reshape(len(blocks), -1)
    used = [b for b in blocks.tolist() if times[b].any()]
    yield pa.record_batch(
        [pa.array(used, pa.int32()), pa.array([change[b].tobytes() for b in used], pa.binary()),
         pa.array([times[b].tobytes() for b in used], pa.binary())],
        ["block", "change", "times"],
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of each block, weighted by how many tasks touched a row; one block at a time in memory."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, change, times in zip(*[batch.column(n).to_pylist() for n in ("block", "change", "times")]):
            n = np.frombuffer(times, np.float32)
            x = np.frombuffer(change, np.float16).astype(np.float32).reshape(BLOCK_ROWS, CLASSES)
            if block not in sums:
                sums[block] = [np.zeros((BLOCK_ROWS, CLASSES), np.float32), np.zeros(BLOCK_ROWS, np.float32)]
            sums[block][0] += x * n[:, None]
            sums[block][1] += n
    for block, (x, n) in sums.items():
        mean = (x / np.maximum(n, 1.0)[:, None]).astype(np.float16)
        yield pa.record_batch(
            [pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary()),
             pa.array([n.tobytes()], pa.binary())],
            ["block", "change", "times"],
        )


def train(docs: DataFrame, text_col: str, words: Vocabulary) -> np.ndarray:
    """Weights after ROUNDS passes, each over its own part of the documents."""
    weights = start_weights(words)
    schema = "block int, change binary, times binary"
    part = F.pmod(F.xxhash64(docs[text_col]), F.lit(ROUNDS))
    for r in range(ROUNDS):
        texts = docs.filter(part == r).select(docs[text_col].alias("body"))
        sent = texts.mapInArrow(_trained(words, weights), schema)
        salted = sent.withColumn("salt", F.spark_partition_id() % SALTS)
        partial = salted.repartition("block", "salt").select("block", "change", "times")
        whole = partial.mapInArrow(_summed, schema).repartition("block").mapInArrow(_summed, schema)
        weights = weights.copy()
        for row in whole.toLocalIterator():
            at = row["block"] * BLOCK_ROWS
            change = np.frombuffer(row["change"], np.float16).astype(np.float32)
            weights[at : at + BLOCK_ROWS] += change.reshape(BLOCK_ROWS, CLASSES)
    return weights


def _scored(words: Vocabulary, weights: np.ndarray, kind: str):
    """Sums of each text over its frequent tokens, and its other tokens for the join.

    Rows are (id, version, own, token, times, ..): own marks the text's row of sums.
    """
    mass = np.maximum(words.mass(), 1)
    inside = np.log10(np.maximum(words.counts, 1) / mass[words.classes])
    base = np.log10((words.counts + 1) / (words.total + words.distinct + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found, classes, place, first = examples(chunk, words)
                logs = np.empty(len(classes))
                for i in range(0, len(classes), BATCH):
                    part = class_logs(weights, found[i : i + BATCH])
                    logs[i : i + BATCH] = part[np.arange(len(part)), classes[i : i + BATCH]]
                score = logs / np.log(10.0)
                known = place >= 0
                score[known] += inside[place[known]]
                flat = np.where(known, base[np.where(known, place, 0)], 0.0) if len(base) else score * 0
                doc = np.repeat(np.arange(len(chunk)), np.diff(first))
                sums = [np.add.reduceat(x, first[:-1]) for x in (score, flat, known.astype(np.int64))]
                rest = np.flatnonzero(~known)
                rare = tokens(chunk)[0][rest]
                order = np.lexsort((rare, doc[rest]))
                of, rare = doc[rest][order], rare[order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (rare[1:] != rare[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(of)))
                n, pad = len(chunk), np.zeros(len(starts))
                # A text's own row takes part in the join under a spread key that is not looked at.
                key = np.concatenate([mixed(np.arange(n, dtype=np.uint64)), rare[starts]])
                take = pa.array(np.concatenate([np.arange(n), of[starts]]) + chunk.first)
                yield pa.record_batch(
                    [batch.column(0).take(take), batch.column(1).take(take),
                     pa.array(np.arange(n + len(starts)) < n), pa.array(key.view(np.int64)),
                     pa.array(np.concatenate([np.diff(first), times])),
                     pa.array(np.concatenate([sums[0], pad])), pa.array(np.concatenate([sums[1], pad])),
                     pa.array(np.concatenate([sums[2], pad.astype(np.int64)]))],
                    ["id", "version", "own", "token", "times", "score", "base", "known"],
                )

    return rows, (
        f"id {kind}, version long, own boolean, token long, times long, "
        "score double, base double, known long"
    )


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    training says which rows of docs are learnt from.
    """
    body = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(
        docs[id_col].alias("id"), F.xxhash64(body).alias("version"), body.alias("body"),
        training.alias("training"),
    )
    learnt = own.filter("training")
    counts = written(token_counts(learnt, "body"), "token-counts")
    words = vocabulary(counts)
    weights = train(learnt, "body", words)
    kind = own.schema["id"].dataType.simpleString()
    rows, schema = _scored(words, weights, kind)
    sums = own.select("id", "version", "body").mapInArrow(rows, schema)
    n, v = float(words.total), float(words.distinct)
    # Each token of the last class brings its share, by its count if training saw it.
    inner = F.when(F.col("n").isNull(), F.lit(float(np.log10(words.unseen)))).otherwise(
        F.log10(words.seen(F.col("n")))
    )
    flat = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(n + v + 1))
    met = F.when(F.col("n").isNull(), 0).otherwise(F.col("times"))
    parts = sums.join(counts, "token", "left").select(
        "id", "version", "own", "times",
        F.when(F.col("own"), F.col("score")).otherwise(F.col("times") * inner).alias("score"),
        F.when(F.col("own"), F.col("base")).otherwise(F.col("times") * flat).alias("base"),
        F.when(F.col("own"), F.col("known")).otherwise(met).alias("known"),
    )
    copies = F.count_if("own")
    by_text = parts.groupBy("id", "version").agg(
        F.max(F.when(F.col("own"), F.col("times"))).alias("n_tokens"),
        (F.sum("known") / copies).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.sum("base") / copies).alias("base_score"),
        (F.sum("score") / copies).alias("score"),
        copies.cast("int").alias("copies"),
    )
    each = by_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
