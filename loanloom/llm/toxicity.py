"""Toxicity by class-conditional Kneser-Ney models.

Two models of words, one learnt from toxic and one from ordinary documents, give every word of a
text two probabilities. What a document is judged by is the mean of their log ratio over all its
words, and the highest mean over PASSAGE words in a row, since a few words make a long text toxic.
A logistic curve of both gives the score.

Probabilities are interpolated Kneser-Ney estimates whose outermost context is the class:

* of a word after another: discounted count of the pair in the class, then
* of a word: discounted count of the word in the class, then
* shared by both classes: in how many classes (1 or 2) the word occurs, half a class for an unknown word.

A count is the number of distinct texts that hold the expression. A rare expression thus gets most
of its probability from what the classes share and says little; one that is frequent in one class
and absent in the other keeps its full ratio. A word is a context for the next one only if each
class has it in CONTEXT texts: behind rarer words the next one only tells copies apart.

The models are fitted on a bounded sample of labelled texts, for each class at most about SAMPLE_DOCS
texts and SAMPLE_BYTES bytes, chosen by a hash of id and text; texts that repeat with the same label
count once. The curve is fitted on the same texts, each judged by models learnt from the other
half, and weighted so that the sampled classes have the shares they have among all labels.

Words are runs of letters in lower case. Texts are read whole, whatever their length. Null texts and
texts without a letter have both means 0, hence the score of a text that says nothing either way. Null
labels never train; repeated rows get equal scores; a null id is allowed. Without labelled texts of
both classes every score is 1 if only toxic ones are there, else 0. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.arrays import Chunk, chunks, mixed
from loanloom.llm.frames import fresh, written

SAMPLE_DOCS = 5_000
SAMPLE_BYTES = 4 << 20
CONTEXT = 200
PASSAGE = 8
FOLDS = 2
RIDGE = 1e-3
THRESHOLD = 0.3

_NONE = np.uint64(0)


def word_chunks(texts: pa.Array) -> Iterator[Chunk]:
    """Texts with a space for everything but letters, in lower case."""
    lowered = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    return chunks(pc.replace_substring_regex(lowered, r"[^\p{L}]+", " "))


def pair_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key for each word and the one before it; 0 at the first word of a document."""
    out = np.zeros(len(words), np.uint64)
    out[1:] = mixed(mixed(words[:-1]) ^ words[1:])
    out[first[first < len(words)]] = 0
    return out


class Counts:
    """Numbers of texts by class and expression: words by hash, pairs by key of their words."""

    def __init__(self, words: np.ndarray, of_words: np.ndarray, pairs: np.ndarray, of_pairs: np.ndarray,
                 heads: np.ndarray):
        """of_*: two rows of counts, ordinary and toxic; heads: the first word of every pair."""
        self.words, self.of_words = words, of_words.astype(float)
        self.pairs, self.of_pairs, self.heads = pairs, of_pairs.astype(float), heads


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discount of every count: of one, two, and three or more, from the counts of counts."""
    n = [max(1.0, float((counts == k).sum())) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    by = np.array([0.0, *(min(k, max(0.1 * k, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))])
    return by[np.minimum(counts, 3).astype(int)]


class Model:
    """Log ratios of the two classes' probabilities for the words of texts."""

    def __init__(self, counts: Counts, least: float = CONTEXT):
        order = np.argsort(counts.words)
        self.words, of = counts.words[order], counts.of_words[:, order]
        shared = np.count_nonzero(of, axis=0) + 0.5
        shared, self.unknown = shared / (shared.sum() + 0.5), 0.5 / (shared.sum() + 0.5)
        totals = np.maximum(of.sum(axis=1), 1.0)
        taken = np.stack([discounts(x) for x in of])
        rest = np.where(of.sum(axis=1) > 0, taken.sum(axis=1) / totals, 1.0)
        # One more column for words that neither class has.
        self.single = np.concatenate(
            [(of - taken) / totals[:, None] + rest[:, None] * shared, (rest * self.unknown)[:, None]], axis=1
        )
        self.contexts = np.concatenate([of.min(axis=0) >= least, [False]])
        self._fit_pairs(counts)

    def _fit_pairs(self, counts: Counts) -> None:
        order = np.argsort(counts.pairs)
        self.pairs, of = counts.pairs[order], counts.of_pairs[:, order]
        head = self.places(self.words, counts.heads[order])
        taken = np.stack([discounts(x) for x in of])
        self.followed = np.stack([np.bincount(head, x, len(self.words) + 1) for x in of])
        left = np.stack([np.bincount(head, x, len(self.words) + 1) for x in taken])
        self.rest = np.where(self.followed > 0, left / np.maximum(self.followed, 1), 1.0)
        own = (of - taken) / np.maximum(self.followed[:, head], 1)
        self.double = np.concatenate([own, np.zeros((2, 1))], axis=1)

    @staticmethod
    def places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each key stands among the known ones; their number if it doesn't."""
        at = np.searchsorted(known, keys)
        found = at < len(known)
        found[found] = known[at[found]] == keys[found]
        return np.where(found, at, len(known))

    def ratios(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = self.places(self.words, words)
        p = self.single[:, at]
        before = np.full(len(at), len(self.words))
        before[1:] = at[:-1]
        before[first[first < len(at)]] = len(self.words)
        use = np.flatnonzero(self.contexts[before])
        if len(use):
            pair = self.places(self.pairs, pair_keys(words, first)[use])
            p[:, use] = self.double[:, pair] + self.rest[:, before[use]] * p[:, use]
        return np.log(p[1]) - np.log(p[0])

    def means(self, texts: pa.Array) -> np.ndarray:
        """For each text, the mean log ratio and the highest mean over a passage."""
        out = np.zeros((len(texts), 2))
        for chunk in word_chunks(texts):
            found = chunk.words()
            ratio = self.ratios(found.hashes(), found.first)
            for i in np.flatnonzero(found.counts()):
                own = ratio[found.first[i] : found.first[i + 1]]
                size = min(PASSAGE, len(own))
                sums = np.concatenate([[0.0], np.cumsum(own)])
                out[chunk.first + i] = sums[-1] / len(own), (sums[size:] - sums[:-size]).max() / size
        return out


class Scorer:
    """The models and the curve over their means."""

    def __init__(self, model: Model | None, weights: np.ndarray | None, otherwise: float = 0.0):
        self.model, self.weights, self.otherwise = model, weights, otherwise

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.otherwise)
        x = self.model.means(texts)
        return 1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, the intercept first, by Newton steps with a small ridge."""
    z = np.column_stack([np.ones(len(x)), x])
    weight = weight / weight.sum() * len(x)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ ((y - p) * weight) - RIDGE * w
        bend = (z * (p * (1 - p) * weight)[:, None]).T @ z + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
           label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """(body, toxic, fold) of the sampled distinct texts, and the share of each class among all.

    Documents meet their labels by id, hash and size; only the sampled ones with their text.
    """
    body = F.coalesce(docs[text_col], F.lit(""))
    own = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], body).alias("hash"), body.alias("body"))
    given = labels.filter(labels[label_col].isNotNull()).select(
        labels[id_col].alias("id"), (labels[label_col] != 0).cast("int").alias("toxic")
    )
    sized = own.select("id", "hash", F.octet_length("body").cast("long").alias("size"))
    rows = written(sized.join(given, "id").select("id", "hash", "size", "toxic"), "toxicity-labelled")
    totals = {r["toxic"]: r for r in rows.groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    n = sum(r["n"] for r in totals.values())
    part = {k: min(1.0, SAMPLE_DOCS / r["n"], SAMPLE_BYTES / max(r["bytes"], 1)) for k, r in totals.items()}
    place = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    limit = F.when(F.col("toxic") == 1, part.get(1, 0.0)).otherwise(part.get(0, 0.0))
    # A text longer than a tenth of the bound is too large a part of it.
    picked = rows.filter((place < limit) & (F.col("size") <= SAMPLE_BYTES // 10)).select("id", "hash", "toxic")
    # About 2 * SAMPLE_DOCS rows at most, whatever the input.
    chosen = own.join(F.broadcast(picked.distinct()), ["id", "hash"]).select("body", "toxic").distinct()
    fold = F.pmod(F.xxhash64("body", F.lit("fold")), F.lit(FOLDS)).cast("int")
    return chosen.withColumn("fold", fold), {k: r["n"] / n for k, r in totals.items()}


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, key, toxic, fold, n): words (head 0) and pairs of each text once, counted by chunk."""
    for batch in batches:
        kind = np.asarray(batch.column(1)) * FOLDS + np.asarray(batch.column(2))
        for chunk in word_chunks(batch.column(0)):
            found = chunk.words()
            words, doc = found.hashes(), found.doc()
            pairs = pair_keys(words, found.first)
            inner = np.flatnonzero(pairs)
            head = np.concatenate([np.zeros(len(words), np.uint64), words[inner - 1]])
            key = np.concatenate([words, pairs[inner]])
            of = np.concatenate([doc, doc[inner]])
            once = np.unique(np.rec.fromarrays([head, key, of], names="head,key,of"))
            group = np.rec.fromarrays([once.head, once.key, kind[chunk.first + once.of]], names="head,key,kind")
            rows, n = np.unique(group, return_counts=True)
            yield pa.record_batch(
                [pa.array(rows.head.view(np.int64)), pa.array(rows.key.view(np.int64)),
                 pa.array(rows.kind.astype(np.int32)), pa.array(n)],
                ["head", "key", "kind", "n"],
            )


def _tables(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, key, counts by toxic and fold) of all words, and of pairs behind a possible context."""
    found = chosen.mapInArrow(_expressions, "head long, key long, kind int, n long")
    kinds = range(2 * FOLDS)
    by = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in kinds]
    counts = written(found.groupBy("head", "key").agg(*by), "toxicity-counts")
    classes = [sum(F.col(f"n{c * FOLDS + f}") for f in range(FOLDS)) for c in (0, 1)]
    contexts = counts.filter((F.col("head") == 0) & (F.least(*classes) >= CONTEXT)).select(F.col("key").alias("head"))
    pairs = counts.filter("head <> 0").join(contexts, "head", "left_semi")
    table = counts.filter("head = 0").unionByName(pairs).toArrow()
    column = {name: table[name].to_numpy() for name in table.column_names}
    order = np.lexsort([column["key"], column["head"]])
    head, key = (column[x][order].view(np.uint64) for x in ("head", "key"))
    return head, key, np.stack([column[f"n{k}"][order] for k in kinds]).reshape(2, FOLDS, -1)


def _model(tables: tuple[np.ndarray, np.ndarray, np.ndarray], without: int | None = None) -> Model:
    head, key, counts = tables
    kept = [f for f in range(FOLDS) if f != without]
    of = counts[:, kept].sum(axis=1)
    word, there = head == _NONE, of.sum(axis=0) > 0
    a, b = word & there, ~word & there
    least = CONTEXT * len(kept) / FOLDS
    return Model(Counts(key[a], of[:, a], key[b], of[:, b], head[b]), least)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Scorer:
    """Models and curve from the documents that have a label; 0 is ordinary, any other toxic."""
    chosen, shares = sample(docs, labels, id_col, text_col, label_col)
    if len(shares) < 2:
        return Scorer(None, None, 1.0 if 1 in shares else 0.0)
    chosen = written(chosen, "toxicity-sample")
    tables = _tables(chosen)
    halves = [_model(tables, f) for f in range(FOLDS)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(2))
            means = np.zeros((len(fold), 2))
            for f, model in enumerate(halves):
                own = np.flatnonzero(fold == f)
                means[own] = model.means(batch.column(0).take(pa.array(own)))
            yield pa.record_batch(
                [batch.column(1), pa.array(means[:, 0]), pa.array(means[:, 1])], ["toxic", "whole", "peak"]
            )

    judged = chosen.mapInArrow(judge, "toxic int, whole double, peak double").toArrow()
    y = judged["toxic"].to_numpy().astype(float)
    x = np.column_stack([judged["whole"].to_numpy(), judged["peak"].to_numpy()])
    if len(set(y)) < 2:
        return Scorer(None, None, shares[1])
    order = np.lexsort([x[:, 1], x[:, 0], y])
    x, y = x[order], y[order]
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    return Scorer(_model(tables), logistic(x, y, weight))


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs, then the score; where docs has its name, underscores are added to it."""
    at, name = docs.columns.index(text_col), fresh(docs, name)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scorer.scores(batch.column(at)))
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(rows, T.StructType(list(docs.schema.fields)).add(name, "double"))
