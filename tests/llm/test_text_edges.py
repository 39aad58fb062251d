"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loanloom.llm import (
    bpe, langid, lines, lm, merkle, phrases, quality, radix, secrets, simhash, suffixtree, toxicity,
)
from loanloom.llm.components import components
from loanloom.llm.queries import RANKS

LONG = " ".join(f"word{i % 997}" for i in range(60_000))
PAIRS = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (None, "a null id"), (None, None), (5, LONG),
         (6, "tie of equal texts, long enough"), (7, "tie of equal texts, long enough"),
         (8, "same id"), (8, "other text"), (9, "repeated row"), (9, "repeated row")]


def pattern():
    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def toxic(df):
    labels = df.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    out = toxicity.scored(df, toxicity.fit(df, labels))
    return out.select("doc_id", F.col(out.columns[-1]).alias("toxicity"))


OPERATORS = {
    "manifest": lambda df: merkle.manifest(df, merkle.newlines_deleted(df)),
    "toxicity": toxic,
    "language": lambda df: langid.predict(df, langid.fit(df)),
    "line_report": lines.line_report,
    "drop_lines": lines.drop_lines,
    "words": suffixtree.dedup_report,
    "bytes": radix.dedup_report,
    "model": lambda df: lm.scores(df, langid.held_out(df["doc_id"], 7, 1)),
    "simhash": simhash.near_duplicates,
    "bpe": lambda df: bpe.round_trip(df, *pattern(), spaced=True),
    "quality": quality.judged,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(frame, name):
    out = OPERATORS[name](frame(PAIRS)).collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out)
    assert ids == sorted((k is not None, k or 0) for k, _ in PAIRS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(frame, name):
    assert OPERATORS[name](frame(PAIRS).filter("false")).collect() == []


CLASHES = ("id", "body", "version", "print", "keep", "h1", "at", "anchor", "size", "row", "value", "part",
           "first", "second", "score", "lang_pred", "rejected", "open", "token", "identity")


@pytest.mark.parametrize("name", sorted({*OPERATORS} - {"language"}))
def test_clashing_columns(frame, name):
    plain = OPERATORS[name](frame(PAIRS))
    crowded = frame(PAIRS)
    for column in CLASHES:
        crowded = crowded.selectExpr("*", f"'clash' AS {column}")
    got = OPERATORS[name](crowded).select(*plain.columns).collect()
    if name != "model":
        assert sorted(map(repr, got)) == sorted(map(repr, plain.collect()))


def test_repeated_rows_are_no_repeats(frame):
    text = " ".join(f"w{i}" for i in range(300))
    once = [(1, text)]
    for report, column in ((suffixtree.dedup_report, "n_removed"), (radix.dedup_report, "n_removed")):
        assert [r[column] for r in report(frame(once * 3)).collect()] == [0, 0, 0]
    assert [r["n_dropped"] for r in lines.line_report(frame([(1, text)] * 3)).collect()] == [0, 0, 0]


def test_stages_keep_columns(spark, sf, frame):
    crowded = frame([(k, t) for k, t in PAIRS])
    for column in CLASHES:
        crowded = crowded.selectExpr("*", f"'clash' AS {column}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (crowded, crowded.filter("false")):
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 139)]
    got = {r["node"]: r["root"] for r in
           components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in [*range(101, 140), 200]}}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def test_secret_scan_of_edges(frame):
    assert secrets.scan(frame(PAIRS)).collect() == []


def test_phrases_of_edges(frame):
    assert phrases.collocations(frame(PAIRS).filter("false")).collect() == []
    rows = [(1, "A b\ta b"), (2, "a  b. a b"), (2, "a  b. a b"), (None, None), (3, ""), (4, "a"), (5, LONG)]
    crowded = frame(rows)
    for column in (*CLASHES, "phrase", "k", "a", "head", "ls", "n", "salt", "e_lang"):
        crowded = crowded.selectExpr("*", f"'clash' AS {column}")
    got = {r["phrase"]: r for r in phrases.collocations(crowded, least=6).collect()}
    assert {k: r["a"] for k, r in got.items() if len(k) < 4} == {"a b": 6}
    assert got["a b"]["score"] == 2_000_000 * 6 // (7 + 6)
