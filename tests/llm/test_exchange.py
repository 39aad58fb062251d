"""Merkle manifest, toxicity and phrases against plain Python and reference SQL."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from compare import differences, duck, duck_table, spark_table
from pyspark.sql import functions as F

from loanloom.llm import langid, merkle, phrases, toxicity
from loanloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["op11_merkle", "op13_collocations"])
def test_reference_sql(spark, sf, name):
    assert differences(spark_table(QUERIES[name](spark, sf)), duck_table(duck(sf), ORACLE[name])) == []


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_of_many_superblocks(spark, sf, height):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "src0").otherwise(F.col("source")))
    given = hot.unionByName(docs.limit(2).selectExpr("doc_id", "text", "lang", "NULL AS source", "n_chars"))
    given = given.unionByName(hot.filter("doc_id < 5"))
    got = [tuple(r) for r in merkle.manifest(given, merkle.newlines_deleted(given), height).collect()]
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in given.collect()]
    assert sorted(got) == sorted(brute.manifest(rows))


def test_one_leaf_is_its_own_root(frame):
    row = merkle.manifest(frame([(7, "x")]), {}).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == brute.sha(b"")


def test_any_changed_field_is_found(frame):
    docs = frame([(i, f"text {i}") for i in range(50)])
    for name, value in (("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1)):
        assert not any(r["verified"] for r in merkle.manifest(docs, {name: value}).collect())


@pytest.mark.parametrize("least, first", [(2, 2000), (3, 40)])
def test_phrases(spark, sf, least, first):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    got = [tuple(r) for r in phrases.collocations(docs, least=least, first=first).collect()]
    assert sorted(got) == sorted(brute.collocations([(r["lang"], r["text"]) for r in docs.collect()], least, first))


def test_frequent_phrases_split_by_parts(frame):
    """One phrase holds most rows, every word follows it once, and products pass 64 bits nowhere."""
    docs = [(i, f"hot pair w{i % 7} hot pair\nhot pair") for i in range(400)]
    got = [tuple(r) for r in phrases.collocations(frame(docs, 9)).collect()]
    assert sorted(got) == sorted(brute.collocations([("en", t) for _, t in docs], 30, 2000))


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(6 * 10**17, [7 * 10**17], [9 * 10**17])], "a long, ls array<long>, rs array<long>")
    best = rows.select(phrases.weakest_cut()).first()[0]
    assert best["score"] == 2_000_000 * 6 * 10**17 // (16 * 10**17)


def counted(words, of, least=1):
    keys = np.array(words, np.uint64)
    none = np.zeros(0, np.uint64)
    return toxicity.Model(toxicity.Counts(keys, np.array(of), none, np.zeros((2, 0)), none), least)


def test_models_are_distributions():
    """Each class gives all words, and one unknown word, probabilities that add up to 1."""
    model = counted([3, 1, 2, 9], [[5, 1, 0, 40], [1, 2, 7, 0]])
    assert model.single.sum(axis=1) == pytest.approx([1.0, 1.0])
    words, of = np.array([3, 9], np.uint64), np.array([[8, 8], [8, 8]])
    pairs = toxicity.mixed(toxicity.mixed(words[[0, 0, 1]]) ^ words[[0, 1, 1]])
    both = toxicity.Model(toxicity.Counts(words, of, pairs, np.array([[5, 2, 4], [1, 6, 0]]), words[[0, 0, 1]]), 1)
    after = both.followed[:, 0] * 0 + [
        sum(both.double[c, both.places(both.pairs, toxicity.mixed(toxicity.mixed(words[:1]) ^ words[[w]]))][0]
            for w in (0, 1)) + both.rest[c, 0] for c in (0, 1)
    ]
    assert after == pytest.approx([1.0, 1.0])


def test_rare_words_say_little():
    model = counted([1, 2, 3], [[0, 100, 100], [100, 1, 100]])
    first = np.array([0, 1])
    ratio = [model.ratios(np.array([w], np.uint64), first)[0] for w in (1, 2, 3, 77)]
    assert ratio[0] > 3 and ratio[1] < -1 and abs(ratio[2]) < 0.1 and abs(ratio[3]) < abs(ratio[1])


def test_planted_toxic_words(spark, frame):
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "klmnprst"]
    clean = [" ".join(words[(i * 7 + j * j) % len(words)] for j in range(40 + i % 60)) for i in range(300)]
    docs = [(i, t if i % 3 else t.replace(" ", " vile ", 1)) for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300) if i % 4], "doc_id long, toxic int")
    df = frame(docs)
    out = toxicity.scored(df, toxicity.fit(df, labels)).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 3 == 0) for r in out)
    again = toxicity.scored(df.repartition(7), toxicity.fit(df.repartition(5), labels)).collect()
    assert sorted((r["doc_id"], r["score"]) for r in again) == sorted((r["doc_id"], r["score"]) for r in out)


def test_labels_of_one_class(spark, frame):
    df = frame([(1, "a"), (2, "b")])
    for value in (0, 1):
        labels = spark.createDataFrame([(1, value), (2, None)], "doc_id long, toxic int")
        out = toxicity.scored(df, toxicity.fit(df, labels)).collect()
        assert {r["score"] for r in out} == {float(value)}


def test_texts_without_words():
    model = counted([1, 2], [[3, 4], [5, 6]])
    assert model.means(pa.array([None, "", " 12 ,"])).tolist() == [[0.0, 0.0]] * 3


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op12_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    real = [r for r in out if r["toxic"] == 1]
    # A fifth of the labels is noise: those texts hold none of the words that mark the others.
    assert sum(r["predicted"] for r in real) >= 0.7 * len(real)
    assert sum(r["predicted"] for r in out if r["toxic"] == 0) <= 0.04 * (len(out) - len(real))
    assert spark.read.parquet(f"{sf}/documents.parquet").filter(langid.held_out(F.col("doc_id"), 4, 2)).count() > 2000
