"""Operators with fitted parts: accuracy on planted cases, and exact parts by brute force."""

import math
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from loanloom.llm import decontaminate, langid, lm, quality, secrets
from loanloom.llm.queries import QUERIES


def test_languages_of_held_out_documents(spark, sf, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op2_language"](spark, sf).collect()}
    right = total = 0
    for key, text, lang, _ in documents:
        row = rows[key]
        assert row["held_out"] == (zlib.crc32(str(key).encode()) % 4 == 2)
        assert 0.0 <= row["score"] <= 1.0
        if row["held_out"]:
            right, total = right + (row["lang_pred"] == lang), total + 1
    assert right / total > 0.85


def test_languages_without_letters_or_labels(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "12 34"), (4, "der Hund und die Katze")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"])
           for r in langid.predict(docs, {}).collect()}
    assert got == {k: ("und", 0.0, True) for k in (1, 2, 3, 4)}
    assert langid.fit(docs.filter("false")) == {}


def test_long_text_is_read_to_its_end(spark, documents):
    german = " ".join(t for _, t, lang, _ in documents if lang == "de")
    english = " ".join(t for _, t, lang, _ in documents if lang == "en")
    model = langid.Model({"en": langid.letters(english)[:60000], "de": langid.letters(german)[:60000]})
    assert model.predict(english[:2000] + german[-20000:])[0] == "de"


@pytest.fixture(scope="module")
def scored(spark, sf):
    return {r["doc_id"]: r for r in QUERIES["op7_language_model"](spark, sf).collect()}


def test_unigram_scores(scored, documents):
    tokens = {k: [*brute.WORD.findall(brute.ascii_lower(t or "")), None] for k, t, _, _ in documents}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = counts.total(), len(counts)
    assert len(scored) == len(tokens)
    for key, words in tokens.items():
        row = scored[key]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["held_out"]) == (
            len(words), sum(counts[w] > 0 for w in words), n, held[key])
        assert row["base_score"] == pytest.approx(want, rel=1e-9)


def test_model_beats_unigrams(scored):
    held = [r for r in scored.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in scored.values())


def test_model_is_a_distribution(spark):
    """Over all known tokens and the unknown one, the probabilities after any words sum to one."""
    texts = ["a b c d"] * 5 + ["a c b e f g"] * 3 + ["h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = "abcdefgh"
    tests = [(100, "a b"), *[(200 + i, f"a b {w}") for i, w in enumerate([*known, "unknown"])]]
    both = docs.unionByName(spark.createDataFrame(tests, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in lm.scores(both, F.col("doc_id") < 100).collect()}
    base = [10 ** got[k]["base_score"] for k, _ in tests]
    assert all(0 < x < 1 for x in base)
    assert got[208]["n_known"] == 3 and got[200]["n_known"] == 4


def test_empty_tables(spark, frame):
    empty = frame([(1, "x")]).filter("false")
    assert lm.scores(empty, F.lit(True)).collect() == []
    assert quality.judged(empty).collect() == []
    assert secrets.scan(empty).collect() == []


def test_no_training_texts(frame):
    rows = lm.scores(frame([(1, "a b"), (2, None), (2, None)]), F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [
        (1, 3, 0, 0), (2, 1, 0, 0), (2, 1, 0, 0)]
    assert all(math.isfinite(r["score"]) and r["base_score"] == 0 for r in rows)


def test_outliers_per_group(spark, documents):
    english = [t for _, t, lang, _ in documents if lang == "en" and len(t.split()) > 100]
    prose = [t for t in english if brute.text_counts(t)[2:] == (0, 0, 0)][:30]
    junk = " ".join(f"{w}&&&###" for w in prose[0].split()[:100])
    rows = [(i, t, "en", "s") for i, t in enumerate(prose * 4)] + [(999, junk, "en", "s"),
            (1000, prose[0], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert not got[999]["kept"] and not got[999]["base_failed"]
    assert all(got[i]["kept"] for i in range(4 * len(prose)))
    assert got[1000]["distance"] is None and got[1000]["kept"] == (not got[1000]["base_failed"])


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3),
    (3, "too short"), (4, None), (5, ""),
]


def test_planted_leaks(spark, frame):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one, two = ITEMS[0][1], ITEMS[1][1]
    words = " ".join(f"w{i}" for i in range(200))
    docs = [(1, f"{words} {one.upper()} {words}"), (2, one), (3, " ".join(one.split()[:12])),
            (4, f"{words} {' '.join(one.split()[:7])} {words}"), (5, two + words), (6, None), (7, ""),
            (8, f"too short {words}"), (None, f"x {one}"), (9, f"{words} {two.replace('iota', 'x', 1)}"),
            (10, one + " " + one)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(docs), items).collect()}
    assert got == brute.leaks(docs, ITEMS)
    assert (1, 1) in got and (None, 1) in got and (4, 1) not in got
    left = {r["doc_id"] for r in decontaminate.clean(frame(docs), items).collect()}
    assert left == {k for k, _ in docs} - {k for k, _ in got}
    none = items.filter("false")
    assert decontaminate.leaks(frame(docs), none).collect() == []
    assert decontaminate.clean(frame(docs), none).count() == len(docs)


def test_items_in_several_blocks(spark, frame, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame([(1, ITEMS[0][1]), (2, ITEMS[1][1])])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 2)}


def test_leaks_of_query(spark, sf, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_decontaminate"](spark, sf).collect()}
    assert got == brute.leaks([d[:2] for d in documents], items)


def test_secrets(spark):
    real = [f"AKIA{i:016X}" for i in range(3000, 3040)]
    rows = [(i, f'some text with token = "{v}" and more', "src/app.py") for i, v in enumerate(real)]
    rows += [(100 + i, f"the card {4000000000000000 + i * 7919} was used", None) for i in range(40)]
    rows += [(200, 'unseen secret: "b7b8a0c022e6cc4d66"', "a"), (201, "call 123456789012345 now", "a"),
             (202, None, None), (203, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not any(got[100 + i]["kept"] for i in range(40))
    assert got[200]["kept"] and not got[201]["kept"]
    assert 202 not in got and 203 not in got
    unknown = secrets.scan(df, labels=F.lit(None).cast("boolean")).collect()
    assert all(r["kept"] and r["score"] is None for r in unknown)


def test_secret_scan_runs_no_python(spark, sf):
    plan = QUERIES["op1_secrets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
