"""Operators with one right answer, against brute force and DuckDB."""

import itertools
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from compare import differences, duck, duck_table, spark_table

from loanloom.llm import bpe, lines, quality, radix, segments, simhash, suffixtree
from loanloom.llm.arrays import Chunk
from loanloom.llm.queries import ORACLE, QUERIES, RANKS


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_reference_sql(spark, sf, name):
    assert differences(spark_table(QUERIES[name](spark, sf)), duck_table(duck(sf), ORACLE[name])) == []


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def planted(seed=1, docs=60):
    """Texts over few words with passages that many share, some of them twice in a text."""
    rnd = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(300)]
    passages = [" ".join(rnd.choices(vocabulary, k=n)) for n in (20, 25, 60, 150)]
    out = []
    for i in range(docs):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.5 else
                         " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 30))))
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(parts)))
    return out + [(100, None), (101, ""), (102, out[3][1]), (103, out[3][1] + " x"), (None, out[5][1])]


def test_repeated_words(frame):
    docs = planted()
    got = by_id(suffixtree.dedup_report(frame(docs)), "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeated_words(docs)


def test_repeated_words_of_query(spark, sf, documents):
    got = by_id(QUERIES["op5_suffix_tree"](spark, sf), "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeated_words([d[:2] for d in documents])


def test_repeated_bytes(frame):
    docs = [(k, t) for k, t in planted(2)] + [(200, "é" * 700), (201, "ab" * 600)]
    got = by_id(radix.dedup_report(frame(docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeated_bytes(docs)


def test_repeated_bytes_of_query(spark, sf, documents):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = by_id(QUERIES["op6_radix"](spark, sf), *names)
    assert got == brute.repeated_bytes([d[:2] for d in documents])


@pytest.mark.parametrize("window, gram", [(3, 1), (5, 3), (8, 8)])
def test_other_windows(frame, window, gram):
    rnd = random.Random(window)
    docs = [(i, " ".join(rnd.choices("abc", k=rnd.randint(0, 40)))) for i in range(30)]
    words = by_id(suffixtree.dedup_report(frame(docs), window=window, gram=gram),
                  "n_words", "n_removed", "kept_sha256")
    assert words == brute.repeated_words(docs, window)
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = by_id(radix.dedup_report(frame(docs), window=window, gram=gram), *names)
    assert found == brute.repeated_bytes(docs, window)


def test_fingerprints_and_components(spark, sf, documents):
    got = by_id(QUERIES["op8_simhash_golay"](spark, sf), "fingerprint", "component_id")
    assert got == brute.components({d[0]: brute.fingerprint(d[1]) for d in documents})


def test_links_of_three_bits(spark):
    """Chains of fingerprints at distances 1 to 4, whose links decide the classes."""
    rnd = random.Random(3)
    prints = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        prints.append(x)
        for _ in range(rnd.randint(0, 6)):
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << bit
            prints.append(x)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "print long").repartition(4)
    got = {r["print"]: r["class"] for r in simhash.link_classes(df).collect()}
    want = brute.components(dict(enumerate(prints)))
    groups, own = {}, {}
    for i, p in enumerate(signed):
        groups.setdefault(want[i][1], set()).add(p)
        own.setdefault(got[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_keys_are_never_broadcast(spark, monkeypatch):
    """Spark sizes the keys by the fingerprints they come from, some 53 times too low."""
    plans, own = [], simhash.components

    def seen(edges, a, b):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return own(edges, a, b)

    monkeypatch.setattr(simhash, "components", seen)
    prints = spark.createDataFrame([(1 << i,) for i in range(0, 60, 4)], "print long")
    assert simhash.link_classes(prints).count() == 15
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]


def test_golay_keys_meet():
    rnd = random.Random(5)
    x = np.array([rnd.getrandbits(64) for _ in range(4000)], np.uint64)
    flips = [sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in x]
    near = x ^ np.array(flips, np.uint64)
    left = set(zip(*(a.tolist() for a in simhash.link_keys(x, 0))))
    right = set(zip(*(a.tolist() for a in simhash.link_keys(near, 1))))
    assert {row for row, _ in left & right} == set(range(len(x)))


def test_every_fall_of_three_errors_has_a_cut():
    for at in itertools.combinations_with_replacement(range(5), 3):
        errors = [at.count(s) for s in range(5)]
        assert any(all(errors[s] <= 1 for s in decoded) and not any(errors[s] for s in taken)
                   for decoded, taken in simhash.CUTS)


def test_unrelated_keys_are_rare():
    """Pairs of random fingerprints that share a key: far fewer than fingerprints."""
    prints = np.random.default_rng(9).integers(-(2**63), 2**63, 60_000, dtype=np.int64)
    left, right = (np.unique(simhash.link_keys(prints, i)[1], return_counts=True) for i in (0, 1))
    both, i, j = np.intersect1d(left[0], right[0], return_indices=True)
    own = 10 * len(prints)
    assert (left[1][i] * right[1][j]).sum() - own < len(prints) / 1000


def test_counts(spark, sf, documents):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_id(QUERIES["op10_quality"](spark, sf), *names, "base_failed", "kept")
    for key, text, _, _ in documents:
        counts = brute.text_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert got[key][:6] == (*counts, failed)
        assert not (failed and got[key][6])


def test_counts_of_odd_texts(frame):
    texts = ["", None, "\n\n", "a\na\n a\na", "é ü\x0bx # # #", "x y z x y z x y z", "z" * 5000, "|\n" * 9]
    docs = list(enumerate(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_id(quality.text_counts(frame(docs)), *names)
    assert got == {k: brute.text_counts(t) for k, t in docs}


@pytest.fixture(scope="module")
def tokenizers():
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return bpe.Tokenizer(ranks, public_tokenizers.PATTERN, spaced=True), reference


def test_bpe_of_query(spark, sf, documents, tokenizers):
    reference = tokenizers[1]
    got = by_id(QUERIES["op9_bpe"](spark, sf), "n_tokens", "ids_sha256", "decoded_sha256")
    for key, text, _, _ in documents:
        ids = reference.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        assert got[key] == (len(ids), brute.sha(packed), brute.sha((text or "").encode()))


def test_bpe_of_random_texts(tokenizers):
    own, reference = tokenizers
    rnd = random.Random(4)
    alphabet = "abcdefghi ñéß中😀\n\t1234'st#=_\x00\x1c\x85\xa0   \r½"
    for _ in range(1500):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(0, 60)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_tables(frame):
    docs = frame([(1, "some words"), (2, None)])
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(docs, path, pattern, spaced=True)
    back = {r["doc_id"]: bytes(r["body"]) for r in bpe.decode(ids, path, pattern).collect()}
    assert back == {1: b"some words", 2: b""}


def test_shared_lines_over_many_partitions(spark, frame):
    rnd = random.Random(6)
    common = [f"a line that many documents have, number {i}" for i in range(4)]
    docs = [
        (i, "\n".join(rnd.choice([*common, " " + common[0].upper() + "\t", "short", f"own line of {i} {j} x"])
                      for j in range(rnd.randint(0, 8))))
        for i in range(150)
    ] + [(None, common[0]), (500, common[1] + "\n" + common[1]), (500, common[2])]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["doc_id"], r["text"]) for r in lines.drop_lines(frame(docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute.shared_lines([(k, t) for k, t in docs])
    assert got == {(k, "\n".join(kept)) for (k, _), kept in want.items()}


def test_suffixes_come_in_small_batches():
    """A chunk of near copies has a suffix for each byte; they leave the task piece by piece."""
    text = " ".join(random.Random(4).choices(["abc", "de", "f"], k=200_000))
    bounds = np.array([0, len(text)])
    found = segments.runs(*segments.byte_symbols(Chunk(0, np.frombuffer(text.encode(), np.uint8), bounds)), 400, 300)
    whole = segments.expanded(found)
    pieces = [*segments.expanded_pieces(found, radix.SUFFIXES)]
    assert len(pieces) > 5 and max(len(run) for run, _ in pieces) <= radix.SUFFIXES
    for got, wanted in zip(zip(*pieces), whole):
        assert np.array_equal(np.concatenate(got), wanted)
    none = segments.runs(np.zeros(3, np.uint64), np.array([0, 3]), 400, 300)
    assert [*segments.expanded_pieces(none, 5)] == []

    class Frame:
        schema = {"id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda _: "bigint"})()})}

        def mapInArrow(self, rows, _):
            return rows

    starts = pa.array([found.start.tolist()], pa.list_(pa.int32()))
    batch = pa.record_batch([pa.array([1]), pa.array([0], pa.int32()), pa.array([text]), starts], ["id", "version", "body", "starts"])
    sizes = [b.num_rows for b in radix._suffixes(Frame(), 400, 300)(iter([batch]))]
    assert max(sizes) <= radix.SUFFIXES and sum(sizes) == len(text) - 399
