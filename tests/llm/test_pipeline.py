"""The pipeline's stages against brute force, each on what the one before it kept."""

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from loanloom.llm import bpe, langid
from loanloom.llm.frames import written
from loanloom.llm.queries import RANKS


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name.replace(" ", "-"))
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.columns == stages[0].columns


def test_language(stages):
    model = langid.Model(langid.fit(stages[0]))
    want = {k: t for k, t in texts(stages[0]).items() if not model.predict(t)[2]}
    assert texts(stages[1]) == want and len(want) > 0.95 * len(texts(stages[0]))


def test_lines(stages):
    before = list(texts(stages[1]).items())
    want = {k: "\n".join(kept) for (k, _), kept in brute.shared_lines(before).items()}
    assert texts(stages[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicates(stages):
    prints = {k: brute.fingerprint(t) for k, t in texts(stages[2]).items()}
    assert set(texts(stages[3])) == {root for _, root in brute.components(prints).values()}


def test_decontamination(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = texts(stages[3])
    found = {k for k, _ in brute.leaks(list(before.items()), items)}
    assert set(texts(stages[4])) == set(before) - found


def test_tokens(spark, sf, stages):
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    reference = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = {}
    for key, text in texts(stages[4]).items():
        ids = reference.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        want[key] = (len(ids), brute.sha(packed), brute.sha((text or "").encode()))
    got = {r[0]: tuple(r[1:]) for r in stages[5].collect()}
    assert got == want
    assert {r[0]: tuple(r[1:]) for r in corpus_pipeline.run(spark, sf).collect()} == want
