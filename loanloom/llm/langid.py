"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts. A text is
reduced to its letters, cut into blocks and compressed with every dictionary; the language
whose dictionary gives the fewest bytes wins. A narrow margin rejects the text.

Dictionaries are fitted on a bounded sample: about SAMPLE_DOCS labelled documents for each
language, SAMPLE_CHARS code points of each, DICTIONARY_BYTES for each language and
TOTAL_BYTES for all together. The sample is chosen by a hash of the document. Predictions
read whole texts, and nothing but texts.

Null texts and texts without a letter are `und` with score 0 and rejected; so is everything
when no labelled text is there. Ties go to the language with the larger sample, then by name.
Repeated rows get equal results; a null id or null label is allowed, null labels never train.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS = 300
SAMPLE_CHARS = 3000
DICTIONARY_BYTES = 256 * 1024
TOTAL_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 8192
# Matches of four bytes are found and taken at once: short texts tell languages apart too.
SEARCH = {
    "window_log": 19, "hash_log": 17, "chain_log": 18, "search_log": 4, "min_match": 4,
    "target_length": 16, "strategy": zstandard.STRATEGY_GREEDY,
}
NARROW = 0.002
SCALE_BYTES = 8.0
UNKNOWN = "und"

_letters = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """Lower-case letters of a text in UTF-8, a space for everything between them."""
    return _letters.sub(" ", text.lower()).strip().encode("utf-8")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, most frequent language first."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("body")
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    # A document is in the sample if its hash is among the lowest part of its language.
    part = F.create_map(*[F.lit(v) for x in order for v in (x, min(1.0, SAMPLE_DOCS / sizes[x]))])
    place = F.pmod(F.xxhash64("body", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(place < part[F.col("label")]).select(
        "label", F.substring("body", 1, SAMPLE_CHARS).alias("body"), F.xxhash64("body").alias("h")
    )
    texts: dict[str, set[tuple[int, str]]] = {x: set() for x in order}
    for row in chosen.toLocalIterator():
        texts[row["label"]].add((row["h"], row["body"]))
    most = min(DICTIONARY_BYTES, TOTAL_BYTES // len(order))
    joined = {x: b" ".join(letters(t) for _, t in sorted(texts[x]))[-most:] for x in order}
    return {x: content for x, content in joined.items() if len(content) >= 8}


class Model:
    """Compressors of all languages."""

    def __init__(self, contents: dict[str, bytes]):
        self.names = list(contents)
        self.encoders = []
        for content in contents.values():
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters(
                **SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            given.precompute_compress(compression_params=settings)
            self.encoders.append(
                zstandard.ZstdCompressor(dict_data=given, compression_params=settings)
            )

    def sizes(self, body: bytes) -> np.ndarray:
        blocks = [body[i : i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        return np.array([sum(len(e.compress(b)) for b in blocks) for e in self.encoders], float)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        body = letters(text) if text else b""
        if not body or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(body)
        best = int(sizes.argmin())
        score = 1.0 / np.exp((sizes[best] - sizes) / SCALE_BYTES).sum()
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
        return self.names[best], float(score), bool(second - sizes[best] < NARROW * sizes[best])


def predict(docs: DataFrame, contents: dict[str, bytes], text_col: str = "text",
            names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All columns of docs, then language, score and rejected under the given names."""
    at = docs.columns.index(text_col)
    model: list[Model] = []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not model:
            model.append(Model(contents))
        for batch in batches:
            found = [model[0].predict(t.as_py()) for t in batch.column(at)]
            langs, scores, narrow = zip(*found) if found else ((), (), ())
            own = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())]
            yield pa.record_batch([*batch.columns, *own], [*batch.schema.names, *names])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(rows, schema)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the given part; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))
