"""Secret scans: a random forest removes the false positives among candidate strings.

A candidate is a run of at least SHORTEST characters `[A-Za-z0-9+/_-]` with a digit in it.
Features are its length, its character transitions (between lower case, upper case, digits and
others, and between vowels and consonants), how much of it dictionary words cover, what the
path says (depth, test and example folders) and the words beside it. The dictionary is the
DICTIONARY most frequent words of all texts. The forest is trained on at most LABELLED labelled
findings, half of them at most of each class, chosen by hash and with equal weights of both
classes, and scores all findings. Everything is DataFrame functions and Spark ML.

Null and empty texts have no candidate; a null path or id is allowed. Repeated rows give repeated
findings. If labelled findings lack one of the two classes nothing is removed and the score is
null. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.frames import written

SHORTEST = 12
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{SHORTEST},}}"
BESIDE = 48
DICTIONARY = 20_000
LABELLED = 20_000
TREES, DEPTH, SEED = 40, 6, 42

SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|token|api.?key|access.?key|credential|auth|bearer)"
SAMPLE_WORDS = r"(?i)(example|sample|dummy|fake|placeholder|changeme|test)"
HARMLESS_WORDS = r"(?i)(commit|sha1|sha256|md5|checksum|uuid|build|version|phone|card|order|http)"

FEATURES = (
    "length", "digits", "uppers", "vowels", "kind_changes", "vowel_changes", "digit_runs", "hex_only",
    "digits_only", "coverage", "path_depth", "path_sample", "secret_before", "sample_beside",
    "harmless_beside", "assigned", "quoted",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               path_col: str | None = "source") -> DataFrame:
    """(id, row, nth, value, before, after, path), one row for each candidate of each text."""
    path = docs[path_col] if path_col else F.lit("")
    pattern = F.lit(CANDIDATE)
    found = docs.filter(docs[text_col].rlike("[0-9]")).select(
        docs[id_col].alias("id"), F.xxhash64(docs[id_col], docs[text_col]).alias("row"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.regexp_extract_all(docs[text_col], pattern, 0).alias("values"),
        F.split(docs[text_col], CANDIDATE, -1).alias("between"),
    )
    each = found.select("id", "row", "path", "between", F.posexplode("values").alias("nth", "value"))
    return each.select(
        "id", "row", "nth", "value",
        F.substring(F.col("between")[F.col("nth")], -BESIDE, BESIDE).alias("before"),
        F.substring(F.col("between")[F.col("nth") + 1], 1, BESIDE).alias("after"),
        "path",
    )


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the most frequent words of four letters and more over all texts."""
    words = docs.select(F.explode(F.split(F.lower(docs[text_col]), r"[^a-z]+")).alias("word"))
    counted = words.filter(F.length("word") >= 4).groupBy("word").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "word").limit(DICTIONARY).select("word")


def _count(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)).cast("double")


def featured(findings: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with one double column for each of FEATURES."""
    parts = findings.select("row", "nth", F.explode(F.array_distinct(
        F.split(F.lower("value"), r"[^a-z]+"))).alias("word")).filter(F.length("word") >= 4)
    covered = (
        parts.distinct().join(F.broadcast(words), "word")
        .groupBy("row", "nth").agg(F.sum(F.length("word")).alias("covered"))
    )
    size = F.length("value").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "value", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    changes = F.regexp_count(kinds, F.lit("a(?=[^a])|A(?=[^A])|9(?=[^9])|[^aA9](?=[aA9])"))
    beside = F.concat("before", F.lit(" "), "after")
    return findings.join(covered, ["row", "nth"], "left").select(
        *findings.columns,
        size.alias("length"),
        (_count("[0-9]") / size).alias("digits"),
        (_count("[A-Z]") / size).alias("uppers"),
        (_count("[aeiouAEIOU]") / size).alias("vowels"),
        (changes / size).alias("kind_changes"),
        (_count("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])") / size).alias("vowel_changes"),
        (_count("[0-9]+") / size).alias("digit_runs"),
        F.col("value").rlike("^[0-9a-f]+$").cast("double").alias("hex_only"),
        F.col("value").rlike("^[0-9]+$").cast("double").alias("digits_only"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        F.col("path").rlike(SAMPLE_WORDS).cast("double").alias("path_sample"),
        F.col("before").rlike(SECRET_WORDS).cast("double").alias("secret_before"),
        beside.rlike(SAMPLE_WORDS).cast("double").alias("sample_beside"),
        beside.rlike(HARMLESS_WORDS).cast("double").alias("harmless_beside"),
        F.col("before").rlike("[=:]\\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike("[\"']$").cast("double").alias("quoted"),
    )


def train(labelled: DataFrame):
    """A forest from findings with FEATURES and a boolean `real`; None if a class is missing."""
    order = (F.xxhash64("row", "nth"), "row", "nth")
    real, other = (
        labelled.filter(F.col("real") == is_real).orderBy(*order).limit(LABELLED // 2)
        for is_real in (True, False)
    )
    chosen = real.union(other).select(F.col("real").cast("double").alias("label"), *FEATURES)
    rows = written(chosen, "labelled")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    weight = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values())
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight")
    return forest.fit(vectors.select("label", "features", weight.alias("weight")))


def scored(findings: DataFrame, model) -> DataFrame:
    """Findings with `score`, the forest's share for a real secret, and `kept`."""
    if model is None:
        return findings.withColumn("score", F.lit(None).cast("double")).withColumn("kept", F.lit(True))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings)
    out = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return out.select(*findings.columns, "score", (F.col("score") >= 0.5).alias("kept"))


def labelled_by_form() -> Column:
    """Labels where a finding's form leaves no doubt, else null.

    Real: issued key formats, and values assigned to a name that says what they are. Not real:
    plain numbers, values beside words that name something harmless, values of dictionary words.
    """
    key = F.col("value").rlike("^(AKIA|ASIA)[0-9A-Z]{16}$")
    named = F.col("before").rlike(SECRET_WORDS[:-1] + r")[A-Za-z_]*\s*[=:]\s*[\"']?$")
    harmless = (F.col("digits_only") == 1) | (F.col("harmless_beside") == 1) | (F.col("coverage") > 0.6)
    return F.when(key | named, True).when(harmless, False)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source", labels: Column | None = None) -> DataFrame:
    """(id, nth, value, score, kept): all candidates of all texts and the forest's verdict.

    labels is a boolean column over the findings and their features, null where unknown.
    """
    words = written(dictionary(docs, text_col), "dictionary")
    found = written(candidates(docs, id_col, text_col, path_col), "candidates")
    table = written(featured(found, words), "findings")
    real = labelled_by_form() if labels is None else labels
    model = train(table.withColumn("real", real))
    return scored(table, model).select(F.col("id").alias(id_col), "nth", "value", "score", "kept")
