"""The named queries of this package over the whole tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import (
    bpe, decontaminate, langid, lines, lm, merkle, phrases, quality, radix, secrets, simhash, suffixtree,
    toxicity,
)

RANKS = "byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each document loses to repeats, and a digest of the others."""
    return suffixtree.dedup_report(documents(spark, sf_dir))


def op6_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bytes each document loses to repeats, and a digest of the others."""
    return radix.dedup_report(documents(spark, sf_dir))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by unigram counts and by the trained model."""
    held = langid.held_out(F.col("doc_id"), 7, 2)
    scored = lm.scores(documents(spark, sf_dir), ~held)
    return scored.withColumn("held_out", held)


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    path = public_tokenizers.path(RANKS)
    return bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN, spaced=True)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in all documents, and which of them are real."""
    return secrets.scan(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from three quarters of them."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    contents = langid.fit(docs.filter(~out))
    found = langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), contents)
    return found.drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and where."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir), items)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document loses, and a digest of those that stay."""
    return lines.line_report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judged(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a copy without newlines verifies."""
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, merkle.newlines_deleted(docs))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of three quarters of them."""
    held = langid.held_out(F.col("doc_id"), 4, 2)
    docs = documents(spark, sf_dir).select("doc_id", "text", held.alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.fit(docs.filter(~F.col("held_out")), labels)
    scored = toxicity.scored(docs, scorer)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", "held_out", "score", predicted.alias("predicted"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_language": op2_language,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_radix": op6_radix,
    "op7_language_model": op7_language_model,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr
            FROM documents),
        keyed AS (
            SELECT *, translate(
                regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        frequent AS (
            SELECT key, max(doc_id) AS stays FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        judged AS (
            SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.stays AS gone
            FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), ''))
                AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op11_merkle": r"""
        WITH RECURSIVE marked AS (
            SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
                list_reduce(
                    list_concat([4294967295::BIGINT],
                        list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                    lambda crc, byte: list_reduce(
                        list_concat([xor(crc, byte)], list_transform(range(8), lambda i: i::BIGINT)),
                        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT)
                            ELSE x >> 1 END)) AS crc
            FROM documents),
        fields AS (
            SELECT doc_id, tree,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                text, CASE WHEN xor(crc, 4294967295::BIGINT) & 1 = 0
                    THEN replace(text, chr(10), '') ELSE text END AS changed
            FROM marked),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
            FROM (SELECT doc_id, tree,
                    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                    sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS changed
                FROM fields)),
        nodes AS (
            SELECT tree, 0 AS level, place, leaf AS h FROM leaves
            UNION ALL
            SELECT tree, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM nodes)
            WHERE many > 1 GROUP BY tree, level, place // 3),
        heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
        subroots AS (
            SELECT n.tree, n.h AS subroot, row_number() OVER (ORDER BY n.tree) - 1 AS nr
            FROM nodes n JOIN heights t ON n.tree = t.tree AND n.level = t.height),
        upper_nodes AS (
            SELECT 0 AS level, nr AS place, subroot AS h FROM subroots
            UNION ALL
            SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER () AS many FROM upper_nodes)
            WHERE many > 1 GROUP BY level, place // 3),
        top AS (SELECT max(level) AS height, max_by(h, level) AS root FROM upper_nodes),
        around AS (
            SELECT d.tree, d.place, n.level,
                coalesce(string_agg(n.h, '' ORDER BY n.place)
                    FILTER (n.place < d.place // pow(3, n.level)::BIGINT), '') AS before,
                coalesce(string_agg(n.h, '' ORDER BY n.place)
                    FILTER (n.place > d.place // pow(3, n.level)::BIGINT), '') AS after
            FROM leaves d JOIN heights t ON d.tree = t.tree
            JOIN nodes n ON n.tree = d.tree AND n.level < t.height
                AND n.place // 3 = d.place // pow(3, n.level + 1)::BIGINT
            GROUP BY d.tree, d.place, n.level
            UNION ALL
            SELECT d.tree, d.place, 1000 + n.level,
                coalesce(string_agg(n.h, '' ORDER BY n.place)
                    FILTER (n.place < s.nr // pow(3, n.level)::BIGINT), ''),
                coalesce(string_agg(n.h, '' ORDER BY n.place)
                    FILTER (n.place > s.nr // pow(3, n.level)::BIGINT), '')
            FROM leaves d JOIN subroots s ON d.tree = s.tree CROSS JOIN top
            JOIN upper_nodes n ON n.level < top.height
                AND n.place // 3 = s.nr // pow(3, n.level + 1)::BIGINT
            GROUP BY d.tree, d.place, n.level),
        steps AS (
            SELECT *, row_number() OVER (PARTITION BY tree, place ORDER BY level) AS step FROM around),
        folds AS (
            SELECT tree, place, 0 AS step, changed AS h FROM leaves
            UNION ALL
            SELECT f.tree, f.place, f.step + 1, sha256(s.before || f.h || s.after)
            FROM folds f JOIN steps s ON f.tree = s.tree AND f.place = s.place AND s.step = f.step + 1),
        proofs AS (
            SELECT tree, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof
            FROM steps GROUP BY tree, place),
        folded AS (SELECT tree, place, max_by(h, step) AS folded_root FROM folds GROUP BY tree, place)
        SELECT d.doc_id, d.leaf, s.subroot, top.root, coalesce(p.proof, sha256('')) AS proof_sha256,
            f.folded_root, f.folded_root = top.root AS verified
        FROM leaves d JOIN subroots s ON d.tree = s.tree CROSS JOIN top
        JOIN folded f ON d.tree = f.tree AND d.place = f.place
        LEFT JOIN proofs p ON d.tree = p.tree AND d.place = p.place""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM listed, (SELECT unnest([1, 2, 3, 4]) AS k))),
        counts AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
        candidates AS (SELECT * FROM counts WHERE k > 1 AND a >= 30),
        kept AS (
            SELECT * FROM candidates p WHERE NOT EXISTS (
                SELECT 1 FROM candidates q WHERE q.lang = p.lang AND q.k > p.k
                    AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')
                    AND 100::HUGEINT * q.a >= 80::HUGEINT * p.a)),
        cuts AS (
            SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM kept),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r,
                ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
            FROM cuts c
            JOIN counts x ON x.lang = c.lang AND x.k = c.cut
                AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
            JOIN counts y ON y.lang = c.lang AND y.k = c.k - c.cut
                AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
        best AS (
            SELECT * FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
        WHERE rank <= 2000""",
}
