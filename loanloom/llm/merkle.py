"""Merkle manifest of a table of documents, by cogrouped exchange of subtrees.

Every row is a leaf: SHA-256 over its fields, each as UTF-8 byte count, `:` and value, or `-`
if it is null. The leaves of a source, in order of their id, form a tree of runs of three nodes;
the subroots of all sources, in order of the source, form one more such tree.

Leaves are numbered within their source by range partitions and offsets. RUN ** BLOCK_LEVELS
consecutive leaves are a superblock, always a whole subtree, so a source with any share of the rows is many groups.
Superblocks are reduced to one node each; those nodes are numbered and reduced the same way, until
every tree fits into one superblock. On the way back, the nodes outside of each superblock that its
proofs need (the path above it) are cogrouped with its leaves, and one function finishes the
local reduction, joins the proofs and folds them with the changed leaves.

Null sources are one source and come first. Rows that share an id are ordered by their leaf, null
ids come first; repeated rows have equal leaves and are all kept. Null and empty texts differ (`-`
and `0:`). Very long texts are hashed where they are read and never shuffled. An empty table
gives an empty result; columns other than the five fields are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.frames import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 3
BLOCK_LEVELS = 8

Step = tuple[str, str]


def digest(*nodes: str) -> str:
    return sha256("".join(nodes).encode("ascii")).hexdigest()


def height(nodes: int) -> int:
    """How many levels reduce that many nodes to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // RUN), levels + 1
    return levels


def levels_of(nodes: list[str], total: int, most: int) -> list[list[str]]:
    """The nodes of every level of a superblock, in a tree that has `total` nodes at the lowest.

    A tree of one superblock ends at its root; any other superblock has `most` levels above.
    """
    out = [nodes]
    for _ in range(min(height(total), most)):
        below = out[-1]
        out.append([digest(*below[i : i + RUN]) for i in range(0, len(below), RUN)])
    return out


def path(levels: list[list[str]], at: int) -> list[Step]:
    """What stands left and right of a node in its run, level by level."""
    steps = []
    for nodes in levels[:-1]:
        first = at - at % RUN
        steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + RUN])))
        at //= RUN
    return steps


def folded(node: str, steps: list[Step]) -> str:
    for left, right in steps:
        node = digest(left, node, right)
    return node


def field(value: Column) -> Column:
    """A value as byte count, `:` and value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[name]) for name in FIELDS]), 256)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Each row with `at`, its place within its tree from 0, and `total`, the rows of its tree.

    Rows are range-partitioned on the whole order and keep the place they have in their
    partition; the places of a tree's earlier partitions are added from one count for each tree
    and partition.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [tree, *order]
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", place)
    dealt = written(dealt, "merkle-order").withColumn("part", F.shiftright("place", 33))
    counts = dealt.groupBy(tree, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    offsets = counts.selectExpr(
        f"{tree} AS of", "part", "first", f"sum(n) OVER (PARTITION BY {tree}) AS total",
        f"sum(n) OVER (PARTITION BY {tree} ORDER BY part) - n AS before",
    )
    joined = dealt.join(offsets, (dealt[tree] == offsets["of"]) & (dealt["part"] == offsets["part"]))
    return joined.select(
        *[dealt[c] for c in rows.columns], (F.col("before") + F.col("place") - F.col("first")).alias("at"), "total"
    )


def _reduced(nodes: DataFrame, most: int) -> DataFrame:
    """(tree, at, total, node): one node for each superblock of (tree, at, total, node)."""
    size = RUN**most

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows["total"].iloc[0])
        ordered = rows.sort_values("at")["node"].tolist()
        top = levels_of(ordered, total, most)[-1]
        return pd.DataFrame({
            "tree": [rows["tree"].iloc[0]], "at": [int(rows["at"].iloc[0]) // size],
            "total": [-(-total // size)], "node": top,
        })

    own = nodes.select("tree", "at", "total", "node").withColumn("block", F.expr(f"at div {size}"))
    return own.groupBy("tree", "block").applyInPandas(
        reduce, "tree string, at long, total long, node string"
    )


def _paths(nodes: DataFrame, most: int) -> DataFrame:
    """(tree, at, steps, root): the path of every node of (tree, at, total, node) to its tree's root.

    Each round leaves one node of a superblock, so even the largest tables need two or three.
    """
    size = RUN**most

    def climb(rows: pd.DataFrame, steps_above: list[Step], root: str | None) -> pd.DataFrame:
        rows = rows.sort_values("at")
        levels = levels_of(rows["node"].tolist(), int(rows["total"].iloc[0]), most)
        steps = [[*path(levels, i), *steps_above] for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"], "at": rows["at"], "steps": steps,
                             "root": levels[-1][0] if root is None else root})

    schema = "tree string, at long, steps array<struct<l: string, r: string>>, root string"
    if (nodes.agg(F.max("total")).first()[0] or 0) <= size:
        return nodes.groupBy("tree").applyInPandas(lambda rows: climb(rows, [], None), schema)

    def joined(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        return climb(rows, _steps(outer["steps"].iloc[0]), outer["root"].iloc[0])

    own = nodes.withColumn("block", F.expr(f"at div {size}"))
    above = _paths(written(_reduced(nodes, most), "merkle-nodes"), most)
    outer = above.withColumnRenamed("at", "block")
    return own.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(joined, schema)


def _steps(given: list) -> list[Step]:
    return [(s["l"], s["r"]) for s in given]


def _proven(leaves: pd.DataFrame, outer: pd.DataFrame, most: int) -> pd.DataFrame:
    """All proofs of one superblock: local paths, the path above, and the changed leaves folded in."""
    leaves = leaves.sort_values("at")
    levels = levels_of(leaves["node"].tolist(), int(leaves["total"].iloc[0]), most)
    above, subroot, root = _steps(outer["steps"].iloc[0]), outer["subroot"].iloc[0], outer["root"].iloc[0]
    tail = "".join(left + right for left, right in above)
    proofs, roots, top = [], [], levels[-1][0]
    for i, changed in enumerate(leaves["changed"]):
        steps = path(levels, i)
        proofs.append(digest("".join(left + right for left, right in steps), tail))
        node = folded(changed, steps)
        # What equals the superblock's own node folds to the root that is already known.
        roots.append(root if node == top else folded(node, above))
    return pd.DataFrame({
        "id": leaves["id"], "leaf": leaves["node"], "subroot": subroot, "root": root,
        "proof_sha256": proofs, "folded_root": roots, "verified": [r == root for r in roots],
    })


def manifest(docs: DataFrame, changed: dict[str, Column], most: int = BLOCK_LEVELS) -> DataFrame:
    """Leaf, subroot, root, digest of the proof, root folded from the changed leaf, verdict, by row.

    `changed` gives the fields (expressions over docs) that are to be verified against the
    manifest; fields that it doesn't name are those of docs. `most` is the height of a superblock.
    """
    original = {name: docs[name] for name in FIELDS}
    tree = F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit(""))
    rows = docs.select(
        tree.alias("tree"), docs["doc_id"].alias("id"), leaf(original).alias("node"),
        leaf({**original, **changed}).alias("changed"),
    )
    leaves = written(numbered(written(rows, "merkle-leaves"), "tree", "id", "node", "changed"), "merkle-numbered")
    blocks = written(_reduced(leaves, most), "merkle-nodes")
    inner = written(_paths(blocks, most), "merkle-paths")
    subroots = inner.filter("at = 0").selectExpr("'' AS tree", "tree AS source", "root AS node")
    ranked = written(numbered(subroots, "tree", "source", "node"), "merkle-subroots")
    top = _paths(ranked.drop("source"), most).join(ranked.select("at", "source"), "at")
    tops = top.selectExpr("source AS tree", "steps AS upper", "root AS total_root")
    outer = inner.join(tops, "tree").selectExpr(
        "tree", "at AS block", "concat(steps, upper) AS steps", "root AS subroot", "total_root AS root"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    # As text an id crosses to pandas unchanged, null or beyond 53 bits.
    own = leaves.withColumns({"block": F.expr(f"at div {RUN**most}"), "id": F.col("id").cast("string")})
    found = own.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        lambda of, above: _proven(of, above, most),
        "id string, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", "doc_id")


def newlines_deleted(docs: DataFrame) -> dict[str, Column]:
    """Texts without `\\n` where 2 divides the CRC-32 of the id; a null id leaves its text as it is."""
    hit = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    return {"text": F.when(hit, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])}
