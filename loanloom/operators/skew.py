"""Joins that survive a key holding a large part of all rows.

One side has at most one row per key (it comes from an aggregate); the other may
repeat a key any number of times. Spark's adaptive execution splits an oversized
partition of such a join if both sides were shuffled for that very join. A side
that an aggregate left partitioned by the key would be joined in place instead, so
the join also compares a hash of the key, which no aggregate is partitioned by.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "__spread"


def join_unique(many: DataFrame, unique: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join a table with unique keys to ``many``; any key may be frequent in ``many``."""
    spread = F.xxhash64(*keys)
    right = unique.withColumns({_SPREAD: spread})
    return many.withColumns({_SPREAD: spread}).join(right, [_SPREAD, *keys], how).drop(_SPREAD)


def joined_blocks(many: DataFrame, blocks: list[DataFrame], keys: list[str]) -> DataFrame:
    """All blocks side by side, one row for each complete key of ``many``.

    The keys are made distinct map-side first. Blocks come partitioned by the keys,
    so these joins move nothing but the keys.
    """
    base = many.select(*keys).distinct()
    return reduce(lambda left, right: left.join(right, keys, "left"), blocks, base)


def complete(keys: list[str]):
    return reduce(and_, [F.col(k).isNotNull() for k in keys])
