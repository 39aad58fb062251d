"""One wide feature row per applicant: six blocks left-joined onto the profile."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.operators.blocks import (
    card_activity,
    cash_pos,
    credit_summary,
    credit_timeline,
    installments,
    prior_loans,
)
from loanloom.operators.skew import complete, join_unique, joined_blocks
from loanloom.schemas import CUSTOMER
from loanloom.sources.shared import shared_folder
from loanloom.sources.tables import write_bucketed


def feature_blocks(
    tables: dict[str, DataFrame],
    keys=(CUSTOMER,),
    closed_labels: bool = False,
    compat_names: bool = False,
    timeline_mapped: bool = False,
) -> dict[str, DataFrame]:
    """The feature block of every table that is present, one row per key each.

    With ``timeline_mapped`` the timeline has the keys itself and needs no summary for them.
    """
    simple = {
        "credit_summary": credit_summary.block,
        "cash_pos_records": cash_pos.block,
        "card_activity": card_activity.block,
        "prior_loan_history": prior_loans.block,
    }
    blocks: dict[str, DataFrame] = {}
    if "credit_summary" in tables:
        blocks["credit_summary"] = simple["credit_summary"](
            tables["credit_summary"], keys, closed_labels
        )
        if "credit_timeline" in tables:
            blocks["credit_timeline"] = credit_timeline.block(
                tables["credit_timeline"],
                None if timeline_mapped else tables["credit_summary"],
                keys,
                closed_labels,
                compat_names,
            )
    for name in ("cash_pos_records", "card_activity", "prior_loan_history"):
        if name in tables:
            blocks[name] = simple[name](tables[name], keys, closed_labels)
    if "installment_records" in tables:
        blocks["installment_records"] = installments.block(
            tables["installment_records"], keys, closed_labels, compat_names
        )
    return blocks


def staged(blocks: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Blocks by customer as bucketed tables in the shared folder, made one after the other.

    The shuffle files of a block go before the next one is made, so those of all tables are
    never on disk together. A block comes partitioned by its key, as the buckets are, so neither
    the write nor the joins on the customer move it; a bucket has one row of each customer. The
    joins are not left to the size of the files, which hold a block's many zeros in few bytes.
    """
    out = {}
    for name, block in blocks.items():
        spark, table = block.sparkSession, f"{name}_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{shared_folder(spark)}/{table}"
        out[name] = write_bucketed(block, table, buckets, CUSTOMER, path, placed=True).hint("merge")
    return out


def _packed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The keys, and all other columns as one."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*rest).alias(name))


def _unpacked(df: DataFrame, keys: list[str], parts: dict[str, DataFrame]) -> DataFrame:
    columns = [
        F.col(name)[c].alias(c) for name, part in parts.items() for c in part.columns if c not in keys
    ]
    return df.select(*keys, *columns)


def merge_blocks(profile: DataFrame, blocks: list[DataFrame], keys=(CUSTOMER,)) -> DataFrame:
    """Left-join blocks onto the profile.

    Every block is already hash-partitioned on the keys by its own aggregate. Requests
    are unique, so there the joins add at most one exchange for the profile and none for
    the blocks, and hold one partition's row per request in memory. A customer may have any number of profile rows: the blocks meet on the
    distinct customers, and the last join can be split where one customer is frequent.
    A block is one column on its way through the joins: as columns of their own the values
    would be copied one by one at each join, in code too long for the JVM to compile.
    Profiles without a key match nothing; they bypass the joins rather than meet in one
    task.
    """
    keys = list(keys)
    rows, keyless = profile.filter(complete(keys)), profile.filter(~complete(keys))
    if not blocks:
        return rows.unionByName(keyless, allowMissingColumns=True)
    parts = {"__profile": rows, **{f"__block_{i}": block for i, block in enumerate(blocks)}}
    packed = [_packed(part, keys, name) for name, part in parts.items()]
    if keys == [CUSTOMER]:
        joined = join_unique(packed[0], joined_blocks(rows, packed[1:], keys), keys, "left")
    else:
        held = [b.hint("shuffle_hash") for b in packed[1:]]
        joined = reduce(lambda left, right: left.join(right, keys, "left"), held, packed[0])
    return _unpacked(joined, keys, parts).unionByName(keyless, allowMissingColumns=True)


def wide_features(
    tables: dict[str, DataFrame],
    keys=(CUSTOMER,),
    closed_labels: bool = False,
    compat_names: bool = False,
    keep_target: bool = False,
    timeline_mapped: bool = False,
    one_by_one: bool = False,
) -> DataFrame:
    """Profile columns and all features, one row per profile row.

    TARGET stays only with ``keep_target``, for training. With ``one_by_one`` the blocks, which
    must be those of customers, are ``staged``: less disk at a time for one more write of them.
    """
    if "customer_profile" not in tables:
        raise ValueError("a customer_profile table is required")
    profile = tables["customer_profile"]
    if CUSTOMER not in profile.columns:
        raise ValueError(f"customer_profile has no {CUSTOMER} column")
    blocks = feature_blocks(tables, keys, closed_labels, compat_names, timeline_mapped)
    blocks = staged(blocks) if one_by_one else blocks
    rows = profile if keep_target else profile.drop("TARGET")
    return merge_blocks(rows, list(blocks.values()), keys)
