"""Checks of a chain, each giving its violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.exprs import merkle_of
from chainloom.operators.heights import linked


class ChainError(ValueError):
    """A verified chain has violations."""


def merkle_roots(transactions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., hash_block, merkle_root) from the ids of each block's transactions in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "txid"))), lambda t: t["txid"])
    return transactions.groupBy(*by, "hash_block").agg(ids.alias("ids")).select(*by, "hash_block", merkle_of(F.col("ids")).alias("merkle_root"))


def merkle_violations(blocks: DataFrame, transactions: DataFrame) -> DataFrame:
    """(block_hash, height, expected, found) of blocks whose header has another root than their transactions give."""
    roots = merkle_roots(transactions).withColumnRenamed("hash_block", "block_hash")
    return blocks.join(roots, "block_hash").where("merkle_root <> hash_merkle_root").select("block_hash", "height", F.col("hash_merkle_root").alias("expected"), F.col("merkle_root").alias("found"))


def genesis_violations(blocks: DataFrame, genesis: str) -> DataFrame:
    """(block_hash, height, expected) of blocks at height 0 other than the coin's first."""
    return blocks.where((F.col("height") == 0) & (F.col("block_hash") != genesis)).select("block_hash", "height", F.lit(genesis).alias("expected"))


def link_violations(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., block_hash, height, expected, found) of blocks that name another predecessor than the block below them."""
    both = linked(blocks, by).where("hash_below IS NOT NULL AND hash_below <> hash_prev")
    return both.select(*by, "block_hash", "height", F.col("hash_below").alias("expected"), F.col("hash_prev").alias("found"))


def verify(blocks: DataFrame, transactions: DataFrame, genesis: str) -> None:
    """Raises ChainError at the first kind of violation found."""
    for what, rows in (
        ("first block", genesis_violations(blocks, genesis)),
        ("previous hash", link_violations(blocks)),
        ("merkle root", merkle_violations(blocks, transactions)),
    ):
        row = rows.first()
        if row is not None:
            raise ChainError(f"invalid {what} at height {row['height']}: {row.asDict()}")
