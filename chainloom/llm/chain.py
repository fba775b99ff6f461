"""Existing outputs with the coin and day of their block, the common input of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.normalise import (
    clean_address,
    clean_name,
    epoch_day,
    real_hash_of,
    sql_address,
    sql_day,
    sql_name,
    sql_real_hash,
)
from chainloom.session import Saved, small_side, table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, coin, day, blocksize) of each existing block; of rows with the same hash the largest value counts.

    A block row without a hash stays apart.
    """
    rows = table(spark, sf_dir, "blocks").where("dropped_at IS NULL").select(
        real_hash_of("hash").alias("block"),
        F.when(real_hash_of("hash").isNull(), F.col("id")).alias("alone"),
        clean_name("coin").alias("coin"),
        epoch_day("ntime").alias("day"),
        "blocksize",
    )
    return rows.groupBy("block", "alone").agg(*[F.max(c).alias(c) for c in ("coin", "day", "blocksize")]).drop("alone")


def transaction_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, coin, day) of each existing transaction that has a txid; coin and day are null where its block is unknown."""
    rows = table(spark, sf_dir, "transactions").where("dropped_at IS NULL").select(
        real_hash_of("txid").alias("tx"), real_hash_of("hashblock").alias("block")
    )
    txs = rows.where("tx IS NOT NULL").groupBy("tx").agg(F.max("block").alias("block"))
    known = Saved(blocks(spark, sf_dir).where("block IS NOT NULL").select("block", "coin", "day"), "blocks")
    return txs.join(small_side(known), "block", "left").select("tx", "coin", "day")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, address, pattern, value, coin, day) of each existing output, an outpoint loaded twice once.

    Rows without txid or index stay apart by id. Coin and day are null where the transaction or its block is unknown.
    """
    rows = table(spark, sf_dir, "tx_out").where("dropped_at IS NULL").select(
        real_hash_of("txid").alias("tx"),
        F.col("indexout").alias("i"),
        "id",
        clean_address("address").alias("address"),
        "pattern",
        "value",
    )
    rows = rows.withColumn("id", F.when(F.col("tx").isNull() | F.col("i").isNull(), F.col("id")))
    once = rows.groupBy("tx", "i", "id").agg(*[F.max(c).alias(c) for c in ("address", "pattern", "value")])
    return once.join(transaction_blocks(spark, sf_dir), "tx", "left").select("tx", "address", "pattern", "value", "coin", "day")


SQL = f"""
WITH b0 AS (SELECT {sql_real_hash("hash")} AS block, id, {sql_name("coin")} AS coin, {sql_day("ntime")} AS day, blocksize
            FROM blocks WHERE dropped_at IS NULL),
b AS (SELECT block, max(coin) AS coin, max(day) AS day, max(blocksize) AS blocksize FROM b0
      GROUP BY block, CASE WHEN block IS NULL THEN id END),
t AS (SELECT {sql_real_hash("txid")} AS tx, max({sql_real_hash("hashblock")}) AS block FROM transactions
      WHERE dropped_at IS NULL GROUP BY 1),
o0 AS (SELECT {sql_real_hash("txid")} AS tx, indexout AS i, id, {sql_address("address")} AS address, pattern, value
       FROM tx_out WHERE dropped_at IS NULL),
o1 AS (SELECT tx, max(address) AS address, max(pattern) AS pattern, max(value) AS value FROM o0
       GROUP BY tx, i, CASE WHEN tx IS NULL OR i IS NULL THEN id END),
o AS (SELECT o1.*, b.coin, b.day FROM o1 LEFT JOIN t ON t.tx = o1.tx LEFT JOIN b ON b.block = t.block)
"""
