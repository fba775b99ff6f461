"""Views over loaded tables, as the SQL of a loaded database offers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.exprs import register_sql
from chainloom.operators.tree_aggregate import exact_sum, tree_aggregate
from chainloom.operators.utxo import coins_of

BLOCK_COLUMNS = ["height", "block_hash", "version", "hash_prev", "hash_merkle_root", "n_time", "n_bits", "n_nonce"]


def view_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(*BLOCK_COLUMNS).orderBy("height")


def view_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.select("txid", "hash_block", "version", "lock_time")


def view_balances(tx_out: DataFrame) -> DataFrame:
    """(address, balance) of rows marked unspent, in whole coins, largest first. An empty address is a group like any other."""
    values = tx_out.where("unspent").select("address", "value")
    sums = tree_aggregate(values, ["address"], exact_sum("units", F.col("value")))
    return sums.select("address", coins_of(F.col("units")).alias("balance")).orderBy(F.desc("balance"))


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views of the tables, of the three views, and the SQL functions."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    view_blocks(tables["blocks"]).createOrReplaceTempView("view_blocks")
    view_transactions(tables["transactions"]).createOrReplaceTempView("view_transactions")
    if "unspent" in tables["tx_out"].columns:
        view_balances(tables["tx_out"]).createOrReplaceTempView("view_balances")
    register_sql(spark)
