"""Unspent outputs and balances.

Outputs and spends are ordered by height and place in the block; within a transaction inputs come first. An output lives if it is
the last of its outpoint and no later spend names it. That is one shuffle of outputs and spends by outpoint, whatever the range of heights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.normalise import ZERO_HASH
from chainloom.operators.tree_aggregate import exact_sum, tree_aggregate

OUTPOINT = ["txid", "index_out"]
ORDER = ["height", "tx_index"]
#: Output index that the input of a coinbase names, beside a hash of zeros.
NO_INDEX = 4294967295


def events(tx_out: DataFrame, tx_in: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Created outputs with an address and spends, as (by..., txid, index_out, height, tx_index, made, value, address)."""
    made = tx_out.where("address IS NOT NULL").select(*by, *OUTPOINT, *ORDER, F.lit(1).alias("made"), F.col("value").cast("decimal(20,0)").alias("value"), "address")
    spent = tx_in.select(
        *by,
        F.col("hash_prev_out").alias("txid"),
        F.col("index_prev_out").alias("index_out"),
        *ORDER,
        F.lit(0).alias("made"),
        F.lit(None).cast("decimal(20,0)").alias("value"),
        F.lit(None).cast("string").alias("address"),
    )
    return made.unionByName(spent)


def _names_output(tx_in: DataFrame) -> Column:
    """Whether an input names an output at all: that of a coinbase doesn't, and without it the zero hash would be a hot key."""
    zero = F.lit(ZERO_HASH if dict(tx_in.dtypes)["hash_prev_out"] == "string" else bytes(32))
    return (F.col("hash_prev_out") != zero) | (F.col("index_prev_out") != NO_INDEX)


def utxo_set(tx_out: DataFrame, tx_in: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., txid, index_out, height, value, address) of every live output with an address.

    An outpoint made again replaces the former; made again after a spend it lives. Spends of outputs from before the range
    of heights have nothing to remove, so a range that starts above 0 gives the live outputs made in it. Repeated spends change nothing. An output
    without txid or index can't be named and lives. Hashes may be text or bytes.
    """
    made = tx_out.where("address IS NOT NULL").select(*by, *OUTPOINT, *ORDER, F.col("value").cast("decimal(20,0)").alias("value"), "address")
    newest = F.row_number().over(W.partitionBy(*by, *OUTPOINT).orderBy(*[F.desc(c) for c in ORDER]))
    made = made.withColumn("__k", newest).where("__k = 1 OR txid IS NULL OR index_out IS NULL")
    names = {"hash_prev_out": "txid", "index_prev_out": "index_out", **{c: c for c in (*by, *ORDER)}}
    spent = tx_in.where(_names_output(tx_in)).select(*[F.col(c).alias(f"__{n}") for c, n in names.items()])
    at, then = ([F.col(f"{x}{c}") for c in ORDER] for x in ("", "__"))
    same = (then[0] > at[0]) | ((then[0] == at[0]) & (then[1] > at[1]))
    for c in (*by, *OUTPOINT):
        same = same & (F.col(c) == F.col(f"__{c}"))
    return made.join(spent, same, "left_anti").select(*by, *OUTPOINT, "height", "value", "address")


def mark_spent(tx_out: DataFrame, tx_in: DataFrame) -> DataFrame:
    """tx_out with `unspent`: whether no input names the outpoint, in whatever order they came."""
    named = tx_in.select(F.col("hash_prev_out").alias("txid"), F.col("index_prev_out").alias("index_out")).where("txid IS NOT NULL AND index_out IS NOT NULL").distinct()
    return tx_out.drop("unspent").join(named.withColumn("__spent", F.lit(True)), OUTPOINT, "left").withColumn("unspent", F.col("__spent").isNull()).drop("__spent")


def balances(utxo: DataFrame, by: Sequence[str] = (), nonzero_only: bool = False) -> DataFrame:
    """(by..., address, balance): sum of the live values of each address, DECIMAL(38,0).

    An address may own a great part of all outputs, so sums go through tree aggregation. Addresses with a balance of 0 stay unless `nonzero_only`.
    """
    values = utxo.select(*by, "address", "value")
    sums = tree_aggregate(values, [*by, "address"], exact_sum("balance", F.col("value")))
    return sums.where("balance <> 0") if nonzero_only else sums


def coins_of(units: Column) -> Column:
    """Smallest units as whole coins with 8 digits, exactly."""
    return (units.cast("decimal(28,0)") * F.lit("0.00000001").cast("decimal(9,8)")).cast("decimal(38,8)")


def counters(transactions: DataFrame, tx_in: DataFrame, tx_out: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_tx, n_inputs, n_outputs, n_addressable): rows of a dump; outputs with an address are those it keeps."""
    one = lambda df, **c: df.groupBy(*by).agg(*[v.alias(k) for k, v in c.items()])
    t = one(transactions, n_tx=F.count(F.lit(1)))
    i = one(tx_in, n_inputs=F.count(F.lit(1)))
    o = one(tx_out, n_outputs=F.count(F.lit(1)), n_addressable=F.count("address"))
    if not by:
        return t.crossJoin(i).crossJoin(o)  # three single rows
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tx", "n_inputs", "n_outputs", "n_addressable")]
    return t.join(i, list(by), "full").join(o, list(by), "full").select(*by, *zero)


