"""Statistics of a chain: totals, averages, the largest transactions and the types of scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.exprs import base_reward, compact_width
from chainloom.operators.heights import linked

ZERO = "0" * 64


def totals(blocks: DataFrame, transactions: DataFrame, tx_in: DataFrame, tx_out: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., n_blocks, n_tx, n_inputs, n_outputs, volume); volume as DECIMAL(38,0)."""
    b = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_blocks"))
    t = transactions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tx"))
    i = tx_in.groupBy(*by).agg(F.count(F.lit(1)).alias("n_inputs"))
    o = tx_out.groupBy(*by).agg(F.count(F.lit(1)).alias("n_outputs"), F.sum(F.col("value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("volume"))
    out = b.join(t, list(by), "left").join(i, list(by), "left").join(o, list(by), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_blocks", "n_tx", "n_inputs", "n_outputs")]
    return out.select(*by, *zero, F.coalesce("volume", F.lit(0)).cast("decimal(38,0)").alias("volume"))


def ratios(total: DataFrame, by: Sequence[str]) -> DataFrame:
    """Averages of totals(); null where nothing is to divide by."""
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return total.select(
        *by,
        d("n_tx", "n_blocks").alias("txs_per_block"),
        d("n_inputs", "n_tx").alias("inputs_per_tx"),
        d("n_outputs", "n_tx").alias("outputs_per_tx"),
        (d("volume", "n_outputs") * F.lit(1e-8)).alias("value_per_output"),
    )


def coinbase_txids(tx_in: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., txid) of transactions with one input that refers to the zero hash at index 4294967295."""
    zero = (F.col("hash_prev_out") == ZERO) & (F.col("index_prev_out") == 4294967295)
    per = tx_in.groupBy(*by, "txid").agg(F.count(F.lit(1)).alias("n"), F.max(zero.cast("int")).alias("z"))
    return per.where("n = 1 AND z = 1").select(*by, "txid")


def fees(tx_in: DataFrame, tx_out: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., total_fee): what the first output of each coinbase has above the base reward of its height, never below 0."""
    first = tx_out.where("index_out = 0").select(*by, "txid", "height", "value")
    paid = first.join(coinbase_txids(tx_in, by), [*by, "txid"], "left_semi")
    fee = F.greatest(F.col("value") - base_reward(F.col("height")), F.lit(0)).cast("decimal(20,0)")
    return paid.groupBy(*by).agg(F.sum(fee).cast("decimal(38,0)").alias("total_fee"))


def tx_sizes(transactions: DataFrame, tx_in: DataFrame, tx_out: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., txid, height, tx_index, stripped_size, total_value) of transactions from their inputs' and outputs' scripts."""
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    own = lambda c, n: length(c) + compact_width(length(c)) + n
    i = tx_in.groupBy(*by, "txid").agg(F.count(F.lit(1)).alias("ni"), F.sum(own("script_sig", 40)).alias("bi"))
    o = tx_out.groupBy(*by, "txid").agg(F.count(F.lit(1)).alias("no"), F.sum(own("script_pubkey", 8)).alias("bo"), F.sum(F.col("value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("v"))
    t = transactions.select(*by, "txid", "height", "tx_index").join(i, [*by, "txid"], "left").join(o, [*by, "txid"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    size = (n("bi") + n("bo") + compact_width(n("ni")) + compact_width(n("no")) + 8).cast("bigint")
    return t.select(*by, "txid", "height", "tx_index", size.alias("stripped_size"), F.coalesce("v", F.lit(0)).cast("decimal(38,0)").alias("total_value"))


def biggest(sizes: DataFrame, measure: str, by: Sequence[str]) -> DataFrame:
    """(by..., amount, height, txid) of the transaction with the largest measure; the earliest of equals, zeros where all are 0."""
    top = F.max_by(F.struct("height", "txid"), F.struct(F.col(measure), -F.col("height"), -F.col("tx_index"))).alias("t")
    best = sizes.groupBy(*by).agg(F.max(measure).alias("amount"), top)
    some = F.col("amount") > 0
    return best.select(*by, "amount", F.when(some, F.col("t.height")).otherwise(F.lit(0)).alias("height"), F.when(some, F.col("t.txid")).otherwise(F.lit(ZERO)).alias("txid"))


def script_types(tx_out: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., pattern, n, percent, height, txid, index_out): outputs of each pattern, their share and their first occurrence."""
    first = F.min_by(F.struct("height", "txid", "index_out"), F.struct("height", "tx_index", "index_out")).alias("f")
    per = tx_out.groupBy(*by, "pattern").agg(F.count(F.lit(1)).alias("n"), first)
    every = per.groupBy(*by).agg(F.sum("n").alias("all"))
    return per.join(every, list(by)).select(*by, "pattern", "n", F.round(F.col("n") * 100.0 / F.col("all"), 2).alias("percent"), "f.height", "f.txid", "f.index_out")


def intervals(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., height, seconds) between a block and the one before it, 0 at least; blocks whose predecessor has no time have none."""
    with_time = linked(blocks, by).where("time_below > 0 AND n_time IS NOT NULL")
    return with_time.select(*by, "height", F.greatest(F.col("n_time") - F.col("time_below"), F.lit(0)).alias("seconds"))


def block_means(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., mean_kib, mean_minutes): mean size and mean interval of blocks; 0 for none."""
    size = blocks.groupBy(*by).agg((F.coalesce(F.avg("blocksize"), F.lit(0.0)) / 1024).alias("mean_kib"))
    gap = intervals(blocks, by).groupBy(*by).agg((F.avg("seconds") / 60).alias("mean_minutes"))
    return size.join(gap, list(by), "left").select(*by, "mean_kib", F.coalesce("mean_minutes", F.lit(0.0)).alias("mean_minutes"))


def embedded_text(tx_out: DataFrame) -> DataFrame:
    """(height, txid, index_out, data) of outputs with embedded text that isn't empty."""
    keep = [c for c in ("coin",) if c in tx_out.columns]
    return tx_out.where((F.col("pattern") == "OpReturn") & (F.col("op_return_data") != "")).select(*keep, "height", "txid", "index_out", F.col("op_return_data").alias("data"))


def text_lines(text: DataFrame) -> DataFrame:
    """The lines that a listing of embedded text prints."""
    return text.select(F.format_string("height: %-9d txid: %s    data: %s", "height", "txid", "data").alias("line"))
