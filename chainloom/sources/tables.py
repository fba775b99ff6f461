"""From decoded blocks to the four relations, to Parquet and from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.coins import Coin
from chainloom.functions.exprs import from_hex
from chainloom.functions.normalise import ZERO_HASH
from chainloom.functions.scripts import evaluated
from chainloom.sources.blkdat import BlockFiles
from chainloom.sources.schema import CSV_TYPES, HEIGHTS_PER_BUCKET

ChainTables = dict[str, DataFrame]
NO_INDEX = 4294967295


def read_blocks(spark: SparkSession, folder: str, coin: Coin, index: str | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """Decoded blocks of a folder of block files."""
    spark.dataSource.register(BlockFiles)
    reader = spark.read.format("blkdat").option("coin", coin.key).option("start", start)
    for k, v in (("index", index), ("end", end)):
        if v is not None:
            reader = reader.option(k, v)
    return reader.load(folder)


def flatten(blocks: DataFrame, coin: Coin, literal: bool = False) -> ChainTables:
    """blocks, transactions, tx_in and tx_out of decoded blocks. Scripts are read only where their columns are selected.

    `literal` reads the lengths of PUSHDATA as scripts.pushes tells.
    """
    heads = blocks.drop("txs")
    if "aux_pow" in blocks.columns:
        heads = heads.withColumn("has_auxpow", F.col("aux_pow").isNotNull()).drop("aux_pow")
    txs = blocks.select("height", F.col("block_hash").alias("hash_block"), F.posexplode("txs").alias("tx_index", "tx"))
    flat = txs.select("height", "hash_block", "tx_index", *[F.col(f"tx.{c}").alias(c) for c in ("txid", "version", "lock_time", "in_count", "out_count", "stripped_size")], coinbase(F.col("tx.inputs")).alias("is_coinbase"))
    ins = txs.select("height", "tx_index", F.col("tx.txid").alias("txid"), F.posexplode("tx.inputs").alias("in_index", "i"))
    outs = txs.select("height", "tx_index", F.col("tx.txid").alias("txid"), F.posexplode("tx.outputs").alias("index_out", "o"))
    script = evaluated(F.col("o.script_pubkey"), F.lit(coin.version_id), literal, coin.p2sh_version).alias("s")
    outs = outs.select("height", "tx_index", "txid", F.col("index_out").cast("bigint").alias("index_out"), "o.value", "o.script_pubkey", script)
    return {
        "blocks": heads,
        "transactions": flat,
        "tx_in": ins.select("txid", "i.hash_prev_out", "i.index_prev_out", "i.script_sig", "i.sequence", "height", "tx_index", "in_index"),
        "tx_out": outs.select("txid", "index_out", "value", "script_pubkey", "s.address", "height", "tx_index", "s.pattern", "s.op_return_data"),
    }


def coinbase(inputs) -> F.Column:
    """Whether an array of inputs is that of a coinbase: a single one that refers to the zero hash."""
    first = F.get(inputs, 0)
    return (F.size(inputs) == 1) & (first["hash_prev_out"] == ZERO_HASH) & (first["index_prev_out"] == NO_INDEX)


def save(tables: ChainTables, folder: str, mode: str = "overwrite") -> None:
    """Parquet tables in folders of 10,000 heights, so that a range of heights prunes folders."""
    for name, df in tables.items():
        bucket = F.floor(F.col("height") / HEIGHTS_PER_BUCKET).cast("int")
        df.withColumn("height_bucket", bucket).write.mode(mode).partitionBy("height_bucket").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, start: int = 0, end: int | None = None) -> ChainTables:
    """Saved tables, limited to heights from `start` to `end` inclusive by folder and by row."""
    keep = F.col("height_bucket") >= start // HEIGHTS_PER_BUCKET
    keep = keep & (F.col("height") >= start)
    if end is not None:
        keep = keep & (F.col("height_bucket") <= end // HEIGHTS_PER_BUCKET) & (F.col("height") <= end)
    return {n: spark.read.parquet(f"{folder}/{n}").where(keep).drop("height_bucket") for n in CSV_TYPES}


def load_csv(spark: SparkSession, paths: dict[str, str]) -> ChainTables:
    """Tables of the CSV files, scripts as bytes. An empty address stays the empty string, as in a bulk load."""
    out = {}
    for name, path in paths.items():
        df = spark.read.schema(CSV_TYPES[name]).option("sep", ";").option("emptyValue", "").option("nullValue", "\0").csv(path)
        for c in ("script_sig", "script_pubkey"):
            if c in df.columns:
                df = df.withColumn(c, from_hex(F.col(c)))
        out[name] = df.withColumn("address", F.coalesce("address", F.lit(""))) if name == "tx_out" else df
    return out
