"""The canonical chain tables made from the loaded ones, as DataFrames and as SQL.

Loaded rows may be dropped, repeated, oddly spelled and without block. The ledger has each existing record once, with the
coin and height of its block; place in the block is the order of loading. Records whose block is unknown are not in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.normalise import clean_address, clean_name, epoch_seconds, hash_of, hash_text, sql_address, sql_name
from chainloom.session import table

ZERO = "0" * 64
#: Columns of hashes: bytes while a plan joins by them, text in the relations.
HASHES = ("block_hash", "hash_prev", "hash_merkle_root", "hash_block", "txid", "hash_prev_out")


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: that loaded first. Each task keeps one row of a key before rows are shuffled, however many copies there are."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    return rows.withColumn("__k", rank).where("__k = 1").drop("__k")


def _hash(c: str):
    """The bytes of a hash, null where there is none; zeros stay."""
    return hash_of(c)


def shown(df: DataFrame) -> DataFrame:
    """The relation with its hashes as text."""
    return df.select(*[hash_text(c).alias(c) if c in HASHES else F.col(c) for c in df.columns])


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blocks").where("dropped_at IS NULL")
    rows = rows.select(
        "id", _hash("hash").alias("block_hash"), clean_name("coin").alias("coin"), "height", "version", "blocksize",
        _hash("hashprev").alias("hash_prev"), _hash("hashmerkleroot").alias("hash_merkle_root"), epoch_seconds("ntime").alias("n_time"),
        F.col("nbits").alias("n_bits"), F.col("nnonce").alias("n_nonce"),
    )
    return _first(rows.where("block_hash IS NOT NULL AND coin IS NOT NULL AND height IS NOT NULL"), ["block_hash"])


def _transactions(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "transactions").where("dropped_at IS NULL")
    rows = rows.select("id", _hash("txid").alias("txid"), _hash("hashblock").alias("hash_block"), "version", F.col("locktime").alias("lock_time"))
    txs = _first(rows.where("txid IS NOT NULL"), ["txid"])
    heads = _blocks(spark, sf_dir) if heads is None else heads
    heads = heads.select(F.col("block_hash").alias("hash_block"), "coin", "height")
    return txs.join(heads, "hash_block").withColumnRenamed("id", "tx_index")


def _tx_out(spark: SparkSession, sf_dir: str, txs: DataFrame | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "tx_out").where("dropped_at IS NULL")
    rows = rows.select(
        "id", _hash("txid").alias("txid"), F.col("indexout").alias("index_out"), "value", F.col("scriptpubkey").alias("script_pubkey"),
        clean_address("address").alias("address"), "unspent", "pattern",
    )
    outs = _first(rows.where("txid IS NOT NULL AND index_out IS NOT NULL"), ["txid", "index_out"])
    txs = _transactions(spark, sf_dir) if txs is None else txs
    return outs.join(txs.select("txid", "coin", "height", "tx_index"), "txid")


def _tx_in(spark: SparkSession, sf_dir: str, txs: DataFrame | None = None, whole: bool = False, once: bool = True) -> DataFrame:
    """Inputs that name an outpoint; if `whole` the others too, each kept apart by id. Without `once` copies stay, for those who need no counts."""
    rows = table(spark, sf_dir, "tx_in").where("dropped_at IS NULL")
    rows = rows.select(
        "id", _hash("txid").alias("txid"), _hash("hashprevout").alias("hash_prev_out"), F.col("indexprevout").alias("index_prev_out"),
        F.col("scriptsig").alias("script_sig"), "sequence",
    )
    outpoint = "hash_prev_out IS NOT NULL AND index_prev_out IS NOT NULL"
    keys = ["txid", "hash_prev_out", "index_prev_out"]
    if not once:
        ins = rows.where(f"txid IS NOT NULL AND {outpoint}")
    elif whole:
        lone = rows.where("txid IS NOT NULL").withColumn("lone", F.when(~F.expr(outpoint), F.col("id")))
        ins = _first(lone, [*keys, "lone"]).drop("lone")
    else:
        ins = _first(rows.where(f"txid IS NOT NULL AND {outpoint}"), keys)
    txs = _transactions(spark, sf_dir) if txs is None else txs
    return ins.withColumnRenamed("id", "in_index").join(txs.select("txid", "coin", "height", "tx_index"), "txid")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_blocks(spark, sf_dir))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_transactions(spark, sf_dir))


def tx_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_tx_out(spark, sf_dir))


def tx_in(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return shown(_tx_in(spark, sf_dir, whole=whole))


def raw_tables(spark: SparkSession, sf_dir: str, whole: bool = False, once: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """all_tables with hashes as bytes, which are half as long as their text."""
    heads = _blocks(spark, sf_dir)
    txs = _transactions(spark, sf_dir, heads)
    return heads, txs, _tx_in(spark, sf_dir, txs, whole, once), _tx_out(spark, sf_dir, txs)


def all_tables(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(blocks, transactions, tx_in, tx_out), the later ones planned on the former, so that a query of several plans each once."""
    return tuple(shown(df) for df in raw_tables(spark, sf_dir, whole))


def _h(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c}, ' ' || chr(9) || chr(13) || chr(10))), '^0x', ''), '')"


def _time(c: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN NULL WHEN {c} >= 100000000000000 THEN {c} // 1000000 WHEN {c} >= 100000000000 THEN {c} // 1000 ELSE {c} END"


SQL = f"""
WITH RECURSIVE b AS (
  SELECT {_h("hash")} AS block_hash, id, {sql_name("coin")} AS coin, height, version, blocksize, {_h("hashprev")} AS hash_prev,
    {_h("hashmerkleroot")} AS hash_merkle_root, {_time("ntime")} AS n_time, nbits AS n_bits, nnonce AS n_nonce
  FROM blocks WHERE dropped_at IS NULL AND {_h("hash")} IS NOT NULL AND {sql_name("coin")} IS NOT NULL AND height IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_h("hash")} ORDER BY id) = 1),
t AS (
  SELECT x.*, b.coin, b.height FROM (
    SELECT {_h("txid")} AS txid, {_h("hashblock")} AS hash_block, version, locktime AS lock_time, id AS tx_index FROM transactions
    WHERE dropped_at IS NULL AND {_h("txid")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_h("txid")} ORDER BY id) = 1) x
  JOIN b ON b.block_hash = x.hash_block),
o AS (
  SELECT x.*, t.coin, t.height, t.tx_index FROM (
    SELECT id, {_h("txid")} AS txid, indexout AS index_out, value, scriptpubkey AS script_pubkey, {sql_address("address")} AS address, unspent, pattern
    FROM tx_out WHERE dropped_at IS NULL AND {_h("txid")} IS NOT NULL AND indexout IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {_h("txid")}, indexout ORDER BY id) = 1) x JOIN t USING (txid)),
i AS (
  SELECT x.*, t.coin, t.height, t.tx_index FROM (
    SELECT id AS in_index, {_h("txid")} AS txid, {_h("hashprevout")} AS hash_prev_out, indexprevout AS index_prev_out, scriptsig AS script_sig, sequence
    FROM tx_in WHERE dropped_at IS NULL AND {_h("txid")} IS NOT NULL AND {_h("hashprevout")} IS NOT NULL AND indexprevout IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {_h("txid")}, {_h("hashprevout")}, indexprevout ORDER BY id) = 1) x JOIN t USING (txid))
"""

#: With the inputs as j, those that name no outpoint too.
WHOLE_SQL = f"""{SQL.rstrip()},
j AS (
  SELECT x.*, t.coin, t.height, t.tx_index FROM (
    SELECT id AS in_index, {_h("txid")} AS txid, {_h("hashprevout")} AS hash_prev_out, indexprevout AS index_prev_out, scriptsig AS script_sig, sequence
    FROM tx_in WHERE dropped_at IS NULL AND {_h("txid")} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {_h("txid")}, {_h("hashprevout")}, indexprevout, CASE WHEN {_h("hashprevout")} IS NULL OR indexprevout IS NULL THEN id END ORDER BY id) = 1) x JOIN t USING (txid))
"""
