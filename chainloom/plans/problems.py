"""The queries of the problems that belong to the core, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.normalise import (
    clean_address,
    hash_of,
    real_hash_of,
    sql_address,
    sql_hash,
    sql_real_hash,
)
from chainloom.operators.orphans import hash_key, orphans, outpoint_key
from chainloom.operators.tree_aggregate import State, exact_sum, input_splits, tree_aggregate
from chainloom.session import table

#: p2_found lists addresses with at least one in this many of the rows that have an address.
HEAVY_ONE_IN = 50


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses holding at least 2 percent of the rows of tx_out that have one; every row counts."""
    rows = table(spark, sf_dir, "tx_out").select(clean_address("address").alias("address")).where("address IS NOT NULL")
    total = rows.count()
    counts = tree_aggregate(rows, ["address"], [State("n", F.count(F.lit(1)))], splits=input_splits(rows))
    return counts.where(F.col("n") * HEAVY_ONE_IN >= F.lit(total)).select("address")


P2_FOUND = f"""
WITH r AS (SELECT {sql_address("address")} AS address FROM tx_out),
c AS (SELECT address, count(*) AS n FROM r WHERE address IS NOT NULL GROUP BY address)
SELECT address FROM c WHERE n * {HEAVY_ONE_IN} >= (SELECT sum(n) FROM c)
"""


def p2_address_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address with its existing outputs: number, sum and largest value.

    An output is one outpoint, however often it was loaded; one whose rows are all dropped is none. Rows without txid or
    index stay apart by id. A null value counts as an output but adds nothing.
    """
    rows = table(spark, sf_dir, "tx_out").where("dropped_at IS NULL").select(
        F.coalesce(hash_of("txid"), F.encode(F.concat(F.lit("#"), F.col("id")), "UTF-8")).alias("txid"),
        F.coalesce(F.col("indexout"), F.col("id")).alias("indexout"),
        clean_address("address").alias("address"),
        "value",
    )
    outputs = rows.groupBy("txid", "indexout").agg(F.max("address").alias("address"), F.max("value").alias("value"))
    states = [State("n_outputs", F.count(F.lit(1))), *exact_sum("sum_value", F.col("value")), State("max_value", F.max("value"), "max")]
    return tree_aggregate(outputs.where("address IS NOT NULL").select("address", "value"), ["address"], states)


P2_TOTALS = f"""
WITH r AS (SELECT coalesce({sql_hash("txid")}, '#' || id) AS txid, coalesce(indexout, id) AS indexout,
                  {sql_address("address")} AS address, value FROM tx_out WHERE dropped_at IS NULL),
o AS (SELECT txid, indexout, max(address) AS address, max(value) AS value FROM r GROUP BY ALL)
SELECT address, count(*) AS n_outputs, CAST(sum(value) AS DECIMAL(38,0)) AS sum_value, max(value) AS max_value
FROM o WHERE address IS NOT NULL GROUP BY address
"""

P5_KEEP = ["src_table", "row_id", "loaded_day"]


def _kept(src: str) -> list[Column]:
    return [F.lit(src).alias("src_table"), F.col("id").alias("row_id"), F.to_date("loaded_at").alias("loaded_day")]


def p5_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id, loaded_day) of every existing row that refers to a record that does not exist.

    A reference without a txid or hash, or to the all-zero hash, refers to nothing. A reference with a hash but no
    output index names no output and is an orphan.
    """
    txs, outs, ins, blocks = (table(spark, sf_dir, t).where("dropped_at IS NULL") for t in ("transactions", "tx_out", "tx_in", "blocks"))
    h = {c: real_hash_of(c) for c in ("hash", "hashblock", "txid", "hashprevout")}
    parts = [
        orphans(hash_key(blocks, h["hash"]), hash_key(txs, h["hashblock"], *_kept("transactions")), P5_KEEP, "p5-blocks"),
        orphans(hash_key(txs, h["txid"]), hash_key(outs, h["txid"], *_kept("tx_out")), P5_KEEP, "p5-transactions"),
        orphans(
            outpoint_key(outs, h["txid"], F.col("indexout")),
            outpoint_key(ins, h["hashprevout"], F.col("indexprevout"), *_kept("tx_in")),
            P5_KEEP,
            "p5-outpoints",
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, row_id) of every orphan reference."""
    return p5_orphans(spark, sf_dir).select("src_table", "row_id")


def p5_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references for each table and day of loaded_at; a null day is a group of its own."""
    return p5_orphans(spark, sf_dir).groupBy("src_table", "loaded_day").agg(F.count(F.lit(1)).alias("n_orphans"))


_P5 = f"""
WITH b AS (SELECT DISTINCT {sql_real_hash("hash")} AS h FROM blocks WHERE dropped_at IS NULL),
t AS (SELECT DISTINCT {sql_real_hash("txid")} AS h FROM transactions WHERE dropped_at IS NULL),
o AS (SELECT DISTINCT {sql_real_hash("txid")} AS h, indexout AS i FROM tx_out WHERE dropped_at IS NULL AND indexout IS NOT NULL),
r AS (
  SELECT 'transactions' AS src_table, id AS row_id, CAST(loaded_at AS DATE) AS loaded_day FROM transactions x
  WHERE dropped_at IS NULL AND {sql_real_hash("hashblock")} IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM b WHERE b.h = {sql_real_hash("x.hashblock")})
  UNION ALL
  SELECT 'tx_out', id, CAST(loaded_at AS DATE) FROM tx_out x
  WHERE dropped_at IS NULL AND {sql_real_hash("txid")} IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM t WHERE t.h = {sql_real_hash("x.txid")})
  UNION ALL
  SELECT 'tx_in', id, CAST(loaded_at AS DATE) FROM tx_in x
  WHERE dropped_at IS NULL AND {sql_real_hash("hashprevout")} IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM o WHERE o.h = {sql_real_hash("x.hashprevout")} AND o.i = x.indexprevout))
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_address_totals": p2_address_totals, "p5_found": p5_found, "p5_by_day": p5_by_day}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_FOUND,
        "p2_address_totals": P2_TOTALS,
        "p5_found": _P5 + "SELECT src_table, row_id FROM r",
        "p5_by_day": _P5 + "SELECT src_table, loaded_day, count(*) AS n_orphans FROM r GROUP BY ALL",
    }
