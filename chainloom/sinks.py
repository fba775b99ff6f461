"""Files and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chainloom.functions.exprs import to_hex
from chainloom.operators import stats
from chainloom.session import Saved
from chainloom.sources.schema import CSV


def csv_columns(df: DataFrame, name: str) -> DataFrame:
    """The columns of a CSV file: scripts as hex, a missing address as the empty string."""

    def shown(c: str) -> Column:
        if c in ("script_sig", "script_pubkey"):
            return to_hex(F.col(c)).alias(c)
        return F.coalesce(c, F.lit("")).alias(c) if c == "address" else F.col(c)

    return df.select(*[shown(c) for c in CSV[name]])


def csv_line(df: DataFrame, name: str) -> DataFrame:
    """The lines of a CSV file; an empty field for a null, so that columns never shift."""
    rows = csv_columns(df, name)
    return rows.select(F.concat_ws(";", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


def write_csv(df: DataFrame, path: str, header: bool = False) -> int:
    """Files with `;` between fields, empty strings as empty fields; the number of rows written, counted on the way.

    The commit protocol moves the files in place at the end.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("sep", ";").option("header", header).option("emptyValue", "").option("quote", "\0").csv(path)
    return seen.get["n"]


def dump_csv(tables: dict[str, DataFrame], folder: str, start: int, last: int) -> dict[str, int]:
    """The four tables as {name}-{start}-{last}.csv, in the order of the chain; no table is sorted as a whole. Gives the rows of each."""
    counts = {}
    for name, df in tables.items():
        if name in CSV:
            order = [c for c in ("height", "tx_index", "in_index", "index_out") if c in df.columns]
            placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
            counts[name] = write_csv(csv_columns(placed, name), f"{folder}/{name}-{start}-{last}.csv")
    return counts


def dump_utxo(utxo: DataFrame, folder: str, start: int, last: int) -> dict[str, int]:
    columns = [F.col("txid"), F.col("index_out").alias("indexOut"), F.col("height"), F.col("value"), F.col("address")]
    return {"unspent": write_csv(utxo.select(*columns), f"{folder}/unspent-{start}-{last}.csv", header=True)}


def dump_balances(balances: DataFrame, folder: str, start: int, last: int) -> dict[str, int]:
    """Writes the balances; the count is that of addresses."""
    return {"addresses": write_csv(balances.select("address", "balance"), f"{folder}/balances-{start}-{last}.csv", header=True)}


def report(tables: dict[str, DataFrame]) -> str:
    """The statistics of one chain as text. All is aggregated in Spark, each table of sizes and totals once; a few rows come to the driver."""
    t = {n: df.withColumn("__all", F.lit(0)) for n, df in tables.items()}
    by = ["__all"]
    total = Saved(stats.totals(t["blocks"], t["transactions"], t["tx_in"], t["tx_out"], by), "totals").df
    sums, means = total.first(), stats.block_means(t["blocks"], by).first()
    if sums is None:
        return "blocks  0\n"
    avg = stats.ratios(total, by).first()
    fee = stats.fees(t["tx_in"], t["tx_out"], by).first()
    sizes = Saved(stats.tx_sizes(t["transactions"], t["tx_in"], t["tx_out"], by), "sizes").df
    coins = lambda units: f"{int(units or 0) * 1e-8:.8f} = {int(units or 0)} of the smallest unit"
    number = lambda x: f"{0.0 if x is None else float(x):.2f}"
    rows = [
        ("blocks", sums["n_blocks"]), ("transactions", sums["n_tx"]), ("inputs", sums["n_inputs"]), ("outputs", sums["n_outputs"]),
        ("fees", coins(fee["total_fee"] if fee else 0)), ("value of all outputs", coins(sums["volume"])),
        ("mean block size in KiB", number(means["mean_kib"])), ("mean minutes between blocks", number(means["mean_minutes"])),
        ("transactions per block", number(avg["txs_per_block"])), ("inputs per transaction", number(avg["inputs_per_tx"])),
        ("outputs per transaction", number(avg["outputs_per_tx"])), ("value per output", number(avg["value_per_output"])),
    ]
    for name, measure, show in (("largest value", "total_value", coins), ("largest size in bytes", "stripped_size", str)):
        top = stats.biggest(sizes, measure, by).first()
        amount, height, txid = (top["amount"], top["height"], top["txid"]) if top else (0, 0, stats.ZERO)
        rows.append((name, f"{show(amount)}, height {height}, transaction {txid}"))
    for r in stats.script_types(t["tx_out"], by).orderBy(F.desc("n"), "pattern").collect():  # one row for each of a dozen patterns
        rows.append((f"scripts {r['pattern']}", f"{r['n']}, {r['percent']:.2f} %, first at height {r['height']}, transaction {r['txid']}"))
    width = max(len(name) for name, _ in rows) + 2
    return "".join(f"{name:<{width}}{value}\n" for name, value in rows)
