"""Queries of the chain operators over the loaded chain tables, for each coin, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.coins import COINS, coin
from chainloom.functions import codec, exprs, scripts
from chainloom.functions.normalise import hash_of, hash_text
from chainloom.operators import heights, stats, utxo, verify, views
from chainloom.plans import ledger
from chainloom.session import Saved, table
from chainloom.sinks import csv_line
from chainloom.sources.blkdat import file_index
from chainloom.sources.schema import BLOCK
from chainloom.sources.tables import flatten

COIN = ["coin"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Registers a query under its function's name; `sql` follows the common table expressions of the ledger unless `plain`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if plain else ledger.SQL + sql
        return f

    return add


# The relations.
BLOCK_COLUMNS = "block_hash, height, version, blocksize, hash_prev, hash_merkle_root, n_time, n_bits, n_nonce"


@query(f"SELECT coin, {BLOCK_COLUMNS} FROM b")
def chain_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ledger.blocks(spark, d).select("coin", *BLOCK_COLUMNS.split(", "))


@query("SELECT coin, height, tx_index, txid, hash_block, version, lock_time FROM t")
def chain_transactions(spark, d):
    return ledger.transactions(spark, d).select("coin", "height", "tx_index", "txid", "hash_block", "version", "lock_time")


@query("SELECT coin, height, txid, index_out, value, lower(hex(script_pubkey)) AS script, address, pattern FROM o")
def chain_tx_out(spark, d):
    return ledger.tx_out(spark, d).select("coin", "height", "txid", "index_out", "value", exprs.to_hex(F.col("script_pubkey")).alias("script"), "address", "pattern")


@query("SELECT coin, height, txid, hash_prev_out, index_prev_out, lower(hex(script_sig)) AS script, sequence FROM i")
def chain_tx_in(spark, d, whole=False):
    return ledger.tx_in(spark, d, whole=whole).select("coin", "height", "txid", "hash_prev_out", "index_prev_out", exprs.to_hex(F.col("script_sig")).alias("script"), "sequence")


# Heights.
@query("SELECT coin, height, block_hash FROM b WHERE height BETWEEN 250010 AND 420100")
def height_range(spark, d):
    return heights.in_range(ledger.blocks(spark, d), 250_010, 420_100).select("coin", "height", "block_hash")


@query("SELECT coin, height, block_hash FROM b WHERE height >= 250010 AND height < least(10000000, (SELECT max(height) FROM b))")
def height_range_clamped(spark, d):
    return heights.in_range(ledger.blocks(spark, d), 250_010, 10_000_000, half_open=True).select("coin", "height", "block_hash")


@query("""SELECT coin, height, block_hash FROM b JOIN (SELECT coin, height, height - row_number() OVER (PARTITION BY coin ORDER BY height) AS g
  FROM (SELECT DISTINCT coin, height FROM b WHERE height >= 250000)) s USING (coin, height) WHERE g = 249999""")
def height_gap_stop(spark, d):
    return heights.until_gap(ledger.blocks(spark, d), 250_000, COIN).select("coin", "height", "block_hash")


def _derived(spark, d) -> DataFrame:
    """(coin, block_hash, height, base, derived) of every block; base and derived are null for a block that no line has."""
    rows = Saved(ledger.blocks(spark, d).select("coin", "block_hash", "hash_prev", "height"), "blocks").df
    low = rows.select(F.col("block_hash").alias("base"), F.col("height").alias("low"))
    found = heights.lines(rows, COIN).join(low, "base").select("block_hash", "base", (F.col("low") + F.col("above")).alias("derived"))
    return rows.join(found, "block_hash", "left").select("coin", "block_hash", "height", "base", "derived")


@query("SELECT coin, block_hash, height AS derived FROM b")
def derived_heights(spark, d):
    """The height that the links alone give each block, once the lowest block of each unbroken line is given its own; the SQL has the recorded ones."""
    return _derived(spark, d).select("coin", "block_hash", "derived")


@query(""", w AS (SELECT block_hash, block_hash AS base, height AS derived FROM b WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.block_hash = b.hash_prev)
  UNION ALL SELECT n.block_hash, w.base, w.derived + 1 FROM w JOIN b n ON n.hash_prev = w.block_hash)
SELECT coin, block_hash, height, base, derived FROM b JOIN w USING (block_hash)""")
def derived_heights_all(spark, d):
    """Every block with its recorded height, the first block of its unbroken line, and the height that the links give it from there."""
    return _derived(spark, d)


# The index.
def _index_bytes(n) -> F.Column:
    """Hex of an index integer below 2 ** 35: each further byte takes over where the shorter forms end."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    out, low = F, 0
    for size in range(1, 6):
        rest = n - F.lit(low)
        bits = [F.shiftright(rest, 7 * k).bitwiseAND(F.lit(127).cast("bigint")) for k in range(size - 1, -1, -1)]
        low += 1 << 7 * size
        out = out.when(n < low, F.concat(*[byte(b + F.lit(128) if k < size - 1 else b) for k, b in enumerate(bits)]))
    return out


def _index(spark, d) -> DataFrame:
    """Index records of all loaded blocks, dropped ones too, read from keys and values put together from the columns."""
    rows = table(spark, d, "blocks").where("hash IS NOT NULL AND height IS NOT NULL").withColumn("key", hash_of("hash")).select(
        "id", hash_text("key").alias("block_hash"), "version", "height", F.when(F.col("dropped_at").isNull(), 13).otherwise(1).cast("bigint").alias("status"),
        F.col("blocksize").alias("tx_count"), F.floor(F.col("id") / 100).alias("blk_index"), (F.col("id") * 1000).alias("data_offset"),
    ).na.fill({"version": 0, "tx_count": 0}).where(F.length("block_hash") == 64)
    value = F.unhex(F.concat(*[_index_bytes(F.col(c)) for c in codec.INDEX_FIELDS]))
    raw = rows.select("id", F.unhex(F.concat(F.lit("62"), exprs.reverse_hex(F.col("block_hash")))).alias("key"), value.alias("value"))

    def read(batches):
        for batch in batches:
            ids, keys, values = batch.columns
            back = [codec.read_index_record(k, v) for k, v in zip(keys.to_pylist(), values.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[c] for r in back]) for c in ("block_hash", *codec.INDEX_FIELDS)]], names=["id", "block_hash", *codec.INDEX_FIELDS])

    return raw.mapInArrow(read, "id bigint, block_hash string, version bigint, height bigint, status bigint, tx_count bigint, blk_index bigint, data_offset bigint")


X = f"""WITH x AS (SELECT id, {ledger._h("hash")} AS block_hash, coalesce(version, 0) AS version, height, CAST(CASE WHEN dropped_at IS NULL THEN 13 ELSE 1 END AS BIGINT) AS status,
  coalesce(blocksize, 0) AS tx_count, id // 100 AS blk_index, id * 1000 AS data_offset FROM blocks WHERE length({ledger._h("hash")}) = 64 AND height IS NOT NULL)
"""


@query(X + "SELECT id, block_hash, version, height, status, tx_count, blk_index, data_offset FROM x", plain=True)
def index_varint(spark, d):
    return _index(spark, d)


@query(X + "SELECT id, height, block_hash FROM x WHERE status & 12 > 0", plain=True)
def index_status_filter(spark, d):
    return heights.usable(_index(spark, d)).select("id", "height", "block_hash")


@query(X + "SELECT height, max(block_hash) AS block_hash FROM x WHERE status & 12 > 0 GROUP BY height", plain=True)
def index_last_by_height(spark, d):
    return heights.last_by_height(heights.usable(_index(spark, d)), "block_hash").select("height", "block_hash")


@query(X + "SELECT blk_index, max(height) AS max_height FROM x WHERE status & 12 > 0 GROUP BY blk_index", plain=True)
def blk_file_max_height(spark, d):
    return heights.max_height_by_file(heights.usable(_index(spark, d)))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'blk' || lpad(CAST(id AS VARCHAR), 12, '0') || '.dat' WHEN id % 3 = 1 THEN 'blk' || id || '.dat' ELSE 'rev' || id || '.dat' END AS name,
  CASE WHEN id % 3 < 2 THEN id END AS number FROM blocks""", plain=True)
def blk_filename_index(spark, d):
    i = F.col("id")
    name = F.when(i % 3 == 0, F.concat(F.lit("blk"), F.lpad(i.cast("string"), 12, "0"), F.lit(".dat"))).when(i % 3 == 1, F.concat(F.lit("blk"), i, F.lit(".dat"))).otherwise(F.concat(F.lit("rev"), i, F.lit(".dat")))
    number = F.udf(file_index, "bigint", useArrow=True)  # the source's own reading of names
    return table(spark, d, "blocks").select("id", name.alias("name")).withColumn("number", number("name"))


# Unspent outputs and balances.
U = """, e AS (SELECT coin, txid, index_out, height, tx_index, 1 AS made, value, address FROM o WHERE address IS NOT NULL
  UNION ALL SELECT coin, hash_prev_out, index_prev_out, height, tx_index, 0, NULL, NULL FROM i),
u AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY coin, txid, index_out ORDER BY height DESC, tx_index DESC, made DESC) = 1),
live AS (SELECT coin, txid, index_out, height, CAST(value AS DECIMAL(20,0)) AS value, address FROM u WHERE made = 1)
"""


def _live(spark, d) -> DataFrame:
    _, _, tx_in, tx_out = ledger.raw_tables(spark, d, once=False)
    return utxo.utxo_set(tx_out, tx_in, COIN)


@query(U + "SELECT * FROM live")
def utxo_set(spark, d):
    return ledger.shown(_live(spark, d))


@query(U + "SELECT coin, address, CAST(sum(coalesce(value, 0)) AS DECIMAL(38,0)) AS balance FROM live GROUP BY ALL HAVING sum(value) IS NOT NULL")
def balances(spark, d):
    return utxo.balances(_live(spark, d), COIN).where("balance IS NOT NULL")


@query(U + "SELECT coin, address, CAST(sum(value) AS DECIMAL(38,0)) AS balance FROM live GROUP BY ALL HAVING sum(value) <> 0")
def balances_nonzero(spark, d):
    return utxo.balances(_live(spark, d), COIN, nonzero_only=True)


@query("SELECT a.coin, n_tx, n_inputs, n_outputs, n_addressable FROM (SELECT coin, count(*) AS n_tx FROM t GROUP BY 1) a JOIN (SELECT coin, count(*) AS n_inputs FROM i GROUP BY 1) c USING (coin) JOIN (SELECT coin, count(*) AS n_outputs, count(address) AS n_addressable FROM o GROUP BY 1) e USING (coin)")
def utxo_counters(spark, d, whole=False):
    _, txs, tx_in, tx_out = ledger.all_tables(spark, d, whole)
    return utxo.counters(txs, tx_in, tx_out, COIN)


@query("SELECT o.txid, o.index_out, s.h IS NULL AS unspent FROM o LEFT JOIN (SELECT DISTINCT hash_prev_out AS h, index_prev_out AS k FROM i) s ON s.h = o.txid AND s.k = o.index_out")
def spent_flag(spark, d):
    _, _, tx_in, tx_out = ledger.raw_tables(spark, d, once=False)
    return ledger.shown(utxo.mark_spent(tx_out, tx_in).select("txid", "index_out", "unspent"))


@query(f"SELECT {ledger.sql_address('address')} AS address, CAST(sum(value) * CAST(0.00000001 AS DECIMAL(9,8)) AS DECIMAL(38,8)) AS balance FROM tx_out WHERE unspent GROUP BY 1", plain=True)
def balances_view(spark, d):
    rows = table(spark, d, "tx_out").select(ledger.clean_address("address").alias("address"), "value", "unspent")
    return views.view_balances(rows)


# Statistics.
@query(f"SELECT coin, txid FROM i GROUP BY 1, 2 HAVING count(*) = 1 AND bool_or(hash_prev_out = '{ledger.ZERO}' AND index_prev_out = 4294967295)")
def coinbase_filter(spark, d):
    return stats.coinbase_txids(ledger.tx_in(spark, d), COIN)


@query("SELECT coin, height, CAST(CASE WHEN height // 210000 < 63 THEN 5000000000 >> (height // 210000)::INT ELSE 0 END AS BIGINT) AS reward, CAST(CASE WHEN id // 5 < 63 THEN 5000000000 >> (id // 5)::INT ELSE 0 END AS BIGINT) AS later FROM b")
def base_reward(spark, d):
    h = F.col("height")
    return ledger.blocks(spark, d).select("coin", "height", exprs.base_reward(h).alias("reward"), exprs.base_reward(F.floor(F.col("id") / 5) * exprs.HALVING).alias("later"))


@query(f""", c AS (SELECT coin, txid FROM i GROUP BY 1, 2 HAVING count(*) = 1 AND bool_or(hash_prev_out = '{ledger.ZERO}' AND index_prev_out = 4294967295))
SELECT coin, CAST(sum(greatest(value - (5000000000 >> (height // 210000)::INT), 0)) AS DECIMAL(38,0)) AS total_fee FROM o JOIN c USING (coin, txid) WHERE index_out = 0 GROUP BY coin""")
def fee_total(spark, d):
    _, _, tx_in, tx_out = ledger.all_tables(spark, d)
    return stats.fees(tx_in, tx_out, COIN)


def _totals(spark, d, whole=False):
    return stats.totals(*ledger.raw_tables(spark, d, whole), COIN)


TOTALS = """, s AS (SELECT a.coin, n_blocks, n_tx, n_inputs, n_outputs, volume FROM (SELECT coin, count(*) AS n_blocks FROM b GROUP BY 1) a JOIN (SELECT coin, count(*) AS n_tx FROM t GROUP BY 1) k USING (coin)
  JOIN (SELECT coin, count(*) AS n_inputs FROM i GROUP BY 1) c USING (coin) JOIN (SELECT coin, count(*) AS n_outputs, CAST(sum(value) AS DECIMAL(38,0)) AS volume FROM o GROUP BY 1) e USING (coin))
"""


@query(TOTALS + "SELECT * FROM s")
def stats_totals(spark, d, whole=False):
    return _totals(spark, d, whole)


@query(TOTALS + "SELECT coin, round(n_tx::DOUBLE / n_blocks, 6) AS txs_per_block, round(n_inputs::DOUBLE / n_tx, 6) AS inputs_per_tx, round(n_outputs::DOUBLE / n_tx, 6) AS outputs_per_tx, round(volume::DOUBLE / n_outputs * 1e-8, 6) AS value_per_output FROM s")
def stats_ratios(spark, d, whole=False):
    r = stats.ratios(_totals(spark, d, whole), COIN)
    return r.select("coin", *[F.round(c, 6).alias(c) for c in r.columns if c != "coin"])


W = "CASE WHEN {0} < 253 THEN 1 WHEN {0} < 65536 THEN 3 WHEN {0} < 4294967296 THEN 5 ELSE 9 END"
LI, LO = "coalesce(octet_length(script_sig), 0)", "coalesce(octet_length(script_pubkey), 0)"
SIZES = f""", si AS (SELECT coin, txid, count(*) AS n, sum({LI} + {W.format(LI)} + 40) AS w FROM i GROUP BY 1, 2),
so AS (SELECT coin, txid, count(*) AS n, sum({LO} + {W.format(LO)} + 8) AS w, sum(value) AS v FROM o GROUP BY 1, 2),
z AS (SELECT t.coin, t.txid, t.height, t.tx_index, CAST(coalesce(si.w, 0) + coalesce(so.w, 0) + {W.format("coalesce(si.n, 0)")} + {W.format("coalesce(so.n, 0)")} + 8 AS BIGINT) AS stripped_size, CAST(coalesce(so.v, 0) AS DECIMAL(38,0)) AS total_value
  FROM t LEFT JOIN si USING (coin, txid) LEFT JOIN so USING (coin, txid))
"""


def _sizes(spark, d, whole=False):
    return ledger.shown(stats.tx_sizes(*ledger.raw_tables(spark, d, whole)[1:], COIN))


@query(SIZES + "SELECT * FROM z")
def tx_sizes(spark, d, whole=False):
    return _sizes(spark, d, whole)


def _biggest_sql(measure: str) -> str:
    return SIZES + f"SELECT coin, {measure} AS amount, height, txid FROM z QUALIFY row_number() OVER (PARTITION BY coin ORDER BY {measure} DESC, height, tx_index) = 1"


@query(_biggest_sql("total_value"))
def biggest_value_tx(spark, d):
    return stats.biggest(_sizes(spark, d), "total_value", COIN)


@query(_biggest_sql("stripped_size"))
def biggest_size_tx(spark, d, whole=False):
    return stats.biggest(_sizes(spark, d, whole), "stripped_size", COIN)


@query("SELECT coin, pattern, count(*) AS n FROM o GROUP BY ALL")
def script_type_counts(spark, d):
    return stats.script_types(ledger.tx_out(spark, d), COIN).select("coin", "pattern", "n")


@query("SELECT coin, pattern, height, txid, index_out FROM o QUALIFY row_number() OVER (PARTITION BY coin, pattern ORDER BY height, tx_index, index_out) = 1")
def script_type_first_seen(spark, d):
    return stats.script_types(ledger.tx_out(spark, d), COIN).select("coin", "pattern", "height", "txid", "index_out")


@query("SELECT coin, pattern, round(n * 100.0 / sum(n) OVER (PARTITION BY coin), 2)::DOUBLE AS percent FROM (SELECT coin, pattern, count(*) AS n FROM o GROUP BY 1, 2) x")
def script_type_pct(spark, d):
    return stats.script_types(ledger.tx_out(spark, d), COIN).select("coin", "pattern", F.col("percent").cast("double").alias("percent"))


GAPS = """, g AS (SELECT a.coin, a.height, greatest(a.n_time - p.n_time, 0) AS seconds FROM b a JOIN b p ON p.coin = a.coin AND p.height = a.height - 1 WHERE p.n_time > 0 AND a.n_time IS NOT NULL)
"""


@query(GAPS + "SELECT * FROM g")
def block_interval(spark, d):
    return stats.intervals(ledger.blocks(spark, d), COIN)


@query(GAPS + "SELECT coin, round(avg(seconds) / 60, 6) AS minutes FROM g GROUP BY coin")
def mean_block_interval(spark, d):
    return stats.block_means(ledger.blocks(spark, d), COIN).select("coin", F.round("mean_minutes", 6).alias("minutes"))


@query("SELECT coin, round(avg(blocksize) / 1024, 6) AS kib FROM b GROUP BY coin")
def mean_block_size(spark, d):
    return stats.block_means(ledger.blocks(spark, d), COIN).select("coin", F.round("mean_kib", 6).alias("kib"))


# Scripts.
def _texts(spark, d):
    outs = ledger.tx_out(spark, d)
    return stats.embedded_text(outs.withColumn("op_return_data", F.when(F.col("pattern") == "OpReturn", scripts.op_return_text(F.col("script_pubkey")))))


TEXT = ", x AS (SELECT coin, height, txid, index_out, coalesce(try(decode(CAST(unhex(substr(hex(script_pubkey), 5)) AS BLOB))), '') AS data FROM o WHERE pattern = 'OpReturn' AND octet_length(script_pubkey) > 2)\n"


@query(TEXT + "SELECT * FROM x WHERE data <> ''")
def opreturn_messages(spark, d):
    return _texts(spark, d)


@query(TEXT + "SELECT printf('height: %-9d txid: %s    data: %s', height, txid, data) AS line FROM x WHERE data <> ''")
def opreturn_lines(spark, d):
    return stats.text_lines(_texts(spark, d))


_KEY = "(?:21[0-9a-f]{66}|41[0-9a-f]{130})"
_RULES = {
    scripts.OP_RETURN: "^6a", scripts.UNSPENDABLE: "^(" + "|".join(f"{b:02x}" for b in scripts.DEAD) + ")", scripts.P2PK: f"^{_KEY}ac$", scripts.P2PKH: "^76a914[0-9a-f]{40}88ac$",
    scripts.P2SH: "^a914[0-9a-f]{40}87$", scripts.P2WPKH: "^0014[0-9a-f]{40}$", scripts.P2WSH: "^0020[0-9a-f]{64}$", scripts.P2TR: "^5120[0-9a-f]{64}$",
    scripts.WITNESS: "^(00|5[1-9a-f]|60)(" + "|".join(f"{n:02x}[0-9a-f]{{{2 * n}}}" for n in range(2, 41)) + ")$",
}
_CASE = " ".join(f"WHEN regexp_matches(s, '{r}') THEN '{n}'" for n, r in _RULES.items())
_CASE += f""" WHEN regexp_matches(s, '^(5[1-9a-f]|60){_KEY}+(5[1-9a-f]|60)ae$') AND substr(s, 1, 2) <= substr(s, -4, 2)
  AND len(regexp_extract_all(substr(s, 3, length(s) - 6), '{_KEY}')) = CAST('0x' || substr(s, -4, 2) AS INT) - 80 THEN '{scripts.MULTISIG}'"""


@query(f"SELECT id, CASE WHEN s IS NULL THEN NULL {_CASE} ELSE 'NotRecognised' END AS kind FROM (SELECT id, lower(hex(scriptpubkey)) AS s FROM tx_out)", plain=True)
def script_classify(spark, d):
    return table(spark, d, "tx_out").select("id", scripts.classify(F.col("scriptpubkey")).alias("kind"))


@query(f"SELECT pattern, CASE WHEN s IS NULL THEN NULL {_CASE} ELSE 'NotRecognised' END AS kind, count(*) AS n FROM (SELECT pattern, lower(hex(scriptpubkey)) AS s FROM tx_out) GROUP BY 1, 2", plain=True)
def script_patterns(spark, d):
    """Recorded patterns beside those read from the scripts by the full evaluator."""
    read = scripts.evaluated(F.col("scriptpubkey"))
    return table(spark, d, "tx_out").select("pattern", read.alias("e")).groupBy("pattern", F.col("e.pattern").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Addresses in SQL: 25 bytes as seven numbers of 32 bits, divided by 58 ** 5 seven times, each remainder being five digits.
_DIVIDED = """list_reduce(list_transform(n.q, lambda v: {'q': []::BIGINT[], 'r': v}),
  lambda a, v: {'q': list_append(a.q, (a.r * 4294967296 + v.r) // 656356768), 'r': (a.r * 4294967296 + v.r) % 656356768}, {'q': []::BIGINT[], 'r': 0::BIGINT})"""


def _base58_sql(source: str, payload: str) -> str:
    """CTEs from `source` with a column of version and hash as hex to c58(payload, address)."""
    limbs = "list_transform(range(0, 7), lambda k: CAST('0x' || substr('000000' || x || substr(sha256(unhex(sha256(unhex(x)))), 1, 8), 8 * k + 1, 8) AS BIGINT))"
    out = [f"c0 AS (SELECT x, {{'q': {limbs}, 'r': 0::BIGINT}} AS n FROM (SELECT DISTINCT {payload} AS x FROM {source}) WHERE x IS NOT NULL)"]
    out += [f"c{k + 1} AS (SELECT *, n.r AS d{k} FROM (SELECT * EXCLUDE (n), {_DIVIDED} AS n FROM c{k}))" for k in range(7)]
    digits = " || ".join(f"substr('{scripts.BASE58}', CAST(d{k} // {58**m} % 58 AS INT) + 1, 1)" for k in range(6, -1, -1) for m in range(4, -1, -1))
    zeros = "length(regexp_extract(x, '^(00)*')) // 2"
    return ", ".join([*out, f"c58 AS (SELECT x AS payload, repeat('1', {zeros}) || ltrim({digits}, '1') AS address FROM c7)"])


_GENERATOR = [0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]
_TOP = f"list_reduce(list_transform(range(0, 5), lambda i: CASE WHEN (c >> 25 >> i) & 1 = 1 THEN list_extract({_GENERATOR}::BIGINT[], i + 1) ELSE 0 END), lambda p, q: xor(p, q))"
_POLYMOD = f"list_reduce(list_concat([3, 3, 0, 2, 3]::BIGINT[], words, [0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, v: xor(xor((c & 33554431) << 5, v), {_TOP}), 1::BIGINT)"
_CHARS = f"substr('{scripts.BECH32}', CAST(w AS INT) + 1, 1)"
#: CTE from w32(payload: hex of a version byte and a program) to b32(payload, address), on Bitcoin.
_BECH32_SQL = f"""b0 AS (SELECT payload, list_prepend(CAST('0x' || substr(payload, 1, 2) AS BIGINT), list_transform(range(0, CAST(ceil((length(payload) - 2) * 4 / 5) AS BIGINT)),
    lambda k: list_reduce(list_transform(range(0, 5), lambda b: CASE WHEN 5 * k + b < 4 * (length(payload) - 2) THEN (CAST('0x' || substr(payload, 3 + (5 * k + b) // 4, 1) AS BIGINT) >> (3 - (5 * k + b) % 4)) & 1 ELSE 0 END), lambda p, q: 2 * p + q))) AS words FROM w32),
b1 AS (SELECT payload, words, xor({_POLYMOD}, CASE WHEN words[1] = 0 THEN 1 ELSE 734539939 END) AS chk FROM b0),
b32 AS (SELECT payload, 'bc1' || array_to_string(list_transform(list_concat(words, list_transform(range(0, 6), lambda i: (chk >> (5 * (5 - i))) & 31)), lambda w: {_CHARS}), '') AS address FROM b1)"""
_VERSIONS = "CASE coin " + " ".join(f"WHEN '{k}' THEN '{c.version_id:02x}'" for k, c in COINS.items()) + " END"
ADDRESSES = f""", s AS (SELECT txid, index_out, coin, {_VERSIONS} AS v, lower(hex(script_pubkey)) AS s FROM o),
p AS (SELECT txid, index_out, CASE WHEN v IS NULL THEN NULL WHEN regexp_matches(s, '^76a914[0-9a-f]{{40}}88ac$') THEN v || substr(s, 7, 40) WHEN regexp_matches(s, '^a914[0-9a-f]{{40}}87$') THEN '05' || substr(s, 5, 40) END AS hashed,
  CASE WHEN coin = 'bitcoin' AND regexp_matches(s, '^(0014[0-9a-f]{{40}}|0020[0-9a-f]{{64}})$') THEN '00' || substr(s, 5)
    WHEN coin = 'bitcoin' AND length(s) BETWEEN 8 AND 84 AND regexp_matches(s, '^(5[1-9a-f]|60)') AND CAST('0x' || substr(s, 3, 2) AS INT) * 2 = length(s) - 4 THEN printf('%02x', CAST('0x' || substr(s, 1, 2) AS INT) - 80) || substr(s, 5) END AS program FROM s),
{_base58_sql("p", "hashed")}, w32 AS (SELECT DISTINCT program AS payload FROM p WHERE program IS NOT NULL), {_BECH32_SQL}
SELECT txid, index_out, coalesce(c58.address, b32.address) AS address FROM p LEFT JOIN c58 ON c58.payload = p.hashed LEFT JOIN b32 ON b32.payload = p.program"""


def _addresses(spark, d) -> DataFrame:
    """Outputs with the address read from their script by the version of their coin; an unknown coin has none."""
    version = F.create_map(*[F.lit(x) for k, c in COINS.items() for x in (k, c.version_id)])[F.col("coin")]
    rows = ledger.tx_out(spark, d).withColumn("v", version)
    return rows.withColumn("read", F.when(F.col("v").isNotNull(), scripts.evaluated(F.col("script_pubkey"), F.coalesce("v", F.lit(0)))["address"]))


@query(ADDRESSES)
def script_addresses(spark, d):
    """The address read from the script of every output. SQL has no RIPEMD-160 and so none for bare public keys, which the tables don't hold."""
    return _addresses(spark, d).select("txid", "index_out", F.col("read").alias("address"))


@query(ADDRESSES[: ADDRESSES.rindex("SELECT txid")] + """SELECT o.coin, txid, index_out, o.pattern, o.address AS recorded, coalesce(c58.address, b32.address) AS address
FROM o JOIN p USING (txid, index_out) LEFT JOIN c58 ON c58.payload = p.hashed LEFT JOIN b32 ON b32.payload = p.program""")
def script_addresses_all(spark, d):
    """Every output with its recorded address beside that read from its script by the version of its coin; no address is read for an unknown coin."""
    return _addresses(spark, d).select("coin", "txid", "index_out", "pattern", F.col("address").alias("recorded"), F.col("read").alias("address"))


_FIRST = "CAST('0x' || substr(s, {0}, 2) AS INT)"
_OTHER_KINDS = f"""CASE WHEN regexp_matches(s, '^76a914[0-9a-f]{{40}}88ac$') THEN '{scripts.P2PKH}'
  WHEN length(s) > 4 AND {_FIRST.format(1)} BETWEEN 1 AND 75 AND length(s) = 4 + 2 * {_FIRST.format(1)} AND s LIKE '%ac' THEN '{scripts.P2PK}'
  WHEN regexp_matches(s, '^a914[0-9a-f]{{40}}87$') THEN '{scripts.P2SH}'
  WHEN s LIKE '6a%' AND length(s) > 4 AND (({_FIRST.format(3)} BETWEEN 1 AND 75 AND length(s) = 4 + 2 * {_FIRST.format(3)}) OR (substr(s, 3, 2) = '4c' AND length(s) > 6 AND length(s) = 6 + 2 * {_FIRST.format(5)})) THEN '{scripts.OP_RETURN}'
  WHEN regexp_matches(s, '^52{_KEY}{_KEY}{_KEY}53ae$') THEN '{scripts.MULTISIG}' WHEN s IS NOT NULL THEN '{scripts.UNKNOWN}' END"""
_OTHER_COINS = ", ".join(f"('{k}')" for k, c in COINS.items() if c.version_id not in (0, 0x6F))


@query(f"""SELECT chain, pattern, count(*) AS n, count(DISTINCT CASE WHEN pattern IN ('{scripts.P2PKH}', '{scripts.P2PK}', '{scripts.P2SH}') THEN s END) AS addresses
FROM (SELECT s, {_OTHER_KINDS} AS pattern FROM (SELECT lower(hex(scriptpubkey)) AS s FROM tx_out)) x, (VALUES {_OTHER_COINS}) c(chain) GROUP BY 1, 2""", plain=True)
def script_other_coins(spark, d):
    """Scripts read as those of a coin with its own address version, for each of them."""
    versions = F.array(*[F.struct(F.lit(k).alias("chain"), F.lit(c.version_id).alias("v")) for k, c in COINS.items() if c.version_id not in (0, 0x6F)])
    rows = table(spark, d, "tx_out").select("scriptpubkey", F.explode(versions).alias("c"))
    read = rows.select("c.chain", scripts.evaluated(F.col("scriptpubkey"), F.col("c.v")).alias("e"))
    return read.groupBy("chain", F.col("e.pattern").alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("e.address").alias("addresses"))


# Scalars.
@query("SELECT id, sha256(unhex(sha256(scriptpubkey))) AS digest FROM tx_out", plain=True)
def dsha256(spark, d):
    return table(spark, d, "tx_out").select("id", exprs.double_sha256(F.col("scriptpubkey")).alias("digest"))


_REV = "array_to_string(list_reverse(regexp_extract_all({0}, '..')), '')"


@query("SELECT block_hash, " + _REV.format("block_hash") + " AS shown FROM b")
def hash_display(spark, d):
    return ledger.blocks(spark, d).select("block_hash", exprs.reverse_hex(F.col("block_hash")).alias("shown"))


@query("SELECT id, lower(hex(scriptsig)) AS text, octet_length(unhex(hex(scriptsig))) AS n_bytes FROM tx_in", plain=True)
def hex_roundtrip(spark, d):
    rows = table(spark, d, "tx_in").select("id", exprs.to_hex(F.col("scriptsig")).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length(exprs.from_hex(F.col("text"))).cast("bigint"))


def _le(c: str) -> str:
    return _REV.format(f"printf('%08x', {c} & 4294967295)")


HEADER = f"{_le('version')} || {_REV.format('hash_prev')} || {_REV.format('hash_merkle_root')} || {_le('n_time')} || {_le('n_bits')} || {_le('n_nonce')}"


@query(f"SELECT block_hash, {HEADER} AS header, {_REV.format(f'sha256(unhex(sha256(unhex({HEADER}))))')} AS computed FROM b")
def header_hash(spark, d):
    parts = [F.col(c) for c in ("version", "hash_prev", "hash_merkle_root", "n_time", "n_bits", "n_nonce")]
    rows = ledger.blocks(spark, d).select("block_hash", exprs.header_hex(*parts).alias("header"))
    return rows.withColumn("computed", exprs.reverse_hex(exprs.double_sha256(F.unhex("header"))))


_BYTE = "CAST('0x' || {0} AS UBIGINT)"
_S = "lower(hex(scriptsig))"


def _wide(n: int) -> str:
    return f"CASE WHEN length({_S}) >= {2 + 2 * n} THEN {_BYTE.format(_REV.format(f'substr({_S}, 3, {2 * n})'))} END"


@query(f"""SELECT id, CAST(CASE WHEN length({_S}) < 2 THEN NULL WHEN substr({_S}, 1, 2) = 'fd' THEN {_wide(2)} WHEN substr({_S}, 1, 2) = 'fe' THEN {_wide(4)} WHEN substr({_S}, 1, 2) = 'ff' THEN {_wide(8)}
  ELSE {_BYTE.format(f"substr({_S}, 1, 2)")} END AS DECIMAL(20,0)) AS size FROM tx_in""", plain=True)
def compactsize_decode(spark, d):
    return table(spark, d, "tx_in").select("id", exprs.compact_size(F.col("scriptsig")).alias("size"))


@query("SELECT DISTINCT n_bits, round(log2((n_bits % 16777216) * pow(256, n_bits // 16777216 - 3)), 6) AS log_target FROM b")
def bits_target(spark, d):
    return ledger.blocks(spark, d).select("n_bits", F.round(F.log2(exprs.target(F.col("n_bits"))), 6).alias("log_target")).distinct()


_XOR_KEY = [1, 35, 69, 103, 137, 171, 205, 239]
_XORED = f"""array_to_string(list_transform(range(0, octet_length(scriptsig)), lambda k: printf('%02X', xor(CAST('0x' || substr(hex(scriptsig), 2 * k + 1, 2) AS INT), {_XOR_KEY}[(id + k) % 8 + 1]))), '')"""


@query(f"SELECT id, {_XORED} AS plain FROM tx_in WHERE scriptsig IS NOT NULL", plain=True)
def xor_decode(spark, d):
    """Scripts taken as the XORed bytes of a file from position `id` on, and read once."""

    def read(batches):
        key = bytes(_XOR_KEY)
        for batch in batches:
            back = [codec.unxor(s, key, i).hex().upper() for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["id", "plain"])

    return table(spark, d, "tx_in").where("scriptsig IS NOT NULL").select("id", "scriptsig").mapInArrow(read, "id bigint, plain string")


# Checks.
@query("SELECT a.coin, a.block_hash, a.height, p.block_hash AS expected, a.hash_prev AS found FROM b a JOIN b p ON p.coin = a.coin AND p.height = a.height - 1 WHERE p.block_hash <> a.hash_prev")
def prev_hash_link(spark, d):
    return verify.link_violations(ledger.blocks(spark, d), COIN)


@query(f"SELECT block_hash, height - 250000 AS height, '{coin('bitcoin').genesis}' AS expected FROM b WHERE height = 250000 AND block_hash <> '{coin('bitcoin').genesis}'")
def genesis_check(spark, d):
    rows = ledger.blocks(spark, d).withColumn("height", F.col("height") - 250_000)
    return verify.genesis_violations(rows, coin("bitcoin").genesis)


MERKLE = """, m0 AS (SELECT hash_block, list(CAST(unhex(array_to_string(list_reverse(regexp_extract_all(txid, '..')), '')) AS BLOB) ORDER BY tx_index) AS l FROM t GROUP BY 1),
m AS (SELECT hash_block, l FROM m0 UNION ALL
  SELECT hash_block, list_transform(range(0, len(l), 2), lambda k: unhex(sha256(unhex(sha256(l[k + 1] || coalesce(l[k + 2], l[k + 1])))))) FROM m WHERE len(l) > 1),
r AS (SELECT hash_block, array_to_string(list_reverse(regexp_extract_all(lower(hex(l[1])), '..')), '') AS merkle_root FROM m WHERE len(l) = 1)
"""


@query(MERKLE + "SELECT hash_block, merkle_root FROM r")
def merkle_root(spark, d):
    return verify.merkle_roots(ledger.transactions(spark, d))


@query(MERKLE + "SELECT block_hash, height, hash_merkle_root AS expected, merkle_root AS found FROM b JOIN r ON hash_block = block_hash WHERE merkle_root <> hash_merkle_root")
def merkle_verify(spark, d):
    return verify.merkle_violations(*ledger.all_tables(spark, d)[:2])


# Sinks and views.
_F = "coalesce(CAST({0} AS VARCHAR), '')"


def _line(columns: str) -> str:
    return " || ';' || ".join(_F.format(c.strip()) for c in columns.split("|"))


@query(f"SELECT {_line(BLOCK_COLUMNS.replace(', ', '|'))} AS line FROM b")
def csv_block_line(spark, d):
    return csv_line(ledger.blocks(spark, d), "blocks")


@query(f"SELECT {_line('txid|hash_block|version|lock_time')} AS line FROM t")
def csv_tx_line(spark, d):
    return csv_line(ledger.transactions(spark, d), "transactions")


@query(f"SELECT {_line('txid|hash_prev_out|index_prev_out|lower(hex(script_sig))|sequence')} AS line FROM i")
def csv_in_line(spark, d, whole=False):
    return csv_line(ledger.tx_in(spark, d, whole=whole), "tx_in")


@query(f"SELECT {_line('txid|index_out|value|lower(hex(script_pubkey))|address')} AS line FROM o")
def csv_out_line(spark, d):
    return csv_line(ledger.tx_out(spark, d), "tx_out")


@query("SELECT height, block_hash, version, hash_prev, hash_merkle_root, n_time, n_bits, n_nonce FROM b ORDER BY height")
def view_blocks(spark, d):
    return views.view_blocks(ledger.blocks(spark, d))


@query("SELECT txid, hash_block, version, lock_time FROM t")
def view_transactions(spark, d):
    return views.view_transactions(ledger.transactions(spark, d))


# Raw blocks: bytes put together from the columns by expressions, and read by the codec.
def _raw_txs(spark, d, witness: bool, whole: bool) -> DataFrame:
    """(txid, hash_block, tx_index, lost, raw) of each transaction, raw being hex; lost tells that its last input names no outpoint.

    A missing outpoint is written as zeros. A transaction without inputs has the witness form, in which alone it can be told from its marker.
    """
    _, txs, tx_in, tx_out = ledger.raw_tables(spark, d, whole)

    def joined(df, place, part, *more):
        parts = F.transform(F.array_sort(F.collect_list(F.struct(place, part.alias("h")))), lambda x: x["h"])
        return df.groupBy("txid").agg(F.array_join(parts, "").alias("parts"), F.count(F.lit(1)).alias("k"), *more)

    lost = F.max_by(F.col("hash_prev_out").isNull(), "in_index").alias("lost")
    i = joined(tx_in, "in_index", exprs.input_hex(hash_text("hash_prev_out"), *[F.col(c) for c in ("index_prev_out", "script_sig", "sequence")]), lost)
    o = joined(tx_out, "index_out", exprs.output_hex(F.col("value"), F.col("script_pubkey")))
    i, o = (df.withColumnsRenamed({"parts": f"{n}_parts", "k": f"{n}_k"}) for df, n in ((i, "in"), (o, "out")))
    t = txs.join(i, "txid", "left").join(o, "txid", "left").na.fill({"in_k": 0, "out_k": 0, "in_parts": "", "out_parts": ""})
    stack = "0247" + "01" * 71 + "00"
    raw = F.concat(
        exprs.little_endian(F.coalesce("version", F.lit(1)), 4),
        F.lit("0001") if witness else F.when(F.col("in_k") == 0, "0001").otherwise(""),
        exprs.compact_hex(F.col("in_k")), "in_parts", exprs.compact_hex(F.col("out_k")), "out_parts",
        F.expr(f"repeat('{stack}', cast(in_k as int))") if witness else F.lit(""),
        exprs.little_endian(F.coalesce("lock_time", F.lit(0)), 4),
    )
    return ledger.shown(t.select("txid", "hash_block", "tx_index", F.coalesce("lost", F.lit(False)).alias("lost"), raw.alias("raw")))


def _read_txs(spark, d, witness: bool, whole: bool) -> DataFrame:
    def read(batches):
        for batch in batches:
            ids, lost = batch.column(0), batch.column(1).to_pylist()
            back = []
            for raw in batch.column(2).to_pylist():
                tx, end = codec.read_tx(raw)
                assert end == len(raw)
                back.append(tx)
            counts = [pa.array([x[c] for x in back], pa.int64()) for c in ("in_count", "out_count", "stripped_size", "lock_time", "version")]
            last = pa.array([x["inputs"][-1]["hash_prev_out"] if x["inputs"] and not gone else None for x, gone in zip(back, lost)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, *counts, last], names=["txid", "in_count", "out_count", "stripped_size", "lock_time", "version", "last_prev_out"])

    raw = _raw_txs(spark, d, witness, whole).select("txid", "lost", F.unhex("raw").alias("raw"))
    return raw.mapInArrow(read, "txid string, in_count bigint, out_count bigint, stripped_size bigint, lock_time bigint, version bigint, last_prev_out string")


RAW = SIZES + """SELECT t.txid, coalesce(si.n, 0) AS in_count, coalesce(so.n, 0) AS out_count, z.stripped_size, coalesce(t.lock_time, 0) AS lock_time, coalesce(t.version, 1) AS version, k.last_prev_out
FROM t LEFT JOIN si USING (coin, txid) LEFT JOIN so USING (coin, txid) JOIN z USING (coin, txid) LEFT JOIN (SELECT txid, arg_max(hash_prev_out, in_index) AS last_prev_out FROM i GROUP BY 1) k ON k.txid = t.txid"""


@query(RAW)
def tx_decode(spark, d, whole=False):
    return _read_txs(spark, d, False, whole)


@query(RAW)
def segwit_decode(spark, d, whole=False):
    """The same through the witness form, which must not change sizes."""
    return _read_txs(spark, d, True, whole)


def _header(version=None) -> F.Column:
    """Hex of the header of a block of the ledger; missing fields are zeros."""
    n = lambda c: F.coalesce(c, F.lit(0))
    h = lambda c: F.coalesce(c, F.lit(ledger.ZERO))
    return exprs.header_hex(n("version") if version is None else F.lit(version), h("hash_prev"), h("hash_merkle_root"), n("n_time"), n("n_bits"), n("n_nonce"))


def _filled(sql: str) -> str:
    for c in ("version", "n_time", "n_bits", "n_nonce"):
        sql = re.sub(rf"\b{c}\b", f"coalesce({c}, 0)", sql)
    for c in ("hash_prev", "hash_merkle_root"):
        sql = re.sub(rf"\b{c}\b", f"coalesce({c}, '{ledger.ZERO}')", sql)
    return sql


FULL_HEADER = _filled(HEADER)
COMPUTED = _REV.format(f"sha256(unhex(sha256(unhex({FULL_HEADER}))))")


def _decoded(rows: DataFrame, chain: str) -> DataFrame:
    """Blocks as the block files' source gives them, from (height, raw as hex)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(BLOCK)
    arrow, of = to_arrow_schema(schema), coin(chain)

    def read(batches):
        for batch in batches:
            blocks = [codec.read_block(raw, of) | {"height": h} for h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(blocks, arrow)

    return rows.select("height", F.unhex("raw").alias("raw")).mapInArrow(read, schema)


def _raw_blocks(spark, d) -> DataFrame:
    txs = _raw_txs(spark, d, False, True)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("tx_index", "raw"))), lambda x: x["raw"])  # a block bounds its transactions
    txs = txs.groupBy(F.col("hash_block").alias("block_hash")).agg(F.array_join(parts, "").alias("txs"), F.count(F.lit(1)).alias("k"))
    rows = ledger.blocks(spark, d).join(txs, "block_hash", "left").na.fill({"txs": "", "k": 0})
    return rows.select("height", F.concat(_header(), exprs.compact_hex(F.col("k")), "txs").alias("raw"))


_J = SIZES.replace("FROM i ", "FROM j ")
BLOCK_SQL = ledger.WHOLE_SQL + _J + f""", y AS (SELECT t.hash_block, count(*) AS n, sum(z.stripped_size + CASE WHEN si.n IS NULL THEN 2 ELSE 0 END) AS w
  FROM t JOIN z USING (coin, txid) LEFT JOIN si USING (coin, txid) GROUP BY 1)
SELECT height, {COMPUTED} AS block_hash, coalesce(version, 0) AS version, coalesce(n_time, 0) AS n_time, coalesce(n_bits, 0) AS n_bits, coalesce(n_nonce, 0) AS n_nonce,
  coalesce(hash_prev, '{ledger.ZERO}') AS hash_prev, coalesce(hash_merkle_root, '{ledger.ZERO}') AS hash_merkle_root, coalesce(y.n, 0) AS tx_count,
  CAST(80 + {W.format('coalesce(y.n, 0)')} + coalesce(y.w, 0) AS BIGINT) AS blocksize FROM b LEFT JOIN y ON y.hash_block = b.block_hash"""


@query(BLOCK_SQL, plain=True)
def block_decode(spark, d):
    """The headers and sizes of whole blocks, read from their bytes."""
    return _decoded(_raw_blocks(spark, d), "bitcoin").select("height", "block_hash", "version", "n_time", "n_bits", "n_nonce", "hash_prev", "hash_merkle_root", "tx_count", "blocksize")


FLATTEN_SQL = ledger.WHOLE_SQL + _J + f""", y AS (SELECT coin, txid, count(*) = 1 AND bool_or(hash_prev_out = '{ledger.ZERO}' AND index_prev_out = 4294967295) AS c FROM j GROUP BY 1, 2),
x AS (SELECT block_hash, {COMPUTED} AS computed FROM b)
SELECT x.computed AS hash_block, row_number() OVER (PARTITION BY t.hash_block ORDER BY t.tx_index) - 1 AS tx_index, coalesce(si.n, 0) AS n_inputs, coalesce(so.n, 0) AS n_outputs,
  z.stripped_size, coalesce(y.c, false) AS is_coinbase, z.total_value FROM t JOIN x ON x.block_hash = t.hash_block JOIN z USING (coin, txid) LEFT JOIN si USING (coin, txid) LEFT JOIN so USING (coin, txid) LEFT JOIN y USING (coin, txid)"""


@query(FLATTEN_SQL, plain=True)
def block_flatten(spark, d):
    """The relations of whole blocks read from their bytes: each transaction with the rows of its inputs and outputs."""
    t = flatten(Saved(_decoded(_raw_blocks(spark, d), "bitcoin"), "decoded").df, coin("bitcoin"))
    key = ["txid", "height", "tx_index"]
    i = t["tx_in"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_inputs"))
    o = t["tx_out"].groupBy(*key).agg(F.count(F.lit(1)).alias("n_outputs"), F.sum("value").cast("decimal(38,0)").alias("total_value"))
    rows = t["transactions"].join(i, key, "left").join(o, key, "left").na.fill({"n_inputs": 0, "n_outputs": 0})
    total = F.coalesce("total_value", F.lit(0)).cast("decimal(38,0)").alias("total_value")
    return rows.select("hash_block", F.col("tx_index").cast("bigint").alias("tx_index"), "n_inputs", "n_outputs", "stripped_size", F.coalesce("is_coinbase", F.lit(False)).alias("is_coinbase"), total)


@query(f"""SELECT block_hash, {COMPUTED} AS parent, block_hash AS named, coalesce(hash_prev, '{ledger.ZERO}') || ',' || coalesce(hash_merkle_root, '{ledger.ZERO}') AS branch, height AS side_mask,
  coalesce(n_nonce, 0) AS parent_nonce, 0 AS chain_hashes, 6422788 AS version FROM b WHERE octet_length(block_hash::BLOB) = 64""")
def auxpow_decode(spark, d):
    """A merged-mining extension made from each block's own fields and read in front of an empty block."""
    rows = ledger.blocks(spark, d).where(F.octet_length("block_hash") == 64)
    zero, none = F.lit(None).cast("string"), F.lit(4294967295).cast("bigint")
    coinbase = F.concat(F.lit("0100000001"), exprs.input_hex(zero, none, F.unhex("block_hash"), none), F.lit("01"), exprs.output_hex(F.col("height"), F.lit(b"\x51")), F.lit("00000000"))
    prev, merkle = (exprs.reverse_hex(F.coalesce(c, F.lit(ledger.ZERO))) for c in ("hash_prev", "hash_merkle_root"))
    branches = F.concat(F.lit("02"), prev, merkle, exprs.little_endian(F.col("height"), 4), F.lit("00"), F.lit("00000000"))
    raw = F.concat(_header(0x620104), coinbase, exprs.reverse_hex(F.col("block_hash")), branches, _header(), F.lit("00"))
    a = _decoded(rows.select("height", raw.alias("raw")), "dogecoin").select("version", "aux_pow.*")
    return a.select(
        F.col("block_hash"), F.col("parent_block.block_hash").alias("parent"), F.col("block_hash").alias("named"), F.array_join("coinbase_branch.hashes", ",").alias("branch"),
        F.col("coinbase_branch.side_mask").alias("side_mask"), F.col("parent_block.n_nonce").alias("parent_nonce"), F.size("blockchain_branch.hashes").alias("chain_hashes"), F.col("version").cast("int").alias("version"),
    )


# Those whose SQL leaves out the inputs that name no outpoint, over all existing inputs.
WHOLE = ["chain_tx_in", "csv_in_line", "utxo_counters", "stats_totals", "stats_ratios", "tx_sizes", "biggest_size_tx", "tx_decode", "segwit_decode"]
for _name in WHOLE:
    QUERIES[f"{_name}_whole"] = partial(QUERIES[_name], whole=True)
    _own = re.sub(r"\bFROM i\b", "FROM j", SQL[_name].removeprefix(ledger.SQL))
    SQL[f"{_name}_whole"] = ledger.WHOLE_SQL + _own.replace("arg_max(", "arg_max_null(")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
