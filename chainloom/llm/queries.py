"""The queries of the training-data problems and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.normalise import clean_address, clean_name, real_hash_of, sql_address, sql_name, sql_real_hash
from chainloom.llm import chain
from chainloom.llm.components import group_members
from chainloom.llm.distinct_runs import merge_counts, run_states
from chainloom.llm import language
from chainloom.llm.mixing import mix
from chainloom.llm.percentiles import STATE_BITS, float_key, key_float, radix_select, radix_state
from chainloom.llm.tokens import decode, encode, token_counts
from chainloom.session import Saved, table

DIMS = ["day", "coin", "pattern"]
CUBE = [[d for k, d in enumerate(DIMS) if m >> k & 1] for m in range(8)]


def _address_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_states(chain.outputs(spark, sf_dir), DIMS, "address")


def p1_distinct_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses of existing outputs for each day, coin and script pattern and each combination of them."""
    return merge_counts(_address_states(spark, sf_dir), DIMS, CUBE)


P1 = (
    chain.SQL
    + """SELECT day, coin, pattern, grouping(day) AS day_all, grouping(coin) AS coin_all, grouping(pattern) AS pattern_all,
  count(DISTINCT address) AS n_distinct, count(DISTINCT address)::DOUBLE * (count(DISTINCT address)::DOUBLE - 1) / 36893488147419103232.0::DOUBLE AS collision_bound
FROM o WHERE address IS NOT NULL GROUP BY CUBE (day, coin, pattern)"""
)


def p1_distinct_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily states combined into weeks, for each coin and for all."""
    weekly = _address_states(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    return merge_counts(weekly, ["week", "coin"], [["week", "coin"], ["week"]])


P1_WEEK = (
    chain.SQL
    + """, w AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week FROM o WHERE address IS NOT NULL)
SELECT week, coin, grouping(week) AS week_all, grouping(coin) AS coin_all, count(DISTINCT address) AS n_distinct,
  count(DISTINCT address)::DOUBLE * (count(DISTINCT address)::DOUBLE - 1) / 36893488147419103232.0::DOUBLE AS collision_bound
FROM w GROUP BY GROUPING SETS ((week, coin), (week))"""
)


def p1_merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct addresses for each coin and in all, from three states built apart: of the first day, of the other days, and without a day."""
    outs = Saved(chain.outputs(spark, sf_dir).where("address IS NOT NULL").select("day", "coin", "address"), "outputs").df
    first = F.lit(outs.agg(F.min("day")).first()[0])
    states = [run_states(outs.where(part), ["coin"], "address") for part in (F.col("day") == first, F.col("day") > first, F.col("day").isNull())]
    return merge_counts(states[0].unionByName(states[1]).unionByName(states[2]), ["coin"], [["coin"], []])


P1_MERGED = (
    chain.SQL
    + """SELECT coin, grouping(coin) AS coin_all, count(DISTINCT address) AS n_distinct,
  count(DISTINCT address)::DOUBLE * (count(DISTINCT address)::DOUBLE - 1) / 36893488147419103232.0::DOUBLE AS collision_bound
FROM o WHERE address IS NOT NULL GROUP BY ROLLUP (coin)"""
)


def _address_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, first) for addresses whose outputs are spent together, directly or through others."""
    outs = table(spark, sf_dir, "tx_out").select(
        real_hash_of("txid").alias("h"), F.col("indexout").alias("i"), clean_address("address").alias("address")
    )
    ins = table(spark, sf_dir, "tx_in").select(
        real_hash_of("hashprevout").alias("h"), F.col("indexprevout").alias("i"), real_hash_of("txid").alias("tx")
    )
    outs = outs.where("h IS NOT NULL AND i IS NOT NULL AND address IS NOT NULL").distinct()
    ins = ins.where("h IS NOT NULL AND i IS NOT NULL AND tx IS NOT NULL").distinct()
    return group_members(ins.join(outs, ["h", "i"]).select("tx", "address"), "tx", "address")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address_first, address): each address of a group of two or more except its smallest, beside the smallest."""
    groups = _address_groups(spark, sf_dir)
    return groups.where("address <> first").select(F.col("first").alias("address_first"), "address")


_P3 = f"""
WITH RECURSIVE o AS (SELECT DISTINCT {sql_real_hash("txid")} AS h, indexout AS i, {sql_address("address")} AS a FROM tx_out),
n AS (SELECT DISTINCT {sql_real_hash("hashprevout")} AS h, indexprevout AS i, {sql_real_hash("txid")} AS tx FROM tx_in),
l AS (SELECT DISTINCT tx, a FROM n JOIN o USING (h, i) WHERE a IS NOT NULL AND tx IS NOT NULL),
s AS (SELECT tx, min(a) AS hub FROM l GROUP BY tx),
e0 AS (SELECT DISTINCT hub, a FROM l JOIN s USING (tx) WHERE hub <> a),
e AS (SELECT hub AS x, a AS y FROM e0 UNION SELECT a, hub FROM e0),
g(x, low) USING KEY (x) AS (
  SELECT x, min(least(x, y)) FROM e GROUP BY x
  UNION
  SELECT e.x, min(f.low) FROM g AS f JOIN e ON e.y = f.x JOIN recurring.g AS r ON r.x = e.x WHERE f.low < r.low GROUP BY e.x)
"""


def p3_address_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, group_id) for each address of tx_out: the smallest address of its group, itself where it is alone."""
    every = table(spark, sf_dir, "tx_out").select(clean_address("address").alias("address")).where("address IS NOT NULL").distinct()
    return every.join(_address_groups(spark, sf_dir), "address", "left").select("address", F.coalesce("first", "address").alias("group_id"))


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain.outputs(spark, sf_dir).where("value IS NOT NULL")
    return Saved(rows.select(*DIMS, "value"), "values").df


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Saved(chain.blocks(spark, sf_dir).where("blocksize IS NOT NULL").select("day", "coin", "blocksize"), "sizes").df


def p4_value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the values of existing outputs for each coin, script pattern and day."""
    return radix_select(_values(spark, sf_dir), DIMS, "value", QUANTILES)


def p4_value_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of values for each coin and week from merged daily states, with the largest value they may stand for."""
    daily = radix_state(_values(spark, sf_dir), ["day", "coin"], "value")
    weekly = daily.withColumn("week", F.to_date(F.date_trunc("week", "day")))
    merged = Saved(weekly.groupBy("week", "coin", "key").agg(F.sum("weight").alias("weight")), "weekly").df
    return radix_select(merged, ["week", "coin"], "key", QUANTILES, weight="weight")


def p4_blocksize_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of block sizes for each coin and day."""
    return radix_select(_sizes(spark, sf_dir), ["day", "coin"], "blocksize", QUANTILES)


def p4_coin_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of values in whole coins, which are floating numbers, for each coin and script pattern."""
    coins = _values(spark, sf_dir).select("coin", "pattern", float_key(F.col("value").cast("double") / F.lit(1e8)).alias("key"))
    found = radix_select(Saved(coins, "keys").df, ["coin", "pattern"], "key", QUANTILES)
    return found.withColumn("value", key_float("value"))


def _ranked(groups: str, source: str, value: str) -> str:
    return f""", r AS (SELECT {groups}, {value} AS value, count(*) OVER (PARTITION BY {groups}) AS n,
  row_number() OVER (PARTITION BY {groups} ORDER BY {value}) AS k FROM {source} WHERE {value} IS NOT NULL),
q AS (SELECT unnest({QUANTILES}::DOUBLE[]) AS q)
SELECT {groups}, n, q, value FROM r JOIN q ON k = greatest(CAST(ceil(q * n) AS BIGINT), 1)"""


_LEADING = f"((value >> greatest(length(bin(value)) - {STATE_BITS + 1}, 0)) << greatest(length(bin(value)) - {STATE_BITS + 1}, 0))"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of each document by byte_bpe_50k, without special tokens."""
    return encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, digest) of each text as decoded from its ids."""
    texts = decode(p6_ids(spark, sf_dir))
    return texts.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


P6_DECODED = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents"


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    named = docs.select(F.struct("doc_id", clean_name("source").alias("source")).alias("doc"), "text")  # kept by row: doc_id may be null or repeated
    sizes = token_counts(named, doc="doc").select("doc.doc_id", "doc.source", "n_tokens")
    return mix(Saved(sizes, "sizes").df, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture: doc_id, source, pass, n_tokens, finish, end_token."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source of mix_targets."""
    return _mixed(spark, sf_dir)[1]


def _mixed_bytes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = table(spark, sf_dir, "documents").select("doc_id", clean_name("source").alias("source"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_tokens"))
    return mix(Saved(sizes, "sizes").df, table(spark, sf_dir, "mix_targets"))


def p7_mix_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with sizes in bytes instead of tokens, which SQL can measure too."""
    return _mixed_bytes(spark, sf_dir)[0].withColumnRenamed("n_tokens", "n_bytes").withColumnRenamed("end_token", "end_byte")


def p7_shares_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of that mixture."""
    return _mixed_bytes(spark, sf_dir)[1].withColumnRenamed("n_tokens", "n_bytes")


P7_BYTES = f"""
WITH d AS (SELECT doc_id, {sql_name("source")} AS source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT {sql_name("source")} AS source, greatest(coalesce(max(target_share), 0), 0)::DOUBLE AS share, greatest(coalesce(max(max_repeats), 0), 0) AS reps
  FROM mix_targets WHERE {sql_name("source")} IS NOT NULL GROUP BY 1),
p AS (SELECT w.*, coalesce(n_docs, 0) AS n_docs, coalesce(line, 0) AS line, coalesce(largest, 0) AS largest FROM w
  LEFT JOIN (SELECT source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS line, max(n) AS largest FROM d WHERE n > 0 GROUP BY 1) h USING (source)),
u AS (SELECT * FROM p WHERE share > 0 AND reps > 0 AND line > 0),
f AS (SELECT min((line * reps)::DOUBLE / share) AS t, min((line * reps)::DOUBLE / share) + max(largest::DOUBLE / share) AS stop,
  floor(min((line * reps)::DOUBLE / share) * sum(share::DECIMAL(38,18))::DOUBLE) AS most FROM u),
x AS (SELECT doc_id, source, n, share, line, unnest(range(1, CAST(least(reps, ceil(stop * share / line)) AS BIGINT) + 1)) AS pass FROM d JOIN u USING (source), f WHERE n > 0),
y AS (SELECT *, CAST('0x' || substr(md5(concat_ws('-', doc_id, pass, 0)), 1, 15) AS BIGINT) AS h FROM x),
z AS (SELECT *, ((pass - 1) * line + sum(n) OVER (PARTITION BY source, pass ORDER BY h, doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING))::BIGINT::DOUBLE / share AS finish FROM y),
m AS (SELECT *, CAST(sum(n) OVER (ORDER BY finish, source, pass, h, doc_id NULLS FIRST, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_byte FROM z),
r AS (SELECT doc_id, source, CAST(pass AS INT) AS pass, n AS n_bytes, finish, end_byte FROM m WHERE end_byte <= (SELECT most FROM f)),
k AS (SELECT source, count(*) AS n_records, CAST(sum(n_bytes) AS BIGINT) AS taken, max(pass) AS passes FROM r GROUP BY 1),
s AS (SELECT source, share AS target_share, CAST(reps AS INT) AS max_repeats, n_docs, line AS n_bytes, coalesce(n_records, 0) AS n_records, coalesce(taken, 0) AS taken,
  coalesce(passes, 0) AS passes, coalesce(taken, 0)::DOUBLE / (SELECT sum(taken) FROM k)::DOUBLE AS actual_share FROM p LEFT JOIN k USING (source))
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("_metadata.file_path").alias(language.FILE))
    return language.label_codes(docs, table(spark, sf_dir, "lang_names"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang): each language in which the text is written and which its label doesn't name."""
    docs = _labelled(spark, sf_dir)
    return language.found(docs, language.train(docs))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, with confidence, share of the text and the code of its label."""
    docs = _labelled(spark, sf_dir)
    return language.documents(docs, language.train(docs))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each document by language, with confidence."""
    docs = _labelled(spark, sf_dir)
    return language.segments(docs, language.train(docs))


def queries() -> dict:
    return {
        "p1_distinct_addresses": p1_distinct_addresses,
        "p1_distinct_by_week": p1_distinct_by_week,
        "p1_merged_states": p1_merged_states,
        "p3_found": p3_found,
        "p3_address_groups": p3_address_groups,
        "p4_value_percentiles": p4_value_percentiles,
        "p4_value_by_week": p4_value_by_week,
        "p4_blocksize_percentiles": p4_blocksize_percentiles,
        "p4_coin_percentiles": p4_coin_percentiles,
        "p6_ids": p6_ids,
        "p6_decoded": p6_decoded,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_mix_by_bytes": p7_mix_by_bytes,
        "p7_shares_by_bytes": p7_shares_by_bytes,
        "p8_found": p8_found,
        "p8_documents": p8_documents,
        "p8_segments": p8_segments,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_distinct_addresses": P1,
        "p1_distinct_by_week": P1_WEEK,
        "p1_merged_states": P1_MERGED,
        "p3_found": _P3 + "SELECT low AS address_first, x AS address FROM g WHERE low <> x",
        "p3_address_groups": _P3 + ", v AS (SELECT DISTINCT a FROM o WHERE a IS NOT NULL) SELECT a AS address, coalesce(low, a) AS group_id FROM v LEFT JOIN g ON g.x = v.a",
        "p4_value_percentiles": chain.SQL + _ranked("day, coin, pattern", "o", "value"),
        "p4_value_by_week": chain.SQL
        + f", w AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week, {_LEADING} AS lead FROM o WHERE value IS NOT NULL)"
        + _ranked("week, coin", "w", "lead"),
        "p4_blocksize_percentiles": chain.SQL + _ranked("day, coin", "b", "blocksize"),
        "p4_coin_percentiles": chain.SQL + _ranked("coin, pattern", "o", "(value::DOUBLE / 100000000.0::DOUBLE)"),
        "p6_decoded": P6_DECODED,
        "p7_mix_by_bytes": P7_BYTES + "SELECT * FROM r",
        "p7_shares_by_bytes": P7_BYTES + "SELECT * FROM s",
    }
