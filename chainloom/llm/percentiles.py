"""Percentiles per group by radix selection, and mergeable histograms with a bounded relative error.

Values become order-preserving 64-bit integers. The leading digit of each group's values is counted, the digit that holds
the target rank is followed, and only values behind it are counted by their next digit, until all bits are known. The
result is the value at rank ceil(q * n), exactly. A state keeps values by their leading bits only: it adds up over days
and partitions, and a percentile from it is at most 2 ** -bits below the exact one, relative to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.session import BROADCAST_BYTES, Saved, fits

#: Bits of one digit.
DIGIT = 16
#: Leading bits of a value that a state keeps.
STATE_BITS = 12


@F.pandas_udf(T.LongType())
def float_key(values: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; zeros of either sign are equal, NaN comes last, null stays null."""
    bits = np.where(values.isna(), 0.0, values.to_numpy(dtype="float64", na_value=0.0) + 0.0).view(np.int64)
    key = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
    return pd.Series(key).astype("Int64").mask(values.isna().to_numpy())


@F.pandas_udf(T.DoubleType())
def key_float(keys: pd.Series) -> pd.Series:
    """The doubles of float_key's integers."""
    k = keys.fillna(0).to_numpy(dtype="int64")
    out = np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k).view(np.float64)
    return pd.Series(out).mask(keys.isna().to_numpy())


def leading(value: Column, bits: int = STATE_BITS) -> Column:
    """A BIGINT with all but its leading `bits` + 1 significant bits cleared; negative values by magnitude."""
    size = F.length(F.bin(F.abs(value)))
    drop = F.greatest(size - F.lit(bits + 1), F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", F.abs(value), drop), drop)
    return F.when(value < 0, -kept).otherwise(kept)


def radix_state(df: DataFrame, groups: Sequence[str], value: str, bits: int = STATE_BITS) -> DataFrame:
    """(groups..., key, weight): the histogram of the leading bits of the non-null values. States merge by union."""
    rows = df.where(F.col(value).isNotNull()).select(*groups, leading(F.col(value), bits).alias("key"))
    return rows.groupBy(*groups, "key").agg(F.count(F.lit(1)).alias("weight"))


def _same(groups: Sequence[str], prefix) -> Column:
    """Whether the group and the prefix of a row are those of the digits followed, which have other names."""
    same = prefix == F.col("__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return same


def radix_select(df: DataFrame, groups: Sequence[str], key: str, quantiles: Sequence[float], weight: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(groups..., n, q, value) with the key at rank max(1, ceil(q * n)) of each group, n being its weight.

    Null keys are left out; a group without any other has no rows. Null groups are groups of their own. Ties share ranks as
    in a sorted list. `df` is read once for each digit, so hand in a written table. Only histograms are shuffled, as long as the
    digits being followed (one for each group and quantile at most) take at most `limit` bytes and are broadcast. Beyond it equal keys of
    a group are first added up to one row, and each digit leaves only the rows behind it to the next, written; a group that holds
    much of them is split by AQE.
    """
    rows = df.where(F.col(key).isNotNull()).select(*groups, F.col(key).alias("__key"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"))
    wanted, narrowed = None, None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("__key", shift)
        if wanted is None:
            level, old = rows.withColumn("__prefix", F.lit(0).cast("bigint")), None
        else:
            small = fits(wanted, limit)
            renamed = wanted.df.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__prefix").alias("__p"), "n", "q", "__rank")
            side = renamed.select(*[f"__g_{g}" for g in groups], "__p").distinct()
            old, side = (F.broadcast(renamed), F.broadcast(side)) if small else (renamed, side)
            if not small and narrowed is None:
                rows = rows.groupBy(*groups, "__key").agg(F.sum("__w").alias("__w"))
            level = rows.join(side, _same(groups, F.shiftright("__key", shift + DIGIT))).select(*groups, "__key", F.col("__p").alias("__prefix"), "__w")
            if not small:
                narrowed, gone = Saved(level, f"rows-{shift}"), narrowed
                level, rows = narrowed.df, narrowed.df.drop("__prefix")
                if gone is not None:
                    gone.drop()
        counts = level.groupBy(*groups, "__prefix", digit.alias("__digit")).agg(F.sum("__w").alias("__w"))
        order = W.partitionBy(*groups, "__prefix").orderBy("__digit")
        counts = counts.withColumn("__to", F.sum("__w").over(order.rowsBetween(W.unboundedPreceding, 0)))
        if wanted is None:
            all_of = W.partitionBy(*groups, "__prefix").orderBy("__digit").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
            counts = counts.withColumn("n", F.sum("__w").over(all_of)).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
            counts = counts.withColumn("__rank", F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1)).cast("bigint"))
        else:
            counts = counts.join(old, _same(groups, F.col("__prefix")))
        hit = (F.col("__rank") <= F.col("__to")) & (F.col("__rank") > F.col("__to") - F.col("__w"))
        rank = F.col("__rank") - (F.col("__to") - F.col("__w"))
        found = counts.where(hit).select(*groups, "n", "q", rank.alias("__rank"), F.col("__digit").alias("__prefix"))
        done, wanted = wanted, Saved(found, f"digits-{shift}")
        if done is not None:
            done.drop()
    if narrowed is not None:
        narrowed.drop()
    return wanted.df.select(*groups, "n", "q", F.col("__prefix").alias("value"))
