"""References to records that do not exist.

Parent keys are integers within a prefix. Those of a prefix are sorted and compressed into runs of consecutive
integers, and each distinct reference is matched as of the preceding run start: it is an orphan if there is none or
its integer lies beyond the run's end. A hash of 64 hex digits is the prefix of its first 52 digits and the integer
of its last 12; an outpoint is the prefix of its hash and the integer of its output index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.session import BROADCAST_BYTES, Saved, small_side

#: Runs are cut at multiples of 2 ** BLOCK_BITS, so that the match of a key needs no other block than its own.
BLOCK_BITS = 20
KEY = ["p", "n"]


def hash_key(df: DataFrame, hash_col: Column, *keep: Column) -> DataFrame:
    """(p, n, keep...) of the bytes of a hash; what hasn't 32 bytes is a prefix of its own with integer -1."""
    df = df.select(hash_col.alias("__h"), *keep)
    whole = F.length("__h") == 32
    n = F.when(whole, F.conv(F.hex(F.substring("__h", 27, 6)), 16, 10).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return df.withColumn("p", F.when(whole, F.substring("__h", 1, 26)).otherwise(F.col("__h"))).withColumn("n", n).drop("__h")


def outpoint_key(df: DataFrame, hash_col: Column, index: Column, *keep: Column) -> DataFrame:
    """(p, n, keep...) of an outpoint; a null index gives a null integer, which matches no run."""
    return df.select(hash_col.alias("p"), index.cast("bigint").alias("n"), *keep)


def _block(n: str = "n") -> Column:
    return F.shiftright(F.col(n), BLOCK_BITS).alias("b")


def runs(parents: DataFrame) -> DataFrame:
    """(p, b, first, last): the runs of the distinct non-null keys (p, n) of `parents`."""
    keys = parents.where(F.col("p").isNotNull() & F.col("n").isNotNull()).select("p", _block(), "n")
    keys = keys.distinct()
    before = F.lag("n").over(W.partitionBy("p", "b").orderBy("n"))
    starts = keys.withColumn("s", F.when(before == F.col("n") - 1, None).otherwise(F.col("n")))
    run = F.last("s", ignorenulls=True).over(W.partitionBy("p", "b").orderBy("n"))
    return starts.withColumn("first", run).groupBy("p", "b", "first").agg(F.max("n").alias("last"))


def missing_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """The distinct keys (p, n) of `references` that are no key of `parents`; null prefixes refer to nothing.

    A null integer beside a prefix names no record and is missing.
    """
    asked = references.where(F.col("p").isNotNull()).select("p", F.coalesce(F.shiftright("n", BLOCK_BITS), F.lit(-1)).alias("b"), "n")
    asked = asked.distinct()
    both = runs(parents).select("p", "b", F.col("first").alias("at"), F.lit(0).alias("kind"), "last")
    both = both.unionByName(asked.select("p", "b", F.col("n").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("last")))
    end = F.last("last", ignorenulls=True).over(W.partitionBy("p", "b").orderBy(F.col("at").asc_nulls_first(), "kind"))
    found = both.withColumn("end", end).where("kind = 1")
    return found.where(F.col("end").isNull() | F.col("at").isNull() | (F.col("at") > F.col("end"))).select("p", F.col("at").alias("n"))


def orphans(parents: DataFrame, references: DataFrame, keep: Sequence[str], name: str = "orphans", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `references` whose key (p, n) is missing from `parents`, with the columns `keep`.

    Every reference row comes out once for itself, repeated ones too. The distinct missing keys are written to the
    shared folder; they are broadcast back only if they take at most `limit` bytes, and else joined by shuffle, where AQE
    splits a key that many rows share. No parents: every reference is an orphan; no references: no rows.
    """
    missing = Saved(missing_keys(parents, references), name)
    side = small_side(missing, limit).select(F.col("p").alias("__p"), F.col("n").alias("__n"))
    rows = references.where(F.col("p").isNotNull()).select(*KEY, *keep)
    return rows.join(side, (F.col("p") == F.col("__p")) & F.col("n").eqNullSafe(F.col("__n")), "left_semi").select(*keep)
