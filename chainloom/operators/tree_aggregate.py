"""Per-key results when a few keys hold most rows.

Partial states are combined in the input split that holds the rows, then merged in rounds of a fixed fan-in: a state of split p
belongs to node p of the lowest level, and every round merges the states of FAN_IN neighbouring nodes, so that the rounds grow with
the logarithm of the splits. No task ever receives more than FAN_IN partial states of a key, however many rows the key has. A split of
files is a chunk of fixed size (spark.sql.files.maxPartitionBytes), one behind a shuffle of about the advisory size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a key that one task merges at most.
FAN_IN = 64


@dataclass(frozen=True)
class State:
    """One mergeable column: `first` makes it from rows, `merge` from states, `final` the result from a state."""

    name: str
    first: Column
    merge: str = "sum"
    final: Column | None = None


def exact_sum(name: str, col: Column) -> list[State]:
    """Sum of whole numbers below 2 ** 64 (DECIMAL(20,0)) as DECIMAL(38,0).

    States are decimals in every round: the first has 30 digits, enough for 10 ** 10 such values of a key within FAN_IN splits, each later
    one 38. So a sum overflows only where its true value has more than 38 digits, and then fails.
    """
    return [State(name, F.sum(col.cast("decimal(20,0)")), "sum", F.col(name).cast("decimal(38,0)").alias(name))]


def rounds(splits: int, fan_in: int = FAN_IN) -> int:
    """Rounds until one node is left; two at least, so that the first never has the whole key."""
    n, left = 0, max(2, splits)
    while left > 1:
        left, n = -(-left // fan_in), n + 1
    return max(2, n)


def tree_aggregate(
    df: DataFrame, keys: Sequence[str], states: Sequence[State], splits: int | None = None, fan_in: int = FAN_IN
) -> DataFrame:
    """One row for each key, with the final columns of `states`.

    `splits` is the number of input splits; where it is None it comes from the plan, or for a plan with a shuffle,
    whose number isn't known before it ran, from spark.sql.shuffle.partitions (a split beyond it shares a node).
    A null key is a group of its own, as in SQL. Null values are left out of sums and maxima; a key with none gets
    null. An empty input gives no rows. Columns of `df` other than those used may have any name.
    """
    spark = df.sparkSession
    if splits is None:
        splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = max(1, splits)
    node = "__node"
    at = F.pmod(F.spark_partition_id(), F.lit(splits))
    level = df.withColumn(node, F.floor(at / fan_in).cast("int")).groupBy(*keys, node).agg(*[s.first.alias(s.name) for s in states])
    for _ in range(rounds(splits, fan_in) - 1):
        level = level.withColumn(node, F.floor(F.col(node) / fan_in).cast("int"))
        level = level.groupBy(*keys, node).agg(*[getattr(F, s.merge)(s.name).alias(s.name) for s in states])
    return level.select(*keys, *[F.col(s.name) if s.final is None else s.final for s in states])


def input_splits(df: DataFrame) -> int:
    """Splits of a plan without a shuffle (asking one with a shuffle would run it)."""
    return df.rdd.getNumPartitions()
