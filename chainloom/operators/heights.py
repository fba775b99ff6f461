"""Heights: selecting ranges, stopping at gaps, and deriving heights from the links between blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.session import Saved
from chainloom.sources.blkdat import HAVE_DATA, VALID_CHAIN


def check_range(start: int, end: int | None) -> tuple[int, int | None]:
    """The range of heights; ValueError for a negative start or an end before it. A single height is allowed."""
    if start < 0 or (end is not None and end < start):
        raise ValueError(f"the range of heights {start}..{'HEAD' if end is None else end} is empty")
    return start, end


def show_range(start: int = 0, end: int | None = None) -> str:
    return f"{start}..{'HEAD' if end is None else end}"


def in_range(df: DataFrame, start: int = 0, end: int | None = None, half_open: bool = False) -> DataFrame:
    """Rows with heights from `start` to `end` inclusive, or without the end and the tip if `half_open`."""
    keep = F.col("height") >= start
    if half_open:
        tip = df.agg(F.max("height")).first()[0]
        last = tip if end is None else min(end, tip) if tip is not None else None
        return df.where(keep & (F.col("height") < last)) if last is not None else df.where(F.lit(False))
    return df.where(keep if end is None else keep & (F.col("height") <= end))


def until_gap(blocks: DataFrame, start: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Blocks from `start` on up to the first missing height, for each group of `by`.

    Several blocks of a height count as one. The last height is the lowest whose successor is missing; a group without a block at `start` has none.
    """
    group = [*by, "__all"]
    heights = blocks.where(F.col("height") >= start).select(*by, F.lit(0).alias("__all"), "height").distinct()
    below = heights.withColumn("height", F.col("height") - 1)
    ends = heights.join(below, [*group, "height"], "left_anti").groupBy(*group).agg(F.min("height").alias("__last"))
    ends = ends.join(heights.where(F.col("height") == start).select(*group), group, "left_semi")
    reach = blocks.withColumn("__all", F.lit(0)).join(ends, group).where((F.col("height") >= start) & (F.col("height") <= F.col("__last")))
    return reach.select(*[F.col(c) for c in blocks.columns])


def usable(index: DataFrame) -> DataFrame:
    """Index records whose status has either the data bit or the valid-chain bit."""
    return index.where(F.col("status").bitwiseAND(F.lit(HAVE_DATA | VALID_CHAIN)) > 0)


def last_by_height(index: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """One record for each height: that with the largest key."""
    whole = F.max_by(F.struct(*index.columns), F.col(key)).alias("r")
    return index.groupBy(*by, "height").agg(whole).select("r.*")


def max_height_by_file(index: DataFrame) -> DataFrame:
    return index.groupBy("blk_index").agg(F.max("height").alias("max_height"))


def _jumps(blocks: DataFrame, by: Sequence[str], max_rounds: int) -> list[Saved]:
    """After r rounds each block b points 2 ** r blocks down: (by..., b, to, n, low), `to` null where that is before the first block of its line.

    n counts the blocks passed and low is the lowest of them, at last the first block of the line.
    """
    own = blocks.select(*by, "block_hash", "hash_prev").distinct()
    known = own.select(F.col("block_hash").alias("hash_prev"), F.lit(True).alias("known"))
    to = F.when(F.col("known"), F.col("hash_prev"))
    jump = own.join(known, "hash_prev", "left").select(
        *by, F.col("block_hash").alias("b"), to.alias("to"), F.when(F.col("known"), 1).otherwise(0).cast("bigint").alias("n"), F.coalesce(to, "block_hash").alias("low")
    )
    jumps = [Saved(jump, "jump")]
    while jumps[-1].df.where("to IS NOT NULL").limit(1).count():
        if len(jumps) > max_rounds:
            raise ValueError("the links between blocks form a circle")
        here = jumps[-1].df
        far = here.select(F.col("b").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("low").alias("low2"))
        step = here.join(far, "to", "left").select(*by, "b", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce("low2", "low").alias("low"))
        jumps.append(Saved(step, "jump"))
    return jumps


def with_heights(blocks: DataFrame, by: Sequence[str] = (), max_rounds: int = 40) -> DataFrame:
    """The blocks of the longest chain, for each group of `by`, with their heights from the links alone.

    Every block points at its predecessor; by doubling, each round makes it point twice as far, until all point before the
    first block, so 2 ** rounds blocks take that many rounds. Of equally high tips that with the smallest hash counts. Blocks off its line are left out,
    and the height column is replaced. No blocks give none. lines() keeps all blocks.
    """
    jumps = _jumps(blocks, by, max_rounds)
    heights = jumps[-1].df.select(*by, F.col("b").alias("block_hash"), F.col("n").alias("height"))
    top = heights.groupBy(*by).agg(F.max("height").alias("height"))
    line = heights.join(top, [*by, "height"]).groupBy(*by).agg(F.min("block_hash").alias("b")).select("b")
    for saved in jumps[:-1]:
        reach = line.join(saved.df, "b").where("to IS NOT NULL").select(F.col("to").alias("b"))
        line = Saved(line.unionByName(reach).distinct(), "line").df
    found = line.withColumnRenamed("b", "block_hash").join(heights.select("block_hash", "height"), "block_hash")
    return blocks.drop("height").join(found, "block_hash")


def lines(blocks: DataFrame, by: Sequence[str] = (), max_rounds: int = 40) -> DataFrame:
    """(by..., block_hash, base, above) of every block: the first block of its unbroken line, and how many blocks above that it stands.

    A line begins at each block whose predecessor isn't there, so blocks behind a missing one have a line of their own.
    """
    last = _jumps(blocks, by, max_rounds)[-1].df
    return last.select(*by, F.col("b").alias("block_hash"), F.col("low").alias("base"), F.col("n").alias("above"))


def linked(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each block beside the hash of the block one height below: a self-join on height, without a global sort."""
    below = blocks.select(*[F.col(c).alias(c) for c in by], (F.col("height") + 1).alias("height"), F.col("block_hash").alias("hash_below"), F.col("n_time").alias("time_below"))
    return blocks.join(below, [*by, "height"], "left")


