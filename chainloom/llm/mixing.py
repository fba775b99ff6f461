"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a shuffled line, repeated as often as its cap allows, each pass in another order. A
document finishes at virtual time (tokens of its line up to its end) / (weight of its source). All lines are merged in the order of their finish
times and cut off where the total budget is used up. Within a line running totals are sums of bucket totals plus a short sum within a
bucket. The merged line is sorted by range over all tasks; each adds up its own range, and the totals of the ranges before it are added. So
neither a source nor the merged line is ever sorted in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.normalise import clean_name
from chainloom.session import Saved, fits, small_side

#: Documents that one bucket of a line holds on average.
BUCKET_DOCS = 20_000


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, largest) of each source of `targets`, zeros where it has no tokens.

    A source listed twice counts once, with its largest share and cap. Shares that are null or not positive, and caps that are null or below 1, take
    nothing. Documents without tokens and of sources that are not listed take no part.
    """
    wanted = targets.select(clean_name("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    wanted = wanted.where("source IS NOT NULL").groupBy("source").agg(*[F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0)).alias(c) for c in ("target_share", "max_repeats")])
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("largest"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "n_tokens", "largest")]
    return wanted.join(have, "source", "left").select("source", "target_share", "max_repeats", *zero)


#: Bits of a document's place in the shuffled line of a pass.
PLACE_BITS = 60


def _place(seed: int):
    """Where a document stands in the shuffled line of its pass: the leading bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", "doc_id", "pass", F.lit(seed)).cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("bigint")


USED = "target_share > 0 AND max_repeats > 0 AND n_tokens > 0"


def feasible(plan_rows: DataFrame) -> tuple[float, int]:
    """(virtual time, tokens) up to which every source that has documents can keep its share."""
    end = F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share")).alias("t")
    share = F.sum(F.col("target_share").cast("decimal(38,18)")).cast("double")  # the same in whatever order rows come
    t, share = plan_rows.where(USED).agg(end, share).first()
    return (t, math.floor(t * share)) if t is not None else (0.0, 0)


def _time_of(plan_rows: DataFrame, budget: int) -> float:
    """Virtual time at which the sources, some of them used up, have given `budget` tokens."""
    give = lambda t: plan_rows.where(USED).agg(F.sum(F.least(F.col("target_share") * t, F.col("n_tokens") * F.col("max_repeats")))).first()[0] or 0
    top = plan_rows.where(USED).agg(F.max(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    if give(top) <= budget:
        return top
    low, high = 0.0, top
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if give(middle) < budget else (low, middle)
    return high


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, shares) of `sizes` (doc_id, source, n_tokens), source names as clean_name gives them.

    records: (doc_id, source, pass, n_tokens, finish, end_token), in the order of end_token, the tokens up to and with the record. shares:
    one row for each source of `targets` with its target and the share reached. Without a budget the total is the largest at
    which every source that has documents keeps its share; a source without documents leaves its share to the others in
    proportion. A larger budget uses small sources up to their cap and lets the others go on. No documents or no targets: no records.
    """
    lines = Saved(plan(sizes, targets), "plan")
    plan_rows = lines.df
    time, most = feasible(plan_rows)
    if budget is not None:
        most, time = int(budget), _time_of(plan_rows, int(budget))
    slack = plan_rows.where(USED).agg(F.max(F.col("largest") / F.col("target_share")), F.max(F.col("n_docs"))).first()
    end, longest = time + (slack[0] or 0.0), slack[1] or 0
    bits = max(1, math.ceil(math.log2(max(2, longest / BUCKET_DOCS))))

    used = small_side(lines).where(USED).select("source", "target_share", F.col("n_tokens").alias("line"), F.least(F.col("max_repeats").cast("bigint"), F.ceil(F.lit(end) * F.col("target_share") / F.col("n_tokens"))).alias("passes"))
    if fits(lines):
        used = F.broadcast(used)
    docs = sizes.where("n_tokens > 0").select("doc_id", "source", "n_tokens").join(used, "source").where("passes > 0")
    docs = docs.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes"))))
    docs = docs.withColumn("h", _place(seed))
    docs = docs.withColumn("b", F.shiftright("h", PLACE_BITS - bits))

    bucket = docs.groupBy("source", "pass", "b").agg(F.sum("n_tokens").alias("s"), F.first("line").alias("line"))
    before = W.partitionBy("source", "pass").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    bucket = bucket.select(F.col("source").alias("s1"), F.col("pass").alias("p1"), F.col("b").alias("b1"), (F.coalesce(F.sum("s").over(before), F.lit(0)) + (F.col("pass") - 1) * F.col("line")).alias("offset"))
    within = W.partitionBy("source", "pass", "b").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    lined = docs.withColumn("run", F.sum("n_tokens").over(within))
    lined = lined.join(bucket, (F.col("source") == F.col("s1")) & (F.col("pass") == F.col("p1")) & (F.col("b") == F.col("b1")))
    lined = lined.withColumn("finish", (F.col("offset") + F.col("run")) / F.col("target_share")).where(F.col("finish") <= end)
    lined = Saved(lined.select("doc_id", "source", "pass", "n_tokens", "h", "finish"), "lines")

    order = ["finish", "source", "pass", "h", "doc_id", "n_tokens"]
    ranged = lined.df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.lit(0)).withColumn("run", F.lit(0).cast("bigint"))

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = total + np.cumsum(batch.column("n_tokens").to_numpy())
            total = int(sums[-1]) if len(sums) else total
            columns = dict(zip(batch.schema.names, batch.columns)) | {"part": pa.array(np.full(len(sums), part, np.int32)), "run": pa.array(sums.astype(np.int64))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in batch.schema.names], batch.schema.names)

    merged = Saved(ranged.mapInArrow(run, ranged.schema), "merged").df
    earlier = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    total = merged.groupBy("part").agg(F.max("run").alias("s")).select(F.col("part").alias("p1"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("offset"))
    total = Saved(total, "ranges")
    merged = merged.join(small_side(total), F.col("part") == F.col("p1")).withColumn("end_token", F.col("offset") + F.col("run")).where(F.col("end_token") <= most)
    records = merged.select("doc_id", "source", F.col("pass").cast("int").alias("pass"), "n_tokens", "finish", "end_token")

    taken = records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("taken"), F.max("pass").alias("passes"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "taken", "passes")]
    shares = plan_rows.join(taken, "source", "left").select("source", "target_share", "max_repeats", "n_docs", "n_tokens", *zero)
    share = F.col("taken") / F.sum("taken").over(W.partitionBy(F.lit(0)))
    shares = shares.withColumn("actual_share", F.when(F.sum("taken").over(W.partitionBy(F.lit(0))) > 0, share).otherwise(F.lit(0.0)))
    return records, shares
