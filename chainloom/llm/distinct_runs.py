"""Distinct counts over huge identifier sets, from mergeable partial results.

The state of a group is its set of 64-bit hashes, kept as sorted runs: within a bucket of the hash range the hashes are
sorted, and their differences stored as variable-length integers. States merge by a k-way union of their runs; a state is a table, which can be
saved and loaded. States of unlike size have unlike numbers of buckets; before they merge, the coarser ones are cut to the buckets of the finest. The
only error is that different identifiers may share a hash: of n identifiers at most n * (n - 1) / 2 ** 65 are expected to be lost.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.session import Saved

#: Hashes that one bucket holds on average; a bucket is what one task merges.
BUCKET_HASHES = 250_000
#: Longest run.
RUN = 65_536


def encode_runs(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of runs of sorted int64, and the end of each run in them. `starts` are the runs' first positions."""
    delta = np.diff(hashes.view(np.uint64), prepend=np.uint64(0))
    delta[starts] = hashes.view(np.uint64)[starts]
    size = np.ones(len(delta), np.int64)
    for k in range(1, 10):
        size += delta >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    for k in range(10):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        part = (delta[some] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        out[at[some] + k] = part | ((size[some] > k + 1) * np.uint8(0x80)).astype(np.uint8)
    return out, ends[np.append(starts[1:], len(hashes)) - 1] if len(starts) else ends[:0]


def decode_runs(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes of concatenated runs with `counts` hashes each."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 0x80)
    first = np.append(0, last[:-1] + 1)
    size = last - first + 1
    delta = np.zeros(len(last), np.uint64)
    for k in range(10):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        delta[some] |= (data[first[some] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    total = np.cumsum(delta)  # wraps around, as it should
    starts = np.cumsum(counts) - counts
    starts = starts[counts > 0]
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return (total - np.repeat(before, counts[counts > 0])).view(np.int64)


def _states(groups: dict[str, pa.Array], bits: int, bucket: np.ndarray, hashes: np.ndarray, schema) -> pa.RecordBatch:
    """State rows of hashes sorted within their groups and buckets; a run ends where a group or bucket does and after RUN hashes."""
    new = np.zeros(len(hashes), bool)
    new[::RUN] = True
    new[1:] |= bucket[1:] != bucket[:-1]
    for column in groups.values():
        c = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    data, ends = encode_runs(hashes, starts)
    offsets = np.append(0, ends).astype(np.int32)
    run = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    columns = {k: v.take(pa.array(starts)) for k, v in groups.items()}
    columns["bits"] = pa.array(np.full(len(starts), bits, np.int32))
    columns["bucket"] = pa.array(bucket[starts].astype(np.int32))
    columns["n"] = pa.array(np.diff(np.append(starts, len(hashes))).astype(np.int32))
    columns["run"] = run
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], [f.name for f in schema])


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, one value behind the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def run_states(df: DataFrame, dims: Sequence[str], identifier: str) -> DataFrame:
    """The partial results, a written table: (dims..., bits, bucket, n, run) for the distinct non-null identifiers of each group.

    Null dims are groups of their own. An empty input gives no rows. The number of buckets (2 ** bits) follows the counted size of the
    state, so that a bucket stays within a task's memory at any size.
    """
    hashed = df.where(F.col(identifier).isNotNull()).select(*dims, F.xxhash64(identifier).alias("__h")).distinct()
    saved = Saved(hashed, "hashes")
    bits = max(1, int(np.ceil(np.log2(max(2, saved.count() / BUCKET_HASHES)))))
    rows = saved.df.withColumn("bucket", F.shiftright("__h", 64 - bits).cast("int"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", *dims, "__h")
    schema = saved.df.select(*dims, F.lit(bits).alias("bits"), F.lit(0).alias("bucket"), F.lit(0).alias("n"), F.lit(b"").alias("run")).schema

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                columns = {d: batch.column(d) for d in dims}
                yield _states(columns, bits, batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("__h").to_numpy(zero_copy_only=False), schema)

    return Saved(rows.mapInArrow(encode, schema), "states").df


def save_states(state: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a state as Parquet, to be merged later with those of other days or sources."""
    state.write.mode(mode).option("compression", "zstd").parquet(path)


def load_states(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of saved states, columns by name."""
    states = [spark.read.parquet(p) for p in paths]
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole


def refined(state: DataFrame) -> DataFrame:
    """The state with the buckets of its finest part: runs of coarser parts are decoded and cut at the borders of those buckets.

    Within a run hashes are sorted, so that each stays sorted in its new bucket. Buckets never become coarser, so a small state that is united with
    a large one doesn't fill the memory of a task.
    """
    least, most = state.agg(F.min("bits"), F.max("bits")).first()
    if least == most:
        return state
    schema = state.schema
    dims = [f.name for f in schema if f.name not in ("bits", "bucket", "n", "run")]

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # 64 runs of RUN hashes at most at a time
                part = batch.slice(i, 64)
                counts = part.column("n").to_numpy().astype(np.int64)
                hashes = decode_runs(_bytes(part.column("run")), counts)
                row = np.repeat(np.arange(part.num_rows), counts)
                groups = {d: part.column(d).take(pa.array(row)) for d in dims} | {"__row": pa.array(row)}
                made = _states(groups, most, hashes >> np.int64(64 - most), hashes, [*schema, type("Row", (), {"name": "__row"})])
                yield made.select([f.name for f in schema])

    coarse = state.where(F.col("bits") < most).mapInArrow(cut, schema)
    return state.where(F.col("bits") == most).unionByName(coarse)


def kway_union(runs: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct values of sorted runs. The stable sort finds the runs and merges them pairwise, without sorting within them."""
    if len(runs) == 1:
        return runs[0]
    merged = np.concatenate(runs)
    merged.sort(kind="stable")
    return merged[np.append(True, merged[1:] != merged[:-1])] if len(merged) else merged


def merge_counts(state: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Distinct counts of every group of every set of dims, by union of the runs of `state`.

    `state` may unite states of several days or sources, whatever their numbers of buckets. A dim outside of the
    set is null and its flag `<dim>_all` is 1, which tells it from a dim that is null in the data. `collision_bound` is
    the expected number of identifiers lost to equal hashes at most. A bucket is merged in one task: first the runs of each finest
    group, then those unions into the coarser groups, each from the smallest finer set that has its dims.
    """
    out = [f for f in state.schema if f.name in dims]
    flags = ", ".join(f"`{d}_all` int" for d in dims)
    names = {f.name: f.dataType.simpleString() for f in out}
    schema = ", ".join(f"`{d}` {names[d]}" for d in dims) + f", {flags}, n_distinct bigint"
    order = sorted({tuple(d for d in dims if d in s) for s in sets}, key=len, reverse=True)

    def union(tbl: pa.Table) -> pa.Table:
        tbl = tbl.combine_chunks()
        counts = tbl.column("n").to_numpy().astype(np.int64)
        hashes = decode_runs(_bytes(tbl.column("run").combine_chunks()), counts)
        ends = np.cumsum(counts)
        runs = [hashes[b - n : b] for b, n in zip(ends.tolist(), counts.tolist())]
        values, codes = {}, []
        for d in dims:
            enc = tbl.column(d).combine_chunks().dictionary_encode(null_encoding="encode")
            values[d] = enc.dictionary
            codes.append(enc.indices.to_numpy(zero_copy_only=False).tolist())
        made: dict[tuple, dict[tuple, np.ndarray]] = {}
        rows = dict(enumerate(zip(*codes))) if dims else dict.fromkeys(range(len(runs)), ())
        parts: dict[tuple, list[np.ndarray]] = {}
        for k, key in rows.items():
            parts.setdefault(key, []).append(runs[k])
        made[tuple(dims)] = {key: kway_union(v) for key, v in parts.items()}
        columns: dict[str, list] = {d: [] for d in dims}
        flag: dict[str, list[int]] = {d: [] for d in dims}
        total: list[int] = []
        for chosen in order:
            if chosen not in made:
                finer = min((s for s in made if set(chosen) <= set(s)), key=lambda s: (sum(map(len, made[s].values())), len(s)))
                at = [finer.index(d) for d in chosen]
                parts = {}
                for key, v in made[finer].items():
                    parts.setdefault(tuple(key[i] for i in at), []).append(v)
                made[chosen] = {key: kway_union(v) for key, v in parts.items()}
            for key, v in made[chosen].items():
                codes_of = dict(zip(chosen, key))
                for d in dims:
                    columns[d].append(codes_of.get(d))
                    flag[d].append(int(d not in codes_of))
                total.append(len(v))
        arrays = [values[d].take(pa.array(columns[d], pa.int32())) for d in dims] + [pa.array(flag[d], pa.int32()) for d in dims]
        return pa.table([*arrays, pa.array(total, pa.int64())], names=[*dims, *[f"{d}_all" for d in dims], "n_distinct"])

    counted = refined(state).groupBy("bucket").applyInArrow(union, schema)
    keys = [*dims, *[f"{d}_all" for d in dims]]
    total = counted.groupBy(*keys).agg(F.sum("n_distinct").alias("n_distinct"))
    n = F.col("n_distinct").cast("double")
    return total.withColumn("collision_bound", n * (n - 1) / F.lit(2.0**65))
