"""Block files as a Spark source.

    spark.dataSource.register(BlockFiles)
    spark.read.format("blkdat").option("coin", "bitcoin").option("start", 0).option("end", 1000).load("/data/blocks")

Files are blkNNNNN.dat with an optional xor.dat beside them. With `index`, a folder of the block index (LevelDB tables, or Parquet of key
and value), the blocks are those of the index in the range, with their heights. Without, files are read from frame to frame and the height is null;
operators.heights.with_heights derives it. A task reads one run of offsets of one file.

As a stream (spark.readStream.format("blkdat"), with an index) the source gives the blocks of the heights that the index has gained since the last batch.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from chainloom.coins import coin as coin_of
from chainloom.functions.codec import read_block, read_index_record, unxor
from chainloom.sources.schema import BLOCK

NAME = re.compile(r"^blk(\d+)\.dat$")
HAVE_DATA, VALID_CHAIN = 8, 4
#: Bytes of a file that one task reads where no index tells the blocks.
SPLIT = 128 << 20


def file_index(name: str) -> int | None:
    """Number of a block file's name, with or without leading zeros; None for other names."""
    m = NAME.match(name)
    return int(m[1]) if m else None


def block_files(folder: str) -> dict[int, str]:
    """Number to path of the block files of a folder, links resolved. No such file: FileNotFoundError."""
    found = {}
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        path = os.path.realpath(entry.path)
        number = file_index(os.path.basename(path))
        if number is None:
            number = file_index(entry.name)
        if number is not None and os.path.isfile(path):
            found[number] = path
    if not found:
        raise FileNotFoundError(f"no blk*.dat file in {folder}")
    return found


def xor_key(folder: str) -> bytes | None:
    """Bytes of xor.dat; None without the file or if it is empty."""
    path = os.path.join(folder, "xor.dat")
    if not os.path.isfile(path):
        return None
    with open(path, "rb") as f:
        return f.read() or None


def index_pairs(folder: str) -> Iterator[tuple[bytes, bytes]]:
    """(key, value) of a block index in key order: LevelDB tables, or Parquet files with columns key and value."""
    if any(n.endswith((".ldb", ".sst", ".log")) for n in os.listdir(folder)):
        from chainloom.sources.leveldb import pairs

        yield from pairs(folder)
        return
    import pyarrow.dataset as ds

    t = ds.dataset(folder, format="parquet").to_table(columns=["key", "value"]).sort_by("key")
    yield from zip(t.column("key").to_pylist(), t.column("value").to_pylist())


def index_records(folder: str) -> dict[int, dict]:
    """Height to record of the blocks whose data are at hand; of several at a height the last in key order."""
    out = {}
    for key, value in index_pairs(folder):
        if key[:1] == b"b":
            r = read_index_record(key, value)
            if r["status"] & (HAVE_DATA | VALID_CHAIN):
                out[r["height"]] = r
    if not out:
        raise ValueError(f"no usable block record in the index {folder}")
    return out


def selected(records: dict[int, dict], start: int, end: int | None) -> list[dict]:
    """The records from `start` to `end` inclusive, ending before the first missing height."""
    last = max(records) if end is None else min(end, max(records))
    out = []
    for h in range(start, last + 1):
        if h not in records:
            break
        out.append(records[h])
    return out


@dataclass
class Run(InputPartition):
    """Blocks of one file: (height, offset of the block) each, or the frames that begin in [first, last)."""

    path: str
    key: bytes | None
    blocks: list[tuple[int, int]] | None
    first: int = 0
    last: int = 0


class _File:
    """Plain bytes of a file that may be XORed; opened when its run is read and closed behind it."""

    def __init__(self, run: Run):
        self.path, self.key = run.path, run.key

    def __enter__(self):
        self.f = open(self.path, "rb")  # noqa: SIM115
        return self

    def __exit__(self, *_):
        self.f.close()

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return unxor(self.f.read(n), self.key, at)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict, schema=None):
        self.schema = schema
        self.folder = options.get("path") or ""
        self.coin = coin_of(options.get("coin", "bitcoin"))
        if not self.folder:
            self.folder = os.path.join(os.path.expanduser("~"), self.coin.folder)
        self.index = options.get("index")
        self.start = int(options.get("start", 0))
        self.end = int(options["end"]) if options.get("end") not in (None, "") else None
        if self.end is not None and self.start > self.end:
            raise ValueError(f"the range of heights {self.start}..{self.end} is empty")
        self.per_task = int(options.get("blocksPerTask", 2000))

    def pushFilters(self, filters):
        """Takes comparisons of height with a number into the range; others stay with Spark."""
        for f in filters:
            whole = getattr(f, "attribute", None) == ("height",) and isinstance(getattr(f, "value", None), int)
            low = {GreaterThan: 1, GreaterThanOrEqual: 0, EqualTo: 0}.get(type(f)) if whole and self.index else None
            high = {LessThan: -1, LessThanOrEqual: 0, EqualTo: 0}.get(type(f)) if whole and self.index else None
            if low is not None:
                self.start = max(self.start, f.value + low)
            if high is not None:
                self.end = f.value + high if self.end is None else min(self.end, f.value + high)
            if low is None and high is None:
                yield f

    def partitions(self) -> list[Run]:
        files, key = block_files(self.folder), xor_key(self.folder)
        if not self.index:
            return [Run(p, key, None, a, a + SPLIT) for p in files.values() for a in range(0, max(1, os.path.getsize(p)), SPLIT)]
        by_file: dict[int, list[tuple[int, int]]] = {}
        for r in selected(index_records(self.index), self.start, self.end):
            by_file.setdefault(r["blk_index"], []).append((r["height"], r["data_offset"]))
        missing = sorted(set(by_file) - set(files))
        if missing:
            raise FileNotFoundError(f"the index names block files {missing[:5]} that are not in {self.folder}")
        out = []
        for number, blocks in sorted(by_file.items()):
            blocks.sort(key=lambda b: b[1])
            out += [Run(files[number], key, blocks[i : i + self.per_task]) for i in range(0, len(blocks), self.per_task)]
        return out or [Run(next(iter(files.values())), key, [])]

    def read(self, partition: Run):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        rows = []
        for height, raw in self._raw(partition):
            rows.append(read_block(raw, self.coin) | {"height": height})
            if len(rows) == 64:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _raw(self, run: Run):
        with _File(run) as file:
            if run.blocks is None:
                yield from self._frames(file, run)
                return
            for height, at in run.blocks:
                yield height, file.read(at, int.from_bytes(file.read(at - 4, 4), "little"))

    def _frames(self, file: _File, run: Run):
        """The blocks of the frames that begin in the run.

        Frames are followed by their sizes from the start of the file, reading eight bytes of each, so that the magic bytes of a network
        within a block are never taken for a frame.
        """
        magic, size = self.coin.magic.to_bytes(4, "little"), os.path.getsize(run.path)
        at = self._frame(file, magic, 0, size)
        while at is not None and at < run.last:
            n = int.from_bytes(file.read(at + 4, 4), "little")
            if at + 8 + n > size:
                return  # the node has not written the whole block yet
            if at >= run.first:
                yield None, file.read(at + 8, n)
            at = self._frame(file, magic, at + 8 + n, size)

    @staticmethod
    def _frame(file: _File, magic: bytes, at: int, size: int) -> int | None:
        """Position of the next frame from `at` on; fill bytes between frames are passed over."""
        length = 8  # nearly always the next frame follows at once
        while at + 8 <= size:
            chunk = file.read(at, length)
            k = chunk.find(magic)
            if k >= 0:
                return at + k
            at += max(1, len(chunk) - 3)
            length = 1 << 20
        return None


class BlockStream(DataSourceStreamReader):
    """New blocks of a growing index; an offset is the first height that was not read yet.

    A height is read once, so a replaced block behind the tip is not seen; begin some heights below the tip where that matters.
    """

    def __init__(self, options: dict, schema=None):
        if not options.get("index"):
            raise ValueError("a stream of blocks needs an index")
        self.options, self.schema = dict(options), schema
        self.first = int(options.get("start", 0))

    def _reader(self, start: int, end: int | None) -> BlockReader:
        reader = BlockReader(self.options, self.schema)
        reader.start, reader.end = start, end
        return reader

    def initialOffset(self) -> dict:
        return {"height": self.first}

    def latestOffset(self) -> dict:
        found = selected(index_records(self.options["index"]), self.first, None)
        return {"height": max(self.first, found[-1]["height"] + 1 if found else 0)}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        if start["height"] >= end["height"]:
            return []
        return self._reader(start["height"], end["height"] - 1).partitions()

    def read(self, partition: Run):
        return self._reader(0, None).read(partition)


class UnfilteredBlockReader(BlockReader):
    """For sessions without spark.sql.python.filterPushdown.enabled, which refuse readers with pushFilters."""

    pushFilters = DataSourceReader.pushFilters


class BlockFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blkdat"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        plain = self.options.get("pushdown", "true" if spark is None else spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
        return (BlockReader if plain == "true" else UnfilteredBlockReader)(self.options, schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BlockStream(self.options, schema)
