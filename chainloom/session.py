"""Session construction and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is hinted as a broadcast side only if its rows, as Spark keeps them in memory, were counted to take at most this many bytes.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "chainloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # call sites of every column cost more than building the plan
        "spark.sql.python.filterPushdown.enabled": "true",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir where it is set.

    Only a local session without that setting, such as one of the tests, gets a folder of its own. On a cluster a folder of one machine
    would not be seen by the others, so there its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="chainloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete_on_exit(spark: SparkSession, where: str) -> None:
    """Deletes a folder when the driver ends."""
    fs, path = _path(spark, where)
    fs.deleteOnExit(path)


class Saved:
    """A table written once in the shared folder; reading it never recomputes its lineage.

    The files outlive any executor. They go when drop() is called or the driver ends.
    """

    def __init__(self, df: DataFrame, name: str, partitions: int | None = None):
        self.spark = df.sparkSession
        self.where = f"{shared_dir(self.spark)}/chainloom/{name}-{uuid.uuid4().hex}"
        if partitions:
            df = df.coalesce(partitions)
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.where)
        delete_on_exit(self.spark, self.where)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.where)

    def count(self) -> int:
        """Row count from the Parquet footers."""
        return self.df.count()

    def drop(self) -> None:
        fs, path = _path(self.spark, self.where)
        fs.delete(path, True)


#: Bytes of a row beside its fields, and of a field of fixed width or the pointer of another, in a broadcast hash table.
ROW_BYTES, FIELD_BYTES = 48, 8


def fits(saved: Saved, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a saved table take at most `limit` bytes in memory.

    The rows are counted from the file footers; only if their fixed part fits are the lengths of texts and bytes added up.
    """
    df = saved.df
    fields = sum(3 * FIELD_BYTES if kind.startswith("decimal") else FIELD_BYTES for _, kind in df.dtypes)
    fixed = saved.count() * (ROW_BYTES + fields)
    if fixed > limit:
        return False
    wide = [F.sum(F.octet_length(c) + FIELD_BYTES) for c, kind in df.dtypes if kind in ("string", "binary")]
    if any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes):
        return False
    if wide:
        fixed += sum(x or 0 for x in df.agg(*wide).first())
    return fixed <= limit


def small_side(saved: Saved, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The saved table, as a broadcast side if it fits within `limit` bytes.

    Beyond it the table comes back without a hint, so that Catalyst shuffles the join. The rows of the result are the same.
    """
    return F.broadcast(saved.df) if fits(saved, limit) else saved.df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
