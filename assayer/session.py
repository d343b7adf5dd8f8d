"""Session defaults, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes up to which a source is dealt out anew for costly row work: a task's usual share.
SMALL_SOURCE = 128 << 20
#: Spark's limits of an Arrow batch, and its own limit of bytes.
BATCH_BYTES, BATCH_ROWS, BATCH_ROOM = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch", 64 << 20


def local_session(cores: int | str = "*", app: str = "assayer", **conf: str) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local master may fall back to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="assayer-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed by :func:`drop_settled`."""
    return f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there.

    Every later pass sees the same rows, also after executors are lost, and reads
    only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.option("maxRecordsPerFile", 0).parquet(path)  # a file per task, so the part number names a file
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a small source out before costly row work, which its few splits would do on few cores.

    The plan's own size estimate decides, so nothing runs for it; how far the rows
    are dealt out is left to adaptive execution. Larger sources have splits enough.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.hint("rebalance") if int(str(size)) < SMALL_SOURCE else df


@contextmanager
def batches_by_rows(spark: SparkSession, row_bytes: int) -> Iterator[None]:
    """In here, small rows are sent to Python without asking after each how large its batch has become, which costs more than the row.

    Batches stay as they are: the check is left out only where a batch of the most rows it may have stays below Spark's limit of bytes,
    and where that limit is Spark's own. Plans are made and run inside; ``row_bytes`` is for the largest row that one of them sends.
    """
    rows = int(spark.conf.get(BATCH_ROWS))
    if rows <= 0 or rows * row_bytes > BATCH_ROOM or spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it names it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on whatever file system the path names."""
    system, target = file_system(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from whatever file system the path names."""
    lines = spark.read.text(path, wholetext=True).collect()
    return lines[0][0] if lines else ""


def drop_settled(spark: SparkSession) -> None:
    """Remove this application's written tables, once nothing reads them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/settled-*")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(path) or []:
        system.delete(status.getPath(), True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A bounded table from driver values: settings, rule lists, one-row results."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [[] for _ in kind.fields]
    return spark.createDataFrame(
        pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow), schema=kind)
