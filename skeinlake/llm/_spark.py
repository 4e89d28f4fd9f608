"""Spark helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows in an Arrow batch: they are whole documents, and both ends hold a batch at a time.
BATCH_ROWS = 1000


def by_documents(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand Python at most BATCH_ROWS rows at a time."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back the memory it has freed: workers of earlier stages stay beside those of later ones."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, which all machines share: ``spark.checkpoint.dir``.

    Where the session names none, as in tests, it is a folder in the warehouse;
    a session on a cluster has to name one.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder; it isn't made yet."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, without lineage."""
    folder = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder, without lineage."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    _collected(spark)  # what was shuffled for it is unreferenced now, and is dropped once the driver sees that
    return out


def _collected(spark: SparkSession) -> None:
    """Both sides of the driver collect their garbage: Spark drops shuffles that neither refers to."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a narrow table, of ids and hashes, that are worth a task.
TASK_ROWS = 1 << 16


def few(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table in as many partitions as its ``rows`` ask for: each exchange writes files, and each task its record, however few rows there are."""
    return df.coalesce(-(-max(rows, 1) // TASK_ROWS))


def release(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete the files of ``saved`` tables that nothing reads any more.

    Shuffles that no table refers to are dropped as well, once the driver has
    collected its garbage; ``shuffles`` asks for that now.
    """
    for df in tables:
        spark = df.sparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if shuffles and tables:
        _collected(tables[0].sparkSession)
