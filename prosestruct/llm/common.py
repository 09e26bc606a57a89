"""What several operators share: row-wise Arrow maps, checkpoints and stable hashes."""

from __future__ import annotations

import ctypes
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of one Arrow batch. Both bound what a Python worker holds at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20

#: The white space of the word pattern `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"

#: Java pattern for words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema. Arrow batches of the session are bounded from here on; smaller settings stay."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = df.sparkSession.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(key, str(most))
    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


def give_back() -> None:
    """Return freed memory to the system. Python workers live on between tasks, also idle, and their pools keep what a task once held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict], dict]], ddl: str) -> DataFrame:
    """Map batches of `df`, given as dicts of Arrow columns, to dicts of columns.

    `make` runs once in each task and returns the function for a batch, so that caches live as long as a task.
    """
    schema = arrow_schema(df, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            work = make()
            for batch in batches:
                yield to_batch(work(dict(zip(batch.schema.names, batch.columns, strict=True))), schema)
        finally:
            work = batch = None
            give_back()

    return df.mapInArrow(run, ddl)


def scratch_folder(spark) -> str:
    """The application's folder under spark.checkpoint.dir, which driver and executors share; deleted when the driver ends.

    Without that setting a temporary folder is used, but only where the executors are threads of the driver.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "prosestruct-checkpoints")
    folder = f"{top.rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written once into the scratch folder; a reliable checkpoint would compute df twice."""
    spark = df.sparkSession
    folder = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def hash64(data: bytes) -> int:
    """Signed 64-bit hash, the same in every process."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
