"""What several corpus operators share: table access, folds, bounded samples, cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Has Arrow carry BATCH_ROWS rows at a time from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Where the session names none a folder of this machine is made and set, but only if the executors
    are threads of this process; on a cluster that is an error, for others couldn't read it.
    """
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        where = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext.getCheckpointDir()


#: The folders that each open `scratch` has to delete, the innermost last.
_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, name: str = "part", keep: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs don't repeat its work, and
    a lost executor loses nothing. What is to be kept outlives the `scratch` around it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any of Spark's file systems; one that is gone already is fine."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that `materialise` wrote and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        delete_folder(df.sparkSession, file.rpartition("/")[0])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever `materialise` has written within it, even if that failed. What a
    lazy result still reads must therefore be written outside of it or before its end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete_folder(spark, path)


_HELD: dict = {}


def trim() -> None:
    """Hands memory that this worker has freed back to the system."""
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(key, make):
    """What `make()` gives, kept in this worker under `key` until another key is asked for: the
    tasks of a step share it, and what earlier steps held in the same worker goes."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def tidy(name: str, batches: Iterator) -> Iterator:
    """The batches of a step; what other steps left in this worker goes before them, and freed
    memory after them."""
    worker_state(("step", name), dict)
    yield from batches
    trim()


def release(spark: SparkSession) -> None:
    """Has the driver drop what it no longer refers to, so that the shuffle files of finished steps
    are deleted now and don't add up over a long query."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_sample(rows: DataFrame, key: str, strata: list[str], per_stratum: int) -> DataFrame:
    """About `per_stratum` rows of each stratum at most, chosen by a hash of `key`.

    Strata are counted over all rows; a stratum of n rows keeps those whose hash lies in the
    lowest per_stratum/n of the range, so the choice doesn't depend on partitions or order.
    """
    sizes = {tuple(r[s] for s in strata): r["n"] for r in rows.groupBy(*strata).agg(F.count("*").alias("n")).collect()}
    span = 1 << 30
    at = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(span))
    keep = F.lit(False)
    for values, n in sizes.items():
        here = F.lit(True)
        for s, v in zip(strata, values, strict=True):
            here = here & F.col(s).eqNullSafe(F.lit(v))
        keep = keep | (here & (at < int(span * min(1.0, per_stratum / n))))
    return rows.filter(keep)
