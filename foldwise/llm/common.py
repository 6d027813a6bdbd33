"""What the operators of this subpackage share: shared folders, written tables, text constants."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: A word, as Java, Python and RE2 read it.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of its own, which goes with the process;
    a cluster without the setting is refused, for a machine-local folder can't be read elsewhere.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="foldwise-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


_marked: set[str] = set()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/foldwise-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table of the shared folder: cuts the lineage, survives lost executors and has
    a size that the planner knows."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Workers of this session get their rows in Arrow batches of about `most` bytes, where no bound is set: each
    running task holds its batch in the JVM and again in the worker, and Spark's own bound is 64 MB of 10000 rows.
    It stays set, for plans run later. A longer row is a batch of its own; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, most)


@functools.cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to give large blocks back as soon as they are freed."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, else it grows with what is freed
        libc.malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return None
    return libc


def trimmed(run: Callable) -> Callable:
    """A worker's generator that gives freed memory back to the system after each batch and at its end:
    workers live on between tasks, and what their allocators keep counts against the executor."""

    @functools.wraps(run)
    def wrapped(batches):
        import pyarrow

        pyarrow.set_memory_pool(pyarrow.system_memory_pool())
        for out in run(batches):
            yield out
            del out
            if libc := _libc():
                libc.malloc_trim(0)
        if libc := _libc():
            libc.malloc_trim(0)

    return wrapped
