"""What the operators of this subpackage share: word rules, tables in the shared folder, hashes."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Bytes of a table that is still broadcast.
SMALL = 48_000_000


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset, on a local master only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="sparkvoice-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables of one run in the shared folder. They cut lineage, and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            # Results may be read until the application ends; then the folder goes.
            root = self._path(self.root)
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(path)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row: int) -> DataFrame:
    """A written table, to be broadcast where its rows, of so many bytes each, take at most SMALL bytes."""
    return F.broadcast(df) if df.count() * row <= SMALL else df


def give_back() -> None:
    """Return memory that this process no longer uses, so that waiting workers leave it to others."""
    pa.default_memory_pool().release_unused()
    # Only glibc has this call.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run, rows: int = 1000):
    """run, for mapInArrow: it gets batches of at most so many rows, and gives back memory when its task ends."""

    def tidied(batches):
        try:
            yield from run(b.slice(lo, rows) for b in batches for lo in range(0, max(1, b.num_rows), rows))
        finally:
            give_back()

    return tidied


def short_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on this session's Arrow batches take about so many bytes at most. A batch stands in the JVM's buffers
    and in its worker at the same time, for every core, so long texts in the default 64 MB fill an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(key).rstrip("b"))
    if not 0 < held <= most:
        spark.conf.set(key, f"{most}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
