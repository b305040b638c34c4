"""What the corpus operators share: scratch tables, session limits, column checks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(name := f"{tempfile.mkdtemp(prefix='cairn-code-')}/{root.name}_code.zip", "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of whole texts has to fit beside the JVM in an executor."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in a local session without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.cairn.scratch", made := spark.conf.get("spark.cairn.scratch", None) or f"file://{tempfile.mkdtemp(prefix='cairn-')}")
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


class Scratch:
    """Written tables that cut lineage. They live in the shared folder until the driver's Python ends,
    because the frame an operator returns still reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more, and lets Spark delete the shuffle files of finished steps,
        which it does when the driver collects its garbage."""
        for name in names:
            _remove(self.spark, f"{self.path}/{name}")
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def lean(work):
    """A function of batches that gives memory back to the system when its task ends. Workers are used again, and would
    keep what their largest task took."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def need(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def new_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def ascii_lower(column):
    """Lower-cases A-Z alone, natively. Texts without other letters take the fast path of lower()."""
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))


def crc_bucket(column, buckets: int):
    """crc32 of an id as text, modulo the number of folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)
