"""Session preparation and shared-folder tables for the operators of this subpackage.

Lineage is cut by Parquet tables below the folder named in ``spark.checkpoint.dir``: all executors
can read them, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 2048
BATCH_BYTES = 2 << 20
#: For Python workers: one thread each, and freed memory goes back to the system.
WORKER_ENV = {
    "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "RAYON_NUM_THREADS": "1", "TOKENIZERS_PARALLELISM": "false",
    "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_MMAP_THRESHOLD_": "4194304",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers and bounds Arrow batches by rows and bytes."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


@contextlib.contextmanager
def bloom_filters(spark: SparkSession):
    """Within this, Spark puts Bloom filters (at most ``bloomFilter.maxNumBits``, 8 MB) before the shuffles of joins of any size."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0b", "creationSideThreshold": "1g"}
    before = {k: spark.conf.get(prefix + k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(prefix + k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(prefix + k) if v is None else spark.conf.set(prefix + k, v)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the setting is absent (tests)."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_emberlake_dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="emberlake-")
        spark.sparkContext._emberlake_dir = found
        atexit.register(shutil.rmtree, found, True)
    return found


class Scratch:
    """Named Parquet tables of one operator call in the shared folder; what a result still reads is deleted when the session's process ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.schemas: dict[str, StructType] = {}
        self.base = f"{shared_dir(spark).rstrip('/')}/emberlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.schemas[name] = df.schema
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A table as a plan of its own, so that it can be joined with itself."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.base}/{name}")

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        self.drop(*(x for x in found if x not in names))

    def drop(self, *names: str) -> None:
        """Deletes tables, and lets Spark remove the shuffle files of plans that nothing refers to any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder at the end of the process, if Spark still runs then."""
    context = spark.sparkContext
    with contextlib.suppress(Exception):  # the cluster may be gone before this process
        if context._jsc is not None:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: A key with more than this share of all rows is hot; so at most this many keys are.
HOT_SHARE = 2000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int, spread: Column, how: str = "left") -> DataFrame:
    """left joined with ``right``, whose rows tell the number ``count`` of their key's rows in left, of ``total`` in all.

    Rows of hot keys are dealt by the hash ``spread`` to as many tasks as their share asks for, and the right row is repeated
    for these. At most HOT_SHARE hot keys are broadcast; the result has the columns of left, and those of right but ``count``."""
    limit = max(1, total // HOT_SHARE)
    parts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = right.where(F.col(count) > limit).select(*on, parts.alias("_parts")).distinct()
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = F.when(F.col(count) > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    many = right.withColumn("_salt", F.explode(copies)).drop(count)
    return salted.join(many, [*on, "_salt"], how).drop("_salt")


def row_keys(docs: DataFrame, scratch: Scratch, key: str = "doc_id") -> tuple[DataFrame, bool]:
    """docs with a ``row`` that no other row has: the key itself where it is unique and never null (True), else a number
    given in a written copy (False)."""
    if not docs.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 or {key} is null").take(1):
        return docs.withColumn("row", F.col(key)), True
    return scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "rows"), False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id written as text, modulo k."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)
