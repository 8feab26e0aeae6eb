"""What the operators share: table access and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship_package

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(df: DataFrame) -> None:
    """Before Python runs on rows of whole texts: the package on the executors, and Arrow batches that are small in rows and in bytes."""
    spark = ship_package(df.sparkSession)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a temporary one, but only if all executors are threads of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(spark, path)
            _written[:] = [w for w in _written if not path.endswith(w[1].rsplit("/", 1)[-1])]


def mark() -> int:
    """For ``release_since``: what is written from here on."""
    return len(_written)


def release_since(at: int, *keep: DataFrame) -> None:
    """Delete the tables written since ``mark`` gave ``at``, but for ``keep``."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
    for spark, path in _written[at:]:
        if path.rsplit("/", 1)[-1] not in kept:
            remove(spark, path)
    _written[at:] = [w for w in _written[at:] if w[1].rsplit("/", 1)[-1] in kept]


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as make it differ from ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def with_hot_keys(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 1000, least: int = 1000) -> DataFrame:
    """``left`` joined with ``right`` (one row a key) on ``key``; keys that hold a ``share``-th of the left rows don't go through the shuffle.

    At most ``share`` keys can be that frequent, so their rows of ``right`` are a broadcast of known size. ``how``
    is inner or left. The answer is that of the plain join.
    """
    if not left.inputFiles():
        return left.join(right, key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    n = left.count()
    hot = [r[0] for r in counts.where(F.col("_n") > max(least, n // share)).select(key).collect()]  # at most ``share`` of them
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    frequent = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return frequent.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def trim_memory() -> None:
    """Give back what a Python worker holds after a large batch: it is used again for later stages."""
    pa = __import__("pyarrow")
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended, and with it the folder's owner
            return
