"""Tables that operators write once and read several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a few numbers that are broadcast.
BROADCAST_KEYS = 1_000_000
_written: dict[str, SparkSession] = {}
_rows: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_path: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own on a
    local master; on a cluster it is an error, since executors would each write to their own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="keyfathom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bounded_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Hand Python workers at most ``limit`` bytes at once, unless the session already asks for less.

    A worker holds a batch, what is made of it and the next one, so this bounds its memory by the longest text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(now[-1], 0)
    if size <= 0 or size > limit:
        spark.conf.set(name, str(limit))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the whole plan before them. The files go with
    ``drop``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = spark
    _path[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave, once whatever reads them is written; other frames are left alone.

    Shuffle files of plans that have run go when the driver collects its garbage, so that is asked for: they would
    otherwise stay until its heap happens to be full."""
    spark = None
    for table in tables:
        path = _path.pop(table, None)
        if path is not None and (spark := _written.pop(path, None)) is not None:
            _delete(spark, path)
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def stands_for(frame: DataFrame, table: DataFrame) -> DataFrame:
    """``frame``, made from ``table`` alone, so that dropping it drops the table."""
    if table in _path:
        _path[frame] = _path.pop(table)
    return frame


def rows_of(table: DataFrame) -> int:
    """The rows of a written table, counted once."""
    if table not in _rows:
        _rows[table] = table.count()
    return _rows[table]


def small(keys: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is counted to have few rows."""
    return F.broadcast(keys) if rows_of(keys) <= BROADCAST_KEYS else keys


def fitting(keys: DataFrame, most: int, name: str) -> DataFrame:
    """``keys``, known to have at most ``most`` rows of a few numbers, to be broadcast if those are few; else written,
    counted, and broadcast if they turn out to be few."""
    return F.broadcast(keys) if most <= BROADCAST_KEYS else small(materialize(keys, name))


def drop_written() -> None:
    """Delete every table that ``materialize`` has written and that is still there."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(drop_written)
