"""Tables, the shared folder and lineage cuts.

Everything that must outlive an executor goes to the folder the cluster names
in ``spark.checkpoint.dir``; only a local session without that setting gets a
folder of its own.

What is written there has an owner: ``scratch`` deletes what was made inside it,
and what has no other owner is deleted when the driver's process ends. A query
returns a plan that still reads such folders, so its result is to be written
inside a ``scratch`` if they should go at once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders made so far, with the file systems that delete them, by owner; the last owner is the present one.
_OWNED: list[list[tuple]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, whatever file system that is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    kept = context.getCheckpointDir()
    if kept:
        return kept.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


def _delete(owned: list[tuple]) -> None:
    for store, path in owned:
        store.delete(path, True)
    owned.clear()


def _delete_rest() -> None:
    try:
        for owned in _OWNED:
            _delete(owned)
    except Exception:  # noqa: BLE001 - the process ends and Spark may be gone before it
        pass


atexit.register(_delete_rest)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted with its owner."""
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    _OWNED[-1].append(_file_system(spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Own the folders made inside, and delete them at its end."""
    _OWNED.append([])
    try:
        yield
    finally:
        _delete(_OWNED.pop())


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written and read back; the folders made on the way are deleted."""
    path = fresh_dir(spark, label)
    with scratch():
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy is replicated by the file system, so that a lost executor costs a
    re-read and never a recomputation; unlike ``checkpoint()`` the plan below
    runs once, and the files are columnar and compressed.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


class Levels:
    """Rounds of a search, each written to a folder of its own below one that is read as a whole.

    However many rounds there are, reading them all is one scan, whose partition column is ``level``.
    """

    def __init__(self, spark: SparkSession, label: str, schema: str):
        self.spark, self.schema, self.path, self.n = spark, schema, fresh_dir(spark, label), 0

    def append(self, rows: DataFrame) -> DataFrame:
        """Write the next round; its rows as they can be read again."""
        at = f"{self.path}/level={self.n}"
        rows.write.parquet(at)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        """The rows of all rounds, with ``level``."""
        return self.spark.read.schema(f"{self.schema}, level int").parquet(self.path)


def write_numbered(rows: DataFrame, path: str, *order: str) -> None:
    """Write ``rows`` in the given order, which must leave no ties, for ``read_numbered``.

    Rows are dealt out once, to ranges of the order, so that no task sees all of them. Each is written with its
    range and its place there; how many rows are before each range is a small table beside them.
    """
    spark = rows.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism * 4)
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.withColumn("_place", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/rows").groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most n rows
    sizes.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")).write.parquet(f"{path}/ranges")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_numbered`` with ``number``, from 0."""
    ranges = spark.read.schema("_range long, _before long").parquet(f"{path}/ranges")
    rows = spark.read.parquet(f"{path}/rows")
    kept = [c for c in rows.columns if c != "_place"]
    rows = rows.join(F.broadcast(ranges), F.shiftright("_place", 33) == F.col("_range"))
    return rows.select(*kept, (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``number``, from 0 in the given order, which must leave no ties."""
    path = fresh_dir(rows.sparkSession, "numbered")
    write_numbered(rows, path, *order)
    return read_numbered(rows.sparkSession, path)


@contextmanager
def planned_once(spark: SparkSession) -> Iterator[None]:
    """Run what is executed inside as it was planned, a query to a job.

    Adaptive execution makes a job of each shuffle and plans again after it, which is most of the
    time when tables have a few thousand rows and many joins. Only for tables counted to be small.
    """
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(1, min(8, spark.sparkContext.defaultParallelism)))}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, through Hadoop's file system."""
    store, at = _file_system(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    store, at = _file_system(spark, path)
    store.delete(at, True)
