"""A map that is built once and queried many times, and built anew beside its readers.

``publish`` writes nodes and edges as Parquet, the edges partitioned by kind,
so that a query over imports never reads calls. Each call writes a version of its own
below ``versions/`` and then makes it the map by renaming an empty file to
``current/<number>-<version>``, which a store does at once or not at all: a writer that is
killed before it leaves the map as it was. The greatest number is the map. ``load`` pins the
version that it finds, so nodes and edges of one call are of one version, and readers of an
older one keep it: ``reclaim`` deletes versions that have been replaced for a given time. Of two
writers each claims a number of its own, by a file that can be created once.

``trade_map`` publishes the
trade graph of a table folder to the shared folder once for each session; the
tables are taken as they are then, and again when their files have changed.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom import model
from graphloom.session import fresh_dir
from graphloom.sources import bindings

#: By application and listing of the tables' files: the folder of the map.
_published: dict[tuple, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _listing(spark: SparkSession, sf_dir: str) -> tuple:
    """Paths, sizes and times of the files of the tables that a trade map is made of."""
    out = []
    for name in TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in store.listStatus(at)] if store.exists(at) else []
    return tuple(sorted(out))


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, int]]:
    """(number, version, time in milliseconds) of the versions that were made the map, in their order."""
    store, at = _store(spark, f"{path}/current")
    found = [(f.getPath().getName(), f.getModificationTime()) for f in store.listStatus(at)] if store.exists(at) else []
    named = [(*name.partition("-")[::2], when) for name, when in found if name[:1].isdigit()]
    return sorted((int(number), version, when) for number, version, when in named)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is the map now."""
    found = versions(spark, path)
    return f"{path}/versions/{found[-1][1]}" if found else None


def publish(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Write a map below ``path`` and make it the one that readers find; its version.

    Each task writes the edges that it has, a file for each of their kinds: nothing is shuffled for that.
    """
    spark, version = nodes.sparkSession, uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    nodes.write.parquet(f"{folder}/nodes", compression="zstd")
    edges.write.partitionBy("kind").parquet(f"{folder}/edges", compression="zstd")
    switch(spark, path, version)
    return version


def switch(spark: SparkSession, path: str, version: str) -> None:
    """Make a whole version the map, by one rename to the next free number."""
    store, ready = _store(spark, f"{path}/versions/{version}/ready")
    store.mkdirs(_store(spark, f"{path}/current")[1])
    store.create(ready, True).close()
    number = max((n for n, _, _ in versions(spark, path)), default=0) + 1
    # The number is claimed by a file that is created only if it isn't there.
    while not store.createNewFile(_store(spark, f"{path}/claims/{number:012d}")[1]):
        number += 1
    if not store.rename(ready, _store(spark, f"{path}/current/{number:012d}-{version}")[1]):
        raise OSError(f"version {version} of {path} could not be made the map")


def reclaim(spark: SparkSession, path: str, seconds: float = 86_400.0) -> list[str]:
    """Delete versions that were replaced ``seconds`` ago or earlier; their names."""
    found, gone = versions(spark, path), []
    now = time.time() * 1000
    for (number, version, _), (_, _, replaced) in zip(found, found[1:]):
        if now - replaced >= 1000 * seconds:
            # Nobody finds it first; then its files go.
            for name in (f"current/{number:012d}-{version}", f"versions/{version}"):
                store, at = _store(spark, f"{path}/{name}")
                store.delete(at, True)
            gone.append(version)
    return gone


def load(spark: SparkSession, path: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a published map, both of the version that is the map now, or of a given one."""
    folder = f"{path}/versions/{version}" if version else current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no map was published below {path}")
    nodes = spark.read.schema(model.NODE).parquet(f"{folder}/nodes")
    edges = spark.read.schema(model.EDGE).parquet(f"{folder}/edges")
    return nodes, edges.select("source", "target", "kind", "weight")


def trade_map(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The published trade graph of ``sf_dir``."""
    key = (spark.sparkContext.applicationId, _listing(spark, sf_dir))
    if key not in _published or current(spark, _published[key]) is None:
        path = fresh_dir(spark, "map")
        publish(*bindings.trade(spark, sf_dir), path)
        _published[key] = path
    return load(spark, _published[key])
