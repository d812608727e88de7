"""Annotation slots, batches, content hashes and carry-over."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, exists, numbered

BATCH = 25
#: Names of a flow's steps that its payload shows.
STEP_NAMES = 10
#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def slots(nodes: DataFrame, layers: DataFrame, flows: DataFrame, tour: DataFrame) -> DataFrame:
    """(slot_key, family, payload): what a provider could still write, in five families."""
    slot = lambda df, family, prefix, key, payload: df.select(
        F.concat(F.lit(prefix), key).alias("slot_key"), F.lit(family).cast("int").alias("family"), payload.alias("payload"))
    open_layers = layers.where("provenance = 'structural'")
    return (
        slot(nodes.where("provenance = 'structural'"), 0, "summary:", F.col("node_id"), F.col("summary"))
        .unionByName(slot(open_layers, 1, "layer-name:", F.col("layer_id"), F.col("name")))
        .unionByName(slot(open_layers, 2, "layer-description:", F.col("layer_id"), F.col("description")))
        .unionByName(slot(flows, 3, "flow-name:", F.col("flow_id"), F.col("name")))
        .unionByName(slot(tour, 4, "tour-label:", F.col("node_id"), F.col("label")))
    )


def slot_payloads(nodes: DataFrame, layers: DataFrame, flows: DataFrame, steps: DataFrame, tour: DataFrame, degrees: DataFrame) -> DataFrame:
    """(slot_key, family, payload): the slots with what a provider is told of each, as JSON.

    ``steps`` is (root, node_id, pos) and ``degrees`` (node_id, path, fan_in, fan_out).
    Layers tell how many files they hold; flows their entry, their first ten steps and how
    many there are; stops their imports. Of a flow only those steps are gathered.
    """
    still = lambda df: df.where("provenance = 'structural'") if "provenance" in df.columns else df

    def told(df: DataFrame, family: int, slot: str, key: str, **fields: Column) -> DataFrame:
        slot_key = F.concat(F.lit(f"{slot}:"), key)
        said = F.struct(F.lit(slot).alias("slot"), slot_key.alias("key"), *(c.alias(k) for k, c in fields.items()))
        return df.select(slot_key.alias("slot_key"), F.lit(family).cast("int").alias("family"), F.to_json(said, {"ignoreNullFields": "false"}).alias("payload"))

    held = nodes.where("kind = 'file'").groupBy(F.col("layer").alias("layer_id")).agg(F.count("*").alias("n"))
    sized = still(layers).join(held, "layer_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    count = steps.groupBy("root").agg(F.count("*").alias("step_count"))
    near = steps.where(F.col("pos") < STEP_NAMES)
    near = near if "name" in steps.columns else near.join(nodes.select("node_id", "name"), "node_id", "left")
    first = near.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", "node_id").alias("name")))).alias("s"))
    walked = still(flows).withColumn("root", F.substring_index("flow_id", "flow:", -1) if "root" not in flows.columns else F.col("root"))
    walked = walked.join(first, "root").join(count, "root").withColumn("names", F.col("s.name"))
    stops = still(tour).join(degrees.select("node_id", "path", "fan_in", "fan_out"), "node_id")
    of_layer = {"directory": F.col("layer_id"), "member_files": F.col("n")}
    c = F.col
    return (
        told(still(nodes), 0, "summary", "node_id", kind=c("kind"), name=c("name"), path=c("path"), mechanical_summary=c("summary"))
        .unionByName(told(sized, 1, "layer-name", "layer_id", **of_layer))
        .unionByName(told(sized, 2, "layer-description", "layer_id", **of_layer))
        .unionByName(told(walked, 3, "flow-name", "flow_id", domain=c("domain"), entry_point=F.get("names", F.lit(0)), steps=c("names"), step_count=c("step_count")))
        .unionByName(told(stops, 4, "tour-label", "node_id", path=c("path"), fan_in=c("fan_in"), fan_out=c("fan_out"), mechanical_label=c("label")))
    )


def parse_answers(reply: str) -> dict[str, str]:
    """Texts by slot key from ``{"answers": [{"key": ..., "text": ...}]}``.

    There is no repair: a reply of any other shape raises ``ValueError``.
    """
    try:
        rows = json.loads(reply)["answers"]
        out = {r["key"]: r["text"] for r in rows}
    except (KeyError, TypeError, json.JSONDecodeError) as why:
        raise ValueError("the reply is not of the requested shape") from why
    if not isinstance(rows, list) or not all(isinstance(x, str) for pair in out.items() for x in pair):
        raise ValueError("the reply is not of the requested shape")
    return out


def batches(slot_rows: DataFrame, size: int = BATCH) -> DataFrame:
    """(slot_key, batch_id): slots in order of family and key, ``size`` to a batch."""
    rows = numbered(slot_rows.select("family", "slot_key"), "family", "slot_key")
    return rows.select("slot_key", F.floor(F.col("number") / size).cast("long").alias("batch_id"))


def cost_estimate(slot_rows: DataFrame) -> DataFrame:
    """One row: slots, calls, and the range of prompt and answer tokens."""
    sums = slot_rows.agg(F.count("*").alias("n_slots"), F.coalesce(F.sum(F.length("payload") + F.length("slot_key")), F.lit(0)).alias("chars"))
    return sums.select(
        "n_slots", F.ceil(F.col("n_slots") / BATCH).cast("long").alias("n_calls"),
        F.floor(F.col("chars") / 4).cast("long").alias("prompt_low"), F.floor(F.col("chars") / 3).cast("long").alias("prompt_high"),
        (F.col("n_slots") * 25).alias("answer_low"), (F.col("n_slots") * 45).alias("answer_high"),
    )


def content_hash(data: Column) -> Column:
    """``fnv1a64:`` and the hash of a text's bytes as 16 hex digits; null for null."""
    @F.pandas_udf("string")
    def fnv(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in rows:
            out = np.full(len(batch), None, object)
            some = np.flatnonzero(batch.notna())
            hashes = fnv_hashes([batch.iloc[i].encode() for i in some])
            out[some] = [f"fnv1a64:{h:016x}" for h in hashes.tolist()]
            yield pd.Series(out, dtype=object)

    return fnv(data)


def fnv_hashes(rows: list[bytes]) -> np.ndarray:
    """FNV-1a of each row: all rows step together, byte by byte, the longest first, so
    that those still going are the head of the arrays. The few that are much longer than the
    rest go on one by one."""
    size = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(rows), np.uint8)
    first = (np.cumsum(size) - size)[order]
    hashes = np.full(len(rows), FNV_OFFSET, np.uint64)
    # An array's step costs as much as some eight bytes of a plain loop.
    together = int(np.sort(size)[-9]) if len(rows) > 8 else 0
    alive = np.searchsorted(-size[order], -np.arange(together), side="left")
    for at, n in enumerate(alive.tolist()):
        hashes[:n] = (hashes[:n] ^ data[first[:n] + at]) * np.uint64(FNV_PRIME)
    for i in range(int(np.searchsorted(-size[order], -together, side="left"))):
        h = int(hashes[i])
        for byte in rows[order[i]][together:]:
            h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        hashes[i] = h
    out = np.zeros(len(rows), np.uint64)
    out[order] = hashes
    return out


def fnv_effect(data: bytes) -> np.ndarray:
    """What FNV-1a makes of ``data`` from each of the 256 states of a lowest byte.

    ``h ^ byte`` only changes the lowest byte, and how that goes on depends on itself alone.
    So from any state ``h`` the hash is that from its lowest byte plus ``(h - lowest) * PRIME ** len``:
    256 numbers and a length stand for a piece of a text, and pieces can be put together.
    """
    h = np.arange(256, dtype=np.uint64)
    prime = np.uint64(FNV_PRIME)
    for byte in np.frombuffer(data, np.uint8).astype(np.uint64):
        h = (h ^ byte) * prime
    return h


def fnv_after(h: int, effect: np.ndarray, length: int) -> int:
    """The state after a piece that has ``effect``."""
    low = h & 255
    return (int(effect[low]) + (h - low) * pow(FNV_PRIME, length, 1 << 64)) & 0xFFFFFFFFFFFFFFFF


def joined_hash(rows: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """(key, hash): the content hash of each key's texts in the given order, a line break between them.

    Rows are range-sorted by key and order, so a key may span many tasks. A key that is neither the first nor the
    last of a task is whole there and is hashed with the others of its batch. Of those two each task
    makes an effect, and a key's effects, a row a task, are put together in their order.
    """
    spark = rows.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism * 4)
    given = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
    by = ["key", *(f"_{i}" for i in range(len(order)))]
    # A given number of ranges is kept as it is, and they are in the order of their numbers.
    ranged = given.repartitionByRange(n, *by).sortWithinPartitions(*by).select("key", "text", F.spark_partition_id().alias("part"))

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def piece(name, said: list[bytes]) -> pd.DataFrame:
            data = b"\n".join(said)
            return pd.DataFrame({"key": [name], "hash": pd.Series([None], dtype=object), "part": [part], "length": [len(data)], "effect": [fnv_effect(data).tobytes()]})

        # The key that goes on in the next batch, and its texts so far.
        part, now, held, first = 0, None, [], True
        for batch in batches:
            part, whole = int(batch["part"].iloc[0]), []
            for name, said in zip(batch["key"], batch["text"]):
                if held and name != now:
                    if first:
                        yield piece(now, held)
                    else:
                        whole.append((now, b"\n".join(held)))
                    held, first = [], False
                now = name
                held.append(said.encode())
            if whole:
                hashes = [f"fnv1a64:{h:016x}" for h in fnv_hashes([data for _, data in whole]).tolist()]
                yield pd.DataFrame({"key": [name for name, _ in whole], "hash": hashes, "part": part, "length": 0, "effect": None})
        if held:
            yield piece(now, held)

    def together(pieces: pd.DataFrame) -> pd.DataFrame:
        h, first = FNV_OFFSET, True
        for length, effect in pieces.sort_values("part")[["length", "effect"]].itertuples(index=False):
            h = h if first else (h ^ 10) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            h, first = fnv_after(h, np.frombuffer(effect, np.uint64), int(length)), False
        return pd.DataFrame({"key": pieces["key"].iloc[:1], "hash": [f"fnv1a64:{h:016x}"]})

    made = cut(ranged.mapInPandas(effects, "key string, hash string, part int, length long, effect binary"), "hash-pieces")
    parted = made.where("hash IS NULL").groupBy("key").applyInPandas(together, "key string, hash string")
    return made.where("hash IS NOT NULL").select("key", "hash").unionByName(parted).withColumnRenamed("key", key)


def layer_inputs(nodes: DataFrame) -> DataFrame:
    """(layer_id, hash) of the sorted paths of each layer's files."""
    files = nodes.where("kind = 'file' AND layer IS NOT NULL").select(F.col("layer").alias("layer_id"), "path")
    return joined_hash(files, "layer_id", "path", "path")


def flow_inputs(steps: DataFrame) -> DataFrame:
    """(root, hash) of the node ids of each flow's steps in their order."""
    return joined_hash(steps.select("root", "node_id", "pos"), "root", "node_id", "pos")


def tour_inputs(tour: DataFrame) -> DataFrame:
    """(node_id, hash) of the mechanical label of each stop."""
    return tour.select("node_id", content_hash(F.col("label")).alias("hash"))


def apply_answers(slot_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(slot_key, text, provenance): a non-blank answer replaces the mechanical text."""
    joined = slot_rows.join(answers.select("slot_key", "answer"), "slot_key", "left")
    good = F.coalesce(F.btrim("answer") != "", F.lit(False))
    return joined.select(
        "slot_key", F.when(good, F.col("answer")).otherwise(F.col("payload")).alias("text"),
        F.when(good, "llm").otherwise("structural").alias("provenance"),
    )


def reattach(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, text, provenance): stored text where key and content hash both still hold.

    ``current`` is (key, hash, text) as made mechanically, ``stored`` is
    (key, hash, text) as written earlier. A null hash matches nothing.
    """
    old = stored.select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), F.col("text").alias("_text"))
    joined = current.join(old, (F.col("key") == F.col("_key")) & (F.col("hash") == F.col("_hash")), "left")
    return joined.select(
        "key", F.coalesce("_text", "text").alias("text"), F.when(F.col("_text").isNotNull(), "llm").otherwise("structural").alias("provenance")
    )


def _pairs(group: pd.DataFrame) -> list[tuple[str, str]]:
    """A batch's keys and payloads in the slots' order."""
    group = group.sort_values(["family", "slot_key"])
    return list(zip(group["slot_key"], group["payload"]))


def file_hashes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node_id, hash) of every node by its file's content.

    Each of ``texts`` (path, text) is hashed once, before the join; a file that is
    missing or could not be read (null) has no hash, which matches nothing.
    """
    hashed = texts.select("path", content_hash(F.col("text")).alias("hash"))
    return nodes.select("node_id", "path").join(hashed, "path", "left").select("node_id", "hash")


def fill_saved(slot_rows: DataFrame, provider: Callable[[list[tuple[str, str]]], dict[str, str]], path: str, workers: int = 4) -> DataFrame:
    """(slot_key, answer) as ``fill``, saved below ``path`` as the batches come in.

    ``workers`` batches run at a time. A batch that raises stops the run after those beside
    it, whose answers are kept: what was answered is never asked again, by this or a later
    call with the same ``path``. Without open slots the provider isn't called.
    """
    spark = slot_rows.sparkSession
    saved = "slot_key string, answer string"
    done = lambda: spark.read.schema(saved).parquet(path)
    left = slot_rows.join(done(), "slot_key", "left_anti") if exists(spark, path) else slot_rows
    todo = cut(left.join(batches(left), "slot_key"), "to-fill")

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        try:
            answers = provider(_pairs(group))
        except Exception as why:  # noqa: BLE001 - told to the driver, which raises it
            return pd.DataFrame({"slot_key": [None], "answer": [None], "failure": [repr(why)]}, dtype=object)
        return pd.DataFrame({"slot_key": list(answers), "answer": list(answers.values()), "failure": None}, dtype=object)

    total = (todo.agg(F.max("batch_id")).head()[0] + 1) if not todo.isEmpty() else 0
    for first in range(0, total, workers):
        wave = todo.where(F.col("batch_id").between(first, first + workers - 1)).repartition(workers, "batch_id")
        came = cut(wave.groupBy("batch_id").applyInPandas(ask, saved + ", failure string"), "filled")
        came.where("failure IS NULL").select("slot_key", "answer").write.mode("append").parquet(path)
        failed = came.where("failure IS NOT NULL").head()
        if failed:
            raise RuntimeError(f"{done().count()} slots were answered and saved before this: {failed.failure}")
    return done() if exists(spark, path) else spark.createDataFrame([], saved)


def fill(slot_rows: DataFrame, provider: Callable[[list[tuple[str, str]]], dict[str, str]], workers: int = 4) -> DataFrame:
    """(slot_key, answer) from a provider that is called once for each batch."""
    numbered = slot_rows.join(batches(slot_rows), "slot_key")

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        answers = provider(_pairs(group))
        return pd.DataFrame({"slot_key": list(answers), "answer": list(answers.values())}, dtype=object)

    return numbered.repartition(workers, "batch_id").groupBy("batch_id").applyInPandas(ask, "slot_key string, answer string")
