"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group. Every task differences its groups block by block (bounded memory) into partial partitions of
one sum per shard; the partials, one per block, are differenced once more on the driver, which yields for each block
the order in which its parts go to the shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, numbered, table, unused
from .mixing import mix

SHARDS = 8
#: Groups differenced together; a task holds no more at a time.
BLOCK_GROUPS = 50_000


def differencing(items: list[list[int]], parts: int) -> list[list[int]]:
    """For each item (a list of ``parts`` sums, the first ones of which may be all there is) the part that each of its sums goes to.

    The two partial partitions of largest spread are combined, the largest sums of one with the smallest of the other,
    until one is left. Returned as one list per item: position in the item's list -> part.
    """
    heap = []
    for i, sums in enumerate(items):
        slots = sorted(((s, [(i, k)]) for k, s in enumerate(sums)), key=lambda x: -x[0])
        slots += [(0, [])] * (parts - len(slots))
        heap.append((slots[-1][0] - slots[0][0], i, slots))
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        slots = []
        for (s, x), (t, y) in zip(a, reversed(b)):
            if len(x) < len(y):
                x, y = y, x
            if y:
                if not x:
                    x = []
                x.extend(y)
            slots.append((s + t, x))
        slots.sort(key=lambda x: -x[0])
        n += 1
        heapq.heappush(heap, (slots[-1][0] - slots[0][0], n, slots))
    out = [[0] * len(sums) for sums in items]
    for part, (_, members) in enumerate(heap[0][2] if heap else []):
        for i, k in members:
            out[i][k] = part
    return out


def assign_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, copies, shard) for ``groups(key, copies, bytes)`` so that the shards' bytes are nearly equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            size = t["bytes"].to_pylist()
            # Differencing goes through the groups from the largest; part k of the block is its k-th largest sum.
            label = [x[0] for x in differencing([[s] for s in size], shards)]
            b = pa.array([(task << 32) + block] * len(size), pa.int64())
            return pa.RecordBatch.from_arrays([t["key"].combine_chunks(), t["copies"].combine_chunks(), t["bytes"].combine_chunks(), b, pa.array(label, pa.int32())], names=["key", "copies", "bytes", "block", "label"])

        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_GROUPS):
                batch = whole.slice(a, BLOCK_GROUPS)
                if held and sum(x.num_rows for x in held) + batch.num_rows > BLOCK_GROUPS:
                    yield flush()
                    held, block = [], block + 1
                held.append(batch)
        if held:
            yield flush()

    local = table(groups.select("key", "copies", "bytes").mapInArrow(run, "key string, copies long, bytes long, block long, label int"), "partials")
    sums: dict[int, list[int]] = {}
    for r in local.groupBy("block", "label").agg(F.sum("bytes").alias("bytes")).collect():  # shards rows per block
        sums.setdefault(r.block, [0] * shards)[r.label] = r.bytes
    order = sorted(sums)
    to = differencing([sums[b] for b in order], shards)
    spark = groups.sparkSession
    where = spark.createDataFrame([(b, k, to[i][k]) for i, b in enumerate(order) for k in range(shards)], "block long, label int, shard int")
    return local.join(where, ["block", "label"]).select("key", "copies", "shard")


def _sized(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
        "_key": F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256),
    })


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs(doc_id, text)``.

    Law ``bytes``: equal texts (null counts as empty) share a shard and the shards' sums of sizes are nearly equal, as far
    as single groups allow. Slots are gapless from 0 in every shard; repeated rows get a slot each; an empty table gives
    no rows.
    """
    light = table(_sized(docs.select("doc_id", "text"), "text").select("doc_id", "size", "text_crc32", "_key", F.monotonically_increasing_id().alias("_row")), "sizes")
    total = light.count()
    groups = light.groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("copies"), F.sum("size").alias("bytes"))
    placed = assign_groups(groups, shards).withColumnRenamed("key", "_key")
    rows = join_hot(light, placed, "_key", "copies", total, F.col("_row"))
    out = numbered(table(rows, "placed"), "shard", total, F.xxhash64("_row"), [F.col("_row")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def into_shards(docs: DataFrame, shards: int = SHARDS, mixed: str | None = None, **how) -> DataFrame:
    """``docs`` with shard and slot: the documents themselves, ready to be written ``partitionBy`` shard.

    ``mixed`` names the position that ``mixing.mix`` gave the rows (it is dropped): the slots of every shard are then a
    mix to the same weights (``how`` as for ``mix``), in which each source keeps the order of its positions.

    Null and empty texts are one group; equal rows get a slot each; columns of any name stay; an empty table stays empty.
    """
    shard, slot, row = unused(docs, "shard", "slot", "row_no")
    key, = unused(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    groups = keyed.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("copies"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes"))
    placed = table(assign_groups(groups, shards).withColumnRenamed("key", key).withColumnRenamed("shard", shard), "placed")
    total = docs.count()
    rows = join_hot(keyed, placed, key, "copies", total, F.monotonically_increasing_id())
    if mixed is not None:
        out = mix(rows.drop(key), within=shard, order=mixed, **how)
        return out.withColumnRenamed(out.columns[-1], slot).drop(out.columns[-2], mixed)
    salt = F.xxhash64("doc_id", key)
    return numbered(rows, shard, total, salt, [salt, F.col("doc_id")], slot).drop(key, row)
