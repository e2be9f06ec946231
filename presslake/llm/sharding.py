"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole and shards get near equal bytes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import prefix_sums
from presslake.session import scratch, staged

SHARDS = 24
#: Groups that one task differences, and partial partitions that one task of a later level combines.
BLOCK = 20_000
FAN = 2_000


def difference(loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions, one per row of `loads` (n x k), into one by differencing.

    The two with the largest spread are taken again and again; the fullest part of one joins the emptiest of the other.
    Returns for each row the final part of each of its parts (n x k), and the loads of the k final parts.
    """
    n, k = loads.shape
    order = np.argsort(loads, axis=1, kind="stable")
    sums = list(np.take_along_axis(loads, order, axis=1))
    # label[i][j]: which part of the own row stands at place j once the parts are sorted
    heap = [(-int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        place = np.argsort(joined, kind="stable")
        node = len(sums)
        sums.append(joined[place] - joined[place[0]])
        # What is common to all parts plays no role in later differences; it is added up at the end from the loads.
        sums[a] = sums[b] = None
        where = np.empty(k, np.int16)
        where[place] = np.arange(k)
        merges.append((node, a, b, where))
        heapq.heappush(heap, (-int(sums[node][-1]), node))
    place_of = {heap[0][1]: np.arange(k, dtype=np.int16)}
    for node, a, b, where in reversed(merges):
        final = place_of.pop(node)[where]
        place_of[a], place_of[b] = final, final[::-1]
    parts = np.empty((n, k), np.int16)
    for i in range(n):
        parts[i, order[i]] = place_of[i]
    totals = np.zeros(k, np.int64)
    np.add.at(totals, parts.ravel(), loads.ravel())
    return parts, totals


def _first_level(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def settle(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["weight", "group"], kind="stable")
            loads = np.zeros((len(rows), shards), np.int64)
            loads[:, -1] = rows["weight"].to_numpy()
            parts, _ = difference(loads)
            return pd.DataFrame({"group": rows["group"], "weight": rows["weight"], "block": rows["block"], "part": parts[:, -1].astype("int32")})

        open_block, held = None, []
        for rows in batches:
            for block, some in rows.groupby("block", sort=False):
                if held and block != open_block:
                    yield settle(pd.concat(held))
                    held = []
                open_block = block
                held.append(some)
        if held:
            yield settle(pd.concat(held))

    return run


def assign_groups(groups: DataFrame, shards: int = SHARDS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(group binary, weight long) with `shard`.

    Groups are dealt by hash into blocks of about `block`, each differenced in one task. The partial partitions that come
    out, `shards` numbers each, are differenced again, `fan` at a time, until one is left, so no task and
    not the driver sees more than a bounded number of groups or partitions at once. The number of blocks follows
    from the count of groups alone, and ties are broken by the group, so reruns agree.
    """
    n = groups.count()
    blocks = max(1, -(-n // block))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int"))
    spread = dealt.repartition(blocks, "block").sortWithinPartitions("block")
    placed = staged(spread.mapInPandas(_first_level(shards), "group binary, weight long, block int, part int"))
    # Maps the parts of each block step by step to the parts of larger and larger unions of blocks.
    level = placed.groupBy("block", "part").agg(F.sum("weight").alias("load"))
    mapping = placed.select("block", "part").distinct().withColumn("top", F.col("block")).withColumn("shard", F.col("part"))

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, index = np.unique(rows["node"].to_numpy(), return_inverse=True)
        loads = np.zeros((len(nodes), shards), np.int64)
        loads[index, rows["part"].to_numpy()] = rows["load"].to_numpy()
        parts, _ = difference(loads)
        return pd.DataFrame({
            "node": np.repeat(nodes, shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(nodes)),
            "parent": int(rows["parent"].iloc[0]), "to": parts.ravel().astype("int32"), "load": loads.ravel(),
        })

    level = level.withColumnRenamed("block", "node")
    while blocks > 1:
        blocks = -(-blocks // fan)
        stepped = staged(level.withColumn("parent", (F.col("node") % blocks).cast("int")).groupBy("parent")
                         .applyInPandas(combine, "node int, part int, parent int, to int, load long"))
        step = stepped.select(F.col("node").alias("top"), F.col("part").alias("shard"), "parent", "to")
        mapping = mapping.join(step, ["top", "shard"]).select("block", "part", F.col("parent").alias("top"), F.col("to").alias("shard"))
        level = stepped.groupBy(F.col("parent").alias("node"), F.col("to").alias("part")).agg(F.sum("load").alias("load"))
    return placed.join(mapping.drop("top"), ["block", "part"]).select("group", "weight", "shard")


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_group(text: Column) -> Column:
    """Equal texts and only they share it; null text is a group of its own."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256))


def shard(docs: DataFrame, shards: int = SHARDS, **settings) -> DataFrame:
    """`docs` ids with their place: doc_id, size, text_crc32, shard, slot, by the law `bytes`.

    Size is the UTF-8 bytes of the text and 8 more; null text has size 8 and crc 0. Documents of equal text, and all
    documents without text, are one group that no shard divides; the groups' bytes are balanced by differencing. `slot`
    numbers the rows of a shard from 0 in order of id and text hash, repeated rows following each other. Null ids
    come last. Empty input gives an empty result. Only doc_id and text are read.
    """
    with scratch(docs.sparkSession) as keep:
        narrow = staged(docs.select("doc_id", byte_size(F.col("text")).alias("size"),
                                    F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
                                    text_group(F.col("text")).alias("group")))
        groups = staged(narrow.groupBy("group").agg(F.sum("size").alias("weight")))
        placed = narrow.join(assign_groups(groups, shards, **settings).select("group", "shard"), "group")
        counted = prefix_sums(placed.withColumn("one", F.lit(1).cast("long")), "shard", ["doc_id", "group"], "one", keep)
    return counted.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("before").alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS, **settings) -> DataFrame:
    """`docs` with `shard` and `slot`; columns of these names in `docs` are replaced. Repeated rows get slots of their own.

    Equal rows are counted first, so a row that is repeated often does not gather, and slots are summed up over (id, text hash,
    row hash) alone. The rows meet their places once, in one shuffle.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), text_group(F.col("text")).alias("_group"),
                         F.col("doc_id").alias("_id"), byte_size(F.col("text")).alias("_size"))
    packed = packed.withColumn("_hash", F.xxhash64(F.col("_row").cast("string")))
    with scratch(docs.sparkSession) as keep:
        narrow = staged(packed.groupBy("_group", "_hash").agg(F.min("_id").alias("_id"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_times")))
        groups = staged(narrow.groupBy(F.col("_group").alias("group")).agg(F.sum(F.col("_size") * F.col("_times")).alias("weight")))
        told = assign_groups(groups, shards, **settings).select(F.col("group").alias("_group"), F.col("shard").alias("_shard"))
        counted = prefix_sums(narrow.join(told, "_group"), "_shard", ["_id", "_group", "_hash"], "_times", keep)
    places = counted.select("_group", "_hash", "_shard", F.col("before").alias("_first"), "_times")
    rows = packed.groupBy("_group", "_hash").agg(F.first("_row").alias("_row")).join(places, ["_group", "_hash"])
    each = rows.select("_row", "_shard", F.explode(F.sequence("_first", F.col("_first") + F.col("_times") - 1)).alias("_slot"))
    return each.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], F.col("_shard").cast("int").alias("shard"), F.col("_slot").alias("slot"))
