"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.common import SPACED_WORD, prefix_sums, shuffle_partitions, words_of
from presslake.session import staged

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.size(words_of(text, SPACED_WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with `target`: what each source gives to a mix of `share` times all sizes.

    The mix is dealt out by weight. A source that would give more than `most` times its size stops there and the excess is
    dealt again to the others by weight, until none is above. Only three sums leave the cluster in each round; a
    round stops at least one more source, and the rounds end when none is stopped. Null is a source of its own.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    spread = total.repartitionByRange(shuffle_partitions(sizes.sparkSession), F.col("source").asc_nulls_last())
    placed = staged(spread.sortWithinPartitions(F.col("source").asc_nulls_last())
                    .withColumn("pid", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    offsets = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("base"))
    offsets = offsets.withColumn("before", F.coalesce(F.sum("n").over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = (F.col("row") - F.col("base") + F.col("before")).cast("long")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(rank % len(weights)).cast("int")]
    weighted = staged(placed.join(offsets, "pid").select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    wanted = (weighted.agg(F.sum("source_size")).head()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        # Level 0 stops nobody; the level only rises, so a source once stopped stays so.
        above = F.col("weight") * F.lit(level) > cap
        row = weighted.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"),
                           F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
                           F.sum(F.when(above, 1).otherwise(0)).alias("n")).head()
        if not row["open"] or row["n"] == stopped:
            break
        level, stopped = (wanted - row["fixed"]) / row["open"], row["n"]
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS,
        seed: int = 11) -> DataFrame:
    """How many words of each document the mix takes: doc_id, row_key, size, source, source_size, target, taken.

    Each document gets a key from a hash of its id, text and `seed`; within its source the documents stand in the order of
    that key. Whole epochs are taken as often as the target holds the source, and the rest of the target from the
    start of the order, cut inside a document, so that a source gives its target to the word.

    Null text counts no words and gives none. Repeated rows are separate documents that share their key; equal rows are
    exchangeable, so it does not matter which of them the cut meets. Null ids are allowed. Sources of size 0
    have target 0. An empty table gives an empty result. Columns other than doc_id, text and source are not read.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("row_key")))
    targets = source_targets(sizes, weights, share, most)
    ordered = prefix_sums(sizes, "source", ["row_key", "doc_id", "size"], "size")
    # A row for each source; whether it is small enough to be copied to every task is left to the planner.
    told = targets.withColumnRenamed("source", "_source")
    joined = ordered.join(told, ordered["source"].eqNullSafe(told["_source"])).drop("_source")
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.withColumn("taken", (epochs * F.col("size") + part).cast("long")).drop("before")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as rows: `docs` with a row for each epoch that takes the document.

    A document that the cut meets is kept whole, so a source may exceed its target by less than one document in the
    last epoch. Documents without words are not taken. Rows equal in id and text are all repeated as often as the one of
    them that is taken most. Columns and their order stay; other columns, also with
    names used inside, are carried along.
    """
    key = F.xxhash64(F.lit(settings.get("seed", 11)), F.col("doc_id"), F.col("text"))
    taken = mix(docs, **settings).where("taken > 0")
    times = taken.groupBy("row_key", "doc_id").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    times = times.select(F.col("row_key").alias("_key"), F.col("doc_id").alias("_id"), "copies")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), key.alias("_key"), F.col("doc_id").alias("_doc"))
    found = packed.join(times, (packed["_key"] == times["_key"]) & packed["_doc"].eqNullSafe(times["_id"]))
    each = found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
