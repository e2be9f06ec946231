"""Long lists of substrings: an index of q-grams over the list instead of one test for each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Characters of a gram; shorter entries are looked up by their whole text.
GRAM = 4


def anchors(entries: DataFrame, entry: str = "entry", gram: int = GRAM) -> DataFrame:
    """(size, gram, offset, entry): for each distinct entry the gram that the fewest entries share, and where it stands in it.

    `size` is `gram`, or the length of a shorter entry. Null and empty entries are left out.
    """
    distinct = entries.select(F.col(entry).alias("entry")).where(F.length("entry") > 0).distinct()
    sized = distinct.withColumn("size", F.least(F.length("entry"), F.lit(gram)))
    grams = sized.select("entry", "size", F.explode(F.sequence(F.lit(0), F.length("entry") - F.col("size"))).alias("offset"))
    grams = grams.withColumn("gram", F.substring("entry", F.col("offset") + 1, F.col("size")))
    shared = grams.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    best = grams.join(shared, ["size", "gram"]).groupBy("entry", "size").agg(F.min(F.struct("n", "gram", "offset")).alias("best"))
    return best.select("size", "best.gram", "best.offset", "entry")


def matches(df: DataFrame, text: Column, entries: DataFrame, row_id: str, entry: str = "entry", gram: int = GRAM) -> DataFrame:
    """(row_id, entry): the distinct entries that stand anywhere in `text` of each row.

    Every gram of a text meets the entries that it anchors in one equi-join, and an entry counts if the text around the gram is the
    entry. The work follows the length of the texts, not the length of the list. Rows without text match nothing.
    """
    known = anchors(entries, entry, gram)
    # Lengths of entries below `gram` and `gram` itself: at most `gram` of them.
    sizes = [r["size"] for r in known.select("size").distinct().collect()]
    if not sizes:
        return df.select(row_id, F.lit(None).cast("string").alias("entry")).limit(0)
    rows = df.select(row_id, text.alias("__text")).where(F.length("__text") > 0)
    each = rows.select(row_id, "__text", F.explode(F.array(*[F.lit(s) for s in sorted(sizes)])).alias("size")).where(F.length("__text") >= F.col("size"))
    each = each.select(row_id, "__text", "size", F.explode(F.sequence(F.lit(0), F.length("__text") - F.col("size"))).alias("__at"))
    each = each.withColumn("gram", F.substring("__text", F.col("__at") + 1, F.col("size")))
    begin = F.col("__at") - F.col("offset")
    found = each.join(known, ["size", "gram"]).where((begin >= 0) & (F.substring("__text", begin + 1, F.length("entry")) == F.col("entry")))
    return found.select(row_id, "entry").distinct()


def with_listed(df: DataFrame, text: Column, entries: DataFrame, row_id: str, out: str = "listed", **settings) -> DataFrame:
    """`df` with `out`: whether any entry stands in `text`. `row_id` is unique."""
    held = matches(df, text, entries, row_id, **settings).select(row_id).distinct().withColumn(out, F.lit(True))
    return df.join(held, row_id, "left").withColumn(out, F.coalesce(out, F.lit(False)))
