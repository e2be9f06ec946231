"""Benchmark decontamination: n-grams of the test items against every document, with verified hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import PLAIN_WORD, ascii_lower, let, words_of
from presslake.operators.stage import computed
from presslake.session import staged

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: n-grams of the benchmark that may be copied to every task; beyond it the n-grams meet the documents in a shuffle.
MOST_BROADCAST = 500_000
#: The word pattern before lower-casing.
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, its words, and the least run that counts: a window, or the whole of a shorter item."""
    items = benchmark.select("item_id", words_of(ascii_lower(F.col("text")), PLAIN_WORD).alias("item")).where(F.size("item") > 0)
    return items.distinct().withColumn("least_run", F.least(F.size("item"), F.lit(window)))


def _gram(run: int) -> tuple[int, int]:
    """Length of the n-grams looked up for runs of `run` words, and the step of the grid on which documents are read.

    A run of `run` words at any place holds a whole n-gram that starts on the grid: length + step = run + 1.
    """
    length = (run + 1) // 2
    return length, run + 1 - length


def _grid(starts: Column, run: int, length: int) -> Column:
    return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(run), F.slice("words", i + 1, length)).alias("gram"), i.alias("at")))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, row_key, item_id, start, end): the maximal runs of words that a document and an item share around an n-gram.

    Each run holds a window of the item. Documents are read on a grid of n-grams; an n-gram of the broadcast hash set of the
    benchmark that is met there tells how item and document may lie over each other. Words stay out of that join: documents that met
    something are read again, once, and each such position is verified and extended word by word. `row_key` is a hash of
    the text, so that rows which share an id stay apart. `most_broadcast` bounds what is copied to every task: n-grams, of three
    numbers each, and keys of documents that met one; beyond it both meet in a shuffle.
    """
    numbered = staged(_items(benchmark, window).withColumn("item_no", F.monotonically_increasing_id()))
    runs = sorted(r["least_run"] for r in numbered.select("least_run").distinct().collect())
    words = words_of(ascii_lower(F.col("text")), PLAIN_WORD).alias("words")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    if not runs:
        return keyed.limit(0).select("doc_id", "row_key", F.lit(None).cast(numbered.schema["item_id"].dataType).alias("item_id"),
                                     F.lit(0).alias("start"), F.lit(0).alias("end"))
    grids, grams = [], []
    for run in runs:
        length, step = _gram(run)
        at = F.explode(F.sequence(F.lit(0), F.size("item") - length))
        grams.append(numbered.where(F.col("least_run") == run).select("item_no", "item", at.alias("offset")).select(
            "item_no", "offset", F.xxhash64(F.lit(run), F.slice("item", F.col("offset") + 1, length)).alias("gram")))
        last = F.size("words") - length
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        grids.append(_grid(starts, run, length))
    known = grams[0]
    for more in grams[1:]:
        known = known.unionAll(more)
    known = staged(known)
    if known.count() <= most_broadcast:
        known = F.broadcast(known)
    # Words and grid are each computed once per document: the fence stops filters that would repeat them.
    looked = computed(computed(keyed.select("doc_id", "row_key", words), "words").select("doc_id", "row_key", F.concat(*grids).alias("grid")), "grid")
    met = looked.select("doc_id", "row_key", F.explode("grid").alias("g")).select("doc_id", "row_key", "g.gram", "g.at").join(known, "gram")
    # How the item lies over the document, however many n-grams say so.
    over = met.groupBy("doc_id", "row_key", "item_no").agg(F.collect_set(F.col("at") - F.col("offset")).alias("firsts"))
    over = staged(over.withColumnRenamed("doc_id", "_doc").withColumnRenamed("row_key", "_key"))
    place = F.xxhash64("_doc", "_key").alias("_place")
    places = staged(over.select(place).distinct())
    again = keyed.withColumn("_place", F.xxhash64("doc_id", "row_key"))
    if places.count() <= most_broadcast:
        again = again.join(F.broadcast(places), "_place", "left_semi")
    over = over.join(numbered, "item_no").groupBy("_doc", "_key").agg(F.collect_list(F.struct("item_id", "item", "least_run", "firsts")).alias("over"))
    same = again["doc_id"].eqNullSafe(over["_doc"]) & (again["row_key"] == over["_key"])
    both = again.select("doc_id", "row_key", "text").join(over, same).select("doc_id", "row_key", words, "over")

    def verified(one: Column) -> Column:
        """The runs of an item over a document, for every way in which it may lie there."""
        item, last = one["item"], F.size(one["item"])

        def at(first: Column) -> Column:
            differing = F.filter(F.sequence(F.lit(0), last - 1), lambda j: ~F.coalesce(F.get("words", first + j) == F.get(item, j), F.lit(False)))
            # Runs lie between the places that differ.
            edges = F.concat(F.array(F.lit(-1)), differing, F.array(last))
            lie = let(edges, lambda all_: F.transform(all_, lambda e, i: F.struct(
                (first + e + 1).alias("start"), (first + F.coalesce(F.get(all_, i + 1), e)).alias("end"))))
            return F.filter(lie, lambda r: r["end"] - r["start"] >= one["least_run"])

        return F.transform(F.flatten(F.transform(one["firsts"], at)), lambda r: F.struct(one["item_id"].alias("item_id"), r["start"].alias("start"), r["end"].alias("end")))

    told = computed(computed(both, "met").select("doc_id", "row_key", F.flatten(F.transform("over", verified)).alias("runs")), "runs")
    return told.select("doc_id", "row_key", F.explode("runs").alias("r")).select("doc_id", "row_key", "r.item_id", "r.start", "r.end").distinct()


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20,
                  most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per document: doc_id, row_key, n_words, n_hit, items (sorted ids as strings), spans, contaminated.

    A document word inside any occurrence of a window of any item is hit. `items` are the distinct ids of items with a window
    in the document; an item without id hits words but is not listed. `contaminated` is n_hit > 0 and one_in * n_hit >=
    n_words. Null and empty texts have no words and are clean. Items without words are ignored. Repeated
    rows get equal results, once per row. Either table may be empty. Other columns are not read.
    """
    found = hits(docs, benchmark, window, most_broadcast)
    per_doc = found.groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = per_doc.withColumnRenamed("doc_id", "_doc").withColumnRenamed("row_key", "_key")
    counted = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.size(words_of(F.col("text"), _ANY_CASE_WORD)).cast("long").alias("n_words"))
    joined = counted.join(per_doc, counted["doc_id"].eqNullSafe(per_doc["_doc"]) & (counted["row_key"] == per_doc["_key"]), "left")
    told = joined.select("doc_id", "row_key", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                         F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    told = told.withColumn("n_hit", _covered(F.col("spans")))
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))
    return told.withColumn("contaminated", bad)


def clean(docs: DataFrame, benchmark: DataFrame, drop: str = "documents", **settings) -> DataFrame:
    """`docs` without what the benchmark holds; columns stay as they are.

    `drop="documents"` removes contaminated documents. `drop="spans"` keeps every document and removes hit words from the
    texts of contaminated ones; what stands between words stays. Documents below the threshold are left as they are.
    """
    names = docs.columns
    told = contamination(docs, benchmark, **settings).where("contaminated").select(
        F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_doc", "_key"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row_key"))
    same = packed["_id"].eqNullSafe(told["_doc"]) & (packed["_row_key"] == told["_key"])
    whole = [F.col(f"_row.`{c}`").alias(c) for c in names]
    if drop == "documents":
        return packed.join(told, same, "left_anti").select(*whole)
    joined = packed.join(told, same, "left")
    text = F.col("_row.text")
    pieces = joined.select("_row", "_spans", words_of(text, _ANY_CASE_WORD).alias("_words"), F.split(text, _ANY_CASE_WORD, -1).alias("_gaps"))
    rest = F.array_join(F.transform("_gaps", lambda gap, i: F.concat(gap, F.when(
        F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")).otherwise(F.coalesce(F.get("_words", i), F.lit(""))))), "")
    new = F.when(F.col("_spans").isNull(), text).otherwise(rest)
    return pieces.select(*[new.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names])
