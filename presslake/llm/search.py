"""Ranked lexical search: term at a time with limited accumulators, in blocks of documents that meet at the best of each.

Documents are cut into blocks of bounded size. In each block a query reads the postings of its terms, rarest first. Documents get
accumulators until what the remaining terms can still give is less than the kth best partial score; from then on only documents that
have one are updated, exactly. Blocks return their k best, which a ranked window merges.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.common import PLAIN_WORD, ascii_lower, words_of
from presslake.session import scratch, staged

BEST = 50
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
#: Bytes of distinct query terms, and terms of all queries, that are copied to every task; larger query sets go in several passes.
TERM_BYTES, QUERY_TERMS = 1 << 25, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Query(NamedTuple):
    """Terms of a query, rarest first, with their weights."""

    number: int
    terms: np.ndarray
    weights: np.ndarray


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 20 * m)


def block_best(n_docs: int, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: list[Query], rank: np.ndarray, best: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query number, documents, scores, accumulators made) of the `best` documents of a block for each query.

    Postings are (docs, terms, values) sorted by term; `values` are impacts, `rank` the place of each document by ascending id,
    which orders equal scores.
    """
    known, begins = np.unique(terms, return_index=True)
    ends = np.append(begins[1:], len(terms))
    tops = np.maximum.reduceat(values, begins) if len(terms) else values
    scores, open_ = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    for query in queries:
        at = np.searchsorted(known, query.terms)
        here = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == query.terms) if len(known) else np.zeros(len(at), bool)
        at, weights = at[here], query.weights[here]
        if not len(at):
            continue
        # What this term and the ones behind it can give to a document of this block.
        rest = np.cumsum((weights * tops[at])[::-1])[::-1]
        scores[:], open_[:] = 0, False
        made, creating = 0, True
        for i, (t, w) in enumerate(zip(at, weights)):
            own, gain = docs[begins[t]:ends[t]], w * values[begins[t]:ends[t]]
            if creating and made >= best:
                partial = scores[open_]
                creating = np.partition(partial, made - best)[made - best] <= rest[i]
            if creating:
                open_[own] = True
                made = int(np.count_nonzero(open_))
                scores[own] += gain
            else:
                alive = open_[own]
                scores[own[alive]] += gain[alive]
        found = np.flatnonzero(open_ & (scores > 0))
        if len(found) > best:
            least = np.partition(scores[found], len(found) - best)[len(found) - best]
            found = found[scores[found] >= least]
        found = found[np.lexsort((rank[found], -scores[found]))[:best]]
        if len(found):
            yield query.number, found, scores[found], made


def _count(numbers: dict[bytes, int]):
    """Per document: its number of terms and, for the terms of `numbers`, their numbers and how often each occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = _WORD.findall((text or b"").translate(_LOWER))
                counts = Counter(words)
                own = sorted((numbers[w], counts[w]) for w in counts.keys() & numbers.keys())
                sizes.append(len(words))
                terms.append([t for t, _ in own])
                tfs.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(
                tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return run


def _lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + 50 * n * N div L, in Python's integers where 64 bits would not do."""
    if len(sizes) and 50 * int(sizes.max()) * n_docs >= 2**63:
        return np.array([50 + 50 * int(n) * n_docs // n_terms for n in sizes], np.int64)
    return 50 + 50 * sizes * n_docs // n_terms


def _score(queries: list[Query], n_docs: int, n_terms: int, best: int, block_docs: int, block_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table) -> pa.RecordBatch:
            sizes = rows.column("n").to_numpy()
            lists = rows.column("terms").combine_chunks()
            each = np.diff(lists.offsets.to_numpy())
            docs = np.repeat(np.arange(len(each), dtype=np.int32), each)
            terms, tfs = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy()
            values = impacts(tfs, _lengths(sizes, n_docs, n_terms)[docs])
            order = np.argsort(terms, kind="stable")
            ids = rows.column("doc_id").combine_chunks()
            rank = np.empty(len(each), np.int64)
            rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(each))
            told = list(block_best(len(each), docs[order], terms[order], values[order], queries, rank, best))
            chosen = np.concatenate([d for _, d, _, _ in told]) if told else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat([q for q, *_ in told], [len(d) for _, d, _, _ in told]).astype(np.int32)), ids.take(pa.array(chosen)),
                pa.array(np.concatenate([s for _, _, s, _ in told]) if told else np.zeros(0, np.int64))], ["number", "doc_id", "score"])

        held, postings, rows = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                rows, postings = rows + part.num_rows, postings + len(part.column("terms").flatten())
                if rows >= block_docs or postings >= block_postings:
                    yield settle(pa.Table.from_batches(held))
                    held, postings, rows = [], 0, 0
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _passes(items: list, most_bytes: int, most_terms: int) -> Iterator[list]:
    """Items in runs whose terms stay within what a task may hold; a single larger item is a run of its own."""
    run, size, count = [], 0, 0
    for item in items:
        own = sum(len(t.encode()) for t in item["terms"])
        if run and (size + own > most_bytes or count + len(item["terms"]) > most_terms):
            yield run
            run, size, count = [], 0, 0
        run.append(item)
        size, count = size + own, count + len(item["terms"])
    if run:
        yield run


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS,
           term_bytes: int = TERM_BYTES, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The `best` documents for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII digits, letters and anything beyond ASCII, A-Z lower-cased, of whole texts. N documents have a term, L is
    the number of all terms, a term in df documents weighs floor(1000 * ln((2N + 2) / (2df + 1))). A document of n terms has m = 50 + 50nN div L and
    scores, for each distinct term of the item that it holds tf times, weight * (10^9 tf div (1000 tf + 20 m)). Only scores above 0 count.
    Equal scores go by ascending doc_id, null ids last; repeated rows are documents of their own.

    Null and empty texts have no terms: such documents count nowhere, such items find nothing. Equal items are one; an item_id
    on several texts is ranked for each text. Either table may be empty. Other columns are not read. The
    items are the stated query set and are read by the driver, in passes over the documents whose terms stay within `term_bytes`
    and `query_terms`.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.array_distinct(words_of(ascii_lower(F.col("text")), PLAIN_WORD)).alias("terms")).where("size(terms) > 0").distinct()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"]
    empty = spark.createDataFrame([], f"item_id {item_type.dataType.simpleString()}, rank int, doc_id {id_type}, score bigint")
    out = None
    with scratch(spark) as keep:
        # Item by item to the driver: never more than one pass of them at once.
        for some in _passes(asked.toLocalIterator(), term_bytes, query_terms):
            names = sorted({t for item in some for t in item["terms"]})
            numbers = {t.encode(): i for i, t in enumerate(names)}
            counted = staged(docs.select("doc_id", "text").mapInArrow(_count(numbers), f"doc_id {id_type}, n bigint, terms array<int>, tfs array<bigint>"))
            counted = counted.where("n > 0")
            total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).head()
            if not total["docs"]:
                continue
            weight = F.floor(1000 * F.log(F.lit(float(2 * total["docs"] + 2)) / (2 * F.col("df") + 1)))
            # A row for each term of this pass.
            stats = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("weight", weight).collect()
            df, weights = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for row in stats:
                df[row["term"]], weights[row["term"]] = row["df"], row["weight"]
            queries = []
            for i, item in enumerate(some):
                terms = np.array(sorted(numbers[t.encode()] for t in item["terms"]), np.int32)
                terms = terms[df[terms] > 0]
                terms = terms[np.argsort(df[terms], kind="stable")]
                queries.append(Query(i, terms, weights[terms]))
            told = counted.where("size(terms) > 0").mapInArrow(
                _score(queries, total["docs"], total["terms"], best, block_docs, block_postings), f"number int, doc_id {id_type}, score bigint")
            order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            ranked = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
            of_item = spark.createDataFrame([(i, item["item_id"]) for i, item in enumerate(some)], f"_number int, item_id {item_type.dataType.simpleString()}")
            named = keep(ranked.join(F.broadcast(of_item), F.col("number") == F.col("_number")).select("item_id", "rank", "doc_id", "score"))
            out = named if out is None else out.unionAll(named)
    return out if out is not None else empty
