"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning on signatures, exact check of the survivors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presslake.llm.shingles import mixed, shingle_sets
from presslake.session import scratch, staged

SIZE = 5
PERCENT = 85
#: Signature values, and the chance at which a pair at the threshold may share no band.
HASHES = 128
NO_BAND = 5e-7
#: Chance at which the Bayesian test may lose a pair, and the signature values it reads at a time.
MISS = 1e-7
BATCH = 16
#: Members of a bucket that meet in one task.
TILE = 512

_RANDOM = np.random.default_rng(977)
_A = (_RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES multiply-add functions over the set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, (_A * short[None, at:at + 2048] + _B).min(axis=1), out=least)
    return least


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """(rows, bands): the longest bands, and the fewest of them, that lose a pair at the threshold with at most NO_BAND.

    At 0.85 these are 25 bands of 5 values, (1 - 0.85^5)^25 = 4.3e-7; at 0.8, 28 of 4, (1 - 0.8^4)^28 = 3.9e-7.
    """
    for rows in range(5, 0, -1):
        chance = (percent / 100) ** rows
        bands = math.ceil(math.log(NO_BAND) / math.log1p(-chance)) if chance < 1 else 1
        if rows * bands <= HASHES:
            return rows, bands
    return 1, HASHES


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For n compared values, the fewest matches at which the pair is still alive.

    With a uniform prior the similarity after m matches of n has a Beta(m + 1, n - m + 1) posterior; its mass above the
    threshold t is P(Binomial(n + 1, t) <= m). A pair is pruned where that falls below `miss`.
    """
    t, needed = percent / 100, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, 0
        while True:
            mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        needed[n] = m
    return needed


def alive(left: np.ndarray, right: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Which pairs of signatures (rows of `left` and `right`) survive the sequential test; pruned pairs are read no further."""
    live, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, least in least_matches(percent, miss).items():
        part = slice(n - BATCH, n)
        matches[live] += (left[live, part] == right[live, part]).sum(axis=1, dtype=np.int32)
        live = live[matches[live] >= least]
    out = np.zeros(len(left), bool)
    out[live] = True
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column("text").cast(pa.binary()) if not pa.types.is_binary(batch.column("text").type) else batch.column("text")
    return [t if t is not None else b"" for t in column.to_pylist()]


def _parts(texts: list[bytes], most: int = 1_000_000) -> Iterator[slice]:
    """Consecutive texts of about `most` bytes together, so that the arrays of a batch stay small."""
    begun, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield slice(begun, i)
            begun, size = i, 0
        size += len(text)
    if begun < len(texts):
        yield slice(begun, len(texts))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch)
        for part in _parts(texts):
            sets = shingle_sets(texts[part], SIZE)
            signatures = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[part.start:part.stop], batch.column("text_key")[part.start:part.stop],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array(signatures, pa.binary()),
            ], ["doc_id", "text_key", "n_shingles", "node", "signature"])


def _bands(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, band, place): the hash of each band of each signature, and which band of the signature it is."""
    size, bands = banding(percent)
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64))
    salt = mixed(np.arange(1000, 1000 + bands, dtype=np.uint64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            rows = values[:, :size * bands].reshape(-1, bands, size).astype(np.uint64)
            keys = mixed((rows * factors).sum(axis=2, dtype=np.uint64) ^ salt)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").take(pa.array(np.repeat(np.arange(len(keys)), bands))),
                pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(keys))),
            ], ["node", "band", "place"])

    return nodes.select("node", "signature").mapInArrow(cut, "node binary, band long, place int")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pruned(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave them a chance."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = alive(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    joined = pairs.join(right, "b").join(left, "a").where(_size_fits(F.col("n_a"), F.col("n_b"), percent))
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a binary, b binary")


def _sets(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, signature, shingles): the full sets of the nodes in `needed`, written down; no other text is read into shingles."""
    homes = nodes.join(needed, "node", "left_semi").select("node", "signature", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = texts.join(homes, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "signature", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _texts(batch)
            for part in _parts(rows):
                yield pa.RecordBatch.from_arrays([
                    batch.column("node")[part.start:part.stop], batch.column("signature")[part.start:part.stop],
                    pa.array([s.tobytes() for s in shingle_sets(rows[part], SIZE)], pa.binary())], ["node", "signature", "shingles"])

    return staged(texts.mapInArrow(sets, "node binary, signature binary, shingles binary"))


def _set_of(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    made = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), nodes, docs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(_set_of(x), _set_of(y), percent) for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = made.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = made.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(check, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of `links` (a, b) the smallest node that it reaches, by large-star and small-star rounds.

    Each round is a few joins and minima over the links, which stay on the cluster; rounds grow with the logarithm of the size
    of a component. The rounds end when every larger end has one smaller end that is no larger end itself.
    """
    def both(edges: DataFrame) -> DataFrame:
        return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(edges: DataFrame) -> bool:
        """Whether each component is its least node with the others around it. Links are distinct, and a > b in each."""
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(
            edges.select(F.col("b").alias("u"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
        told = ends.groupBy("u").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
        return told.where("ups > 1 or (ups = 1 and downs = 1)").isEmpty()

    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not stars(edges):
        near = both(edges)
        least = near.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = near.join(least, near["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _across(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links between the roots of rows of (band, place, node, root) that share a band but not a root.

    A bucket is cut into tiles of about `tile` members; each pair of tiles meets in one task with signatures and full sets. A
    pair is compared only in the first band that it shares, by the sequential test and then on the full sets, and only
    links leave the task; a link between members that links already join there is not looked for again.
    """
    size = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    size = size.where("low <> high").select("band", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    open_rows = staged(buckets.join(size, "band"))
    rows = open_rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("band", "place", "node", "root", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    made = _sets(open_rows.select("node").distinct(), nodes, docs)
    width, bands = banding(percent)
    rows = rows.join(made, "node")

    def settle(rows: pa.Table) -> pa.RecordBatch | None:
        own, first, second, place = (rows.column(c).to_numpy() for c in ("own", "first", "second", "place"))
        names, kept = rows.column("root").combine_chunks(), rows.column("shingles").combine_chunks()
        group = names.dictionary_encode().indices.to_numpy().copy()
        values = _matrix(rows.column("signature"))
        sizes = np.array([len(x.as_buffer()) // 8 for x in kept])
        left, right = np.flatnonzero(own == first[0]), np.flatnonzero(own == second[0])
        found = []
        for i in left:
            others = right[right > i] if first[0] == second[0] else right
            others = others[(group[others] != group[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))]
            if not len(others):
                continue
            same = (values[others, :width * bands] == values[i, :width * bands]).reshape(-1, bands, width).all(axis=2)
            others = others[same.argmax(axis=1) == place[0]]
            if not len(others):
                continue
            mine = _set_of(kept[i])
            for j in others[alive(np.broadcast_to(values[i], (len(others), HASHES)), values[others], percent)]:
                if group[j] != group[i] and _similar(mine, _set_of(kept[j]), percent):
                    found.append((i, j))
                    group[group == group[j]] = group[i]
        if not found:
            return None
        a, b = (pa.array(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([names.take(a), names.take(b)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in ("band", "first", "second")], axis=1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1))
            for begin, end in zip(starts[:-1], starts[1:]):
                if (out := settle(held.slice(begin, end - begin))) is not None:
                    yield out
            held = held.slice(starts[-1])
        if held is not None and held.num_rows and (out := settle(held)) is not None:
            yield out

    grouped = rows.repartition("band", "first", "second").sortWithinPartitions("band", "first", "second")
    return grouped.mapInArrow(compare, "a binary, b binary").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n_shingles, node, signature), and for each node its first row (node, doc_id, text_key) and the root of its component."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kinds = [T.StructField(c, keyed.schema[c].dataType) for c in ("doc_id", "text_key")]
    kinds += [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("signature", T.BinaryType())]
    told = staged(keyed.mapInArrow(_describe, T.StructType(kinds)))
    some = told.where("node is not null")
    home = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("home")
    nodes = staged(some.groupBy("node").agg(home, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")).select(
        "node", F.col("home.doc_id").alias("doc_id"), F.col("home.text_key").alias("text_key"), "n_shingles", "signature"))

    bands = staged(_bands(nodes, percent))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(bands.join(sizes, "band"))
    # The member that shares bands most often stands in the middle of its group.
    ranks = shared.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = shared.join(ranks, "node")
    centres = ranked.groupBy("band").agg(F.max(F.struct("rank", "node")).alias("top")).select("band", F.col("top.node").alias("a"))
    stars = ranked.select("band", F.col("node").alias("b")).join(centres, "band").where("a <> b").select("a", "b").distinct()
    links = staged(_linked(staged(_pruned(stars, nodes, percent)), nodes, docs, percent))
    roots = staged(components(links))
    placed = shared.select("band", "place", "node").join(roots, "node", "left").select("band", "place", "node", F.coalesce("root", "node").alias("root"))
    more = staged(_across(placed, nodes, docs, percent))
    classes = nodes.select("node", "doc_id", "text_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not more.isEmpty():
        tops = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
        classes = classes.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root"))
    return told, classes.select("node", "doc_id", "text_key", "root")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; the set of a text holds its distinct 5-word shingles, or its
    whole sequence if it has fewer words. Texts of equal sets are one class. Classes that share a band of their
    signatures are candidates; each bucket is first compared with its most connected member, then what those links
    leave apart is compared tile by tile, so pairs inside a group are never listed. Candidates pass the sequential
    Bayesian test and are linked if 100 * intersection >= percent * union on the full sets. `component_id` is
    the smallest id that links reach, `kept` marks the document with that id.

    Null, empty and blank texts have no shingles, are linked with nothing and stay. Rows without id join components but do
    not name them; a component without any id has a null component_id and all its rows are kept. Rows that share an id
    are judged each by its own text. Empty input gives an empty result. Only doc_id and text are read.
    """
    with scratch(docs.sparkSession) as keep:
        told, classes = _classes(docs, percent)
        named = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of_node = classes.join(named, "root").select(F.col("node").alias("_node"), "component_id")
        joined = told.join(of_node, told["node"] == of_node["_node"], "left")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        out = keep(joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of `near_duplicates`, and the rows that are linked with nothing; columns as they are.

    Of a component the row stays that is first by id (rows without id last), text hash and hash of the whole row, also if no row
    has an id, one id is on several of its texts, or the row is repeated. Blank texts belong to no component: with an id,
    one row stays for each id and text, without one all rows stay.
    """
    names = docs.columns
    # Ids as text beside a flag: keys without null, so that the texts travel once for the minimum and the join.
    keys = [F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), "text_key"]
    with scratch(docs.sparkSession) as keep:
        told, classes = _classes(docs, percent)
        homes = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("home"))
        kept = homes.select("home.doc_id", "home.text_key").select(*keys)
        kept = keep(kept.union(told.where("node is null and doc_id is not null").select(*keys)).distinct().withColumnRenamed("text_key", "_text"))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    packed = docs.select(row.alias("_row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    blank = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    # Repeated rows meet on the map side first, so many copies of one row do not gather.
    first = packed.where(~blank).select("_row", *keys).groupBy("_none", "_doc", F.col("text_key").alias("_text")).agg(
        F.min_by("_row", F.xxhash64(F.col("_row").cast("string"))).alias("_row"))
    found = first.join(kept, ["_none", "_doc", "_text"], "left_semi").select("_row").union(packed.where(blank).select("_row"))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
