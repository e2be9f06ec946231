"""Repeated byte strings: what an earlier document also holds, by fingerprints of fixed windows at the places of a difference cover.

No suffix is sorted and no array is built. At the places of a difference cover 64-bit polynomial hashes of windows of bytes
stand for the order of suffixes: equal windows have equal hashes, which deal out the buckets, and the hashes have no byte order. Two
equal strings have a sample place at the same distance from both starts, so a string can repeat in another document only
where the window of a sample place is equal to one of another document; strings long enough to hold a whole period of the
cover behind it are settled by hashes of longer windows there. What is left, the strings around the ends of long ties, is
matched by the hash of its own bytes. Bytes are not compared afterwards, so results are exact but for collisions of hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import shuffle_partitions
from presslake.llm.shingles import mixed
from presslake.session import scratch, stage_path, staged

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Residues that meet every difference modulo PERIOD: a perfect difference set.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of text that one task reads as a unit, and suffixes for which there is a bucket.
CHUNK_BYTES = 1 << 20
BUCKET_SUFFIXES = 1 << 21

_BYTE = np.random.default_rng(4421).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, as many as the largest unit of this worker has needed so far."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            powers = np.full(n, factor, np.uint64)
            powers[0] = 1
            _POWERS[k] = np.multiply.accumulate(powers, out=powers)
    return _POWERS


def string_ranks(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each place, equal for equal bytes but without their order, from one running sum over the unit."""
    if not len(places):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64, out=total[1:])
    return mixed((total[places + length] - total[places]) * down[places])


class _Chunk:
    """Texts of a unit laid out one after the other, with the document of each byte."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids = ids
        self.sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)

    def starts(self, length: int) -> np.ndarray:
        """Whether `length` bytes of the same document begin at each byte."""
        ok = np.zeros(len(self.data), bool)
        n = len(self.data) - length + 1
        if n > 0:
            ok[:n] = self.owner[:n] == self.owner[length - 1:]
        return ok

    def sample(self, length: int) -> np.ndarray:
        """Places of the difference-cover sample, counted from the start of each document, that have `length` bytes ahead."""
        covered = np.zeros(PERIOD, bool)
        covered[list(COVER)] = True
        offset = (np.arange(len(self.data)) - self.begins[self.owner]) % PERIOD
        return np.flatnonzero(covered[offset] & self.starts(length))

    def reach(self, places: np.ndarray, before: int, after: int) -> np.ndarray:
        """Marks each byte from `before` bytes ahead of a place to `after` bytes behind it, within its document."""
        delta = np.zeros(len(self.data) + 1, np.int32)
        own = self.owner[places]
        np.add.at(delta, np.maximum(places - before, self.begins[own]), 1)
        np.add.at(delta, np.minimum(places + after + 1, self.ends[own]), -1)
        return np.cumsum(delta[:-1]) > 0


def _distinct(ranks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ranks, the first owner of each, and for each input its number among them. Owners ascend with the input."""
    distinct, first, index = np.unique(ranks, return_index=True, return_inverse=True)
    return distinct, owner[first], index


def _bucket_of(ranks: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the leading bits, so that buckets follow one another in rank order."""
    return ((ranks >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _send(chunk: int, ranks: np.ndarray, ids: np.ndarray | None, buckets: int, several: np.ndarray | None = None) -> pa.RecordBatch:
    """The sorted ranks of a unit, cut by bucket: a row for each bucket with its ranks and what goes with them.

    With `several` the ranks are cut to 32 bits below those that name the bucket, enough to find candidates; with `ids`
    they are whole, and ids are written as distances from the smallest of the unit in as few bytes as they need.
    """
    bucket = _bucket_of(ranks, buckets)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    body = (ranks * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32) if ids is None else ranks
    base = 0
    if ids is not None and len(ids):
        base = int(ids.min())
        wide = (ids - base).astype(np.uint64)
        ids = wide.astype(np.min_scalar_type(int(wide.max())))
    rows = [(int(bucket[b]), chunk, base, body[b:e].tobytes(), ids[b:e].tobytes() if ids is not None else b"",
             np.packbits(several[b:e]).tobytes() if several is not None else b"") for b, e in zip(cuts, ends)]
    columns = list(zip(*rows)) if rows else [[], [], [], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "chunk", "base", "ranks", "ids", "several"])


_SENT = "bucket int, chunk int, base bigint, ranks binary, ids binary, several binary"
_TOLD = "bucket int, chunk int, flags binary"


def _ids(row: dict, n: int) -> np.ndarray:
    kind = np.dtype(f"u{len(row['ids']) // n}")
    return np.frombuffer(row["ids"], kind).astype(np.int64) + row["base"]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != bucket:
                yield held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield held


def _rank_buckets(short: bool):
    """Sorts one bucket at a time and answers each unit with a bit for each of its ranks.

    Short ranks: whether the rank ties with another document. Full ranks: whether a smaller id holds it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            parts = [np.frombuffer(r["ranks"], np.uint32 if short else np.uint64) for r in held]
            ranks = np.concatenate(parts)
            order = np.argsort(ranks, kind="stable")
            ordered = ranks[order]
            starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            group = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) - 1
            flags = np.empty(len(ranks), bool)
            if short:
                several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(p)) for r, p in zip(held, parts)])[order]
                tied = np.add.reduceat(several.astype(np.int64) + 1, starts) > 1
                flags[order] = tied[group]
            else:
                ids = np.concatenate([_ids(r, len(p)) for r, p in zip(held, parts)])[order]
                flags[order] = ids > np.minimum.reduceat(ids, starts)[group]
            at = np.cumsum([0, *map(len, parts)])
            yield pa.RecordBatch.from_arrays([
                pa.array([r["bucket"] for r in held], pa.int32()), pa.array([r["chunk"] for r in held], pa.int32()),
                pa.array([np.packbits(flags[at[i]:at[i + 1]]).tobytes() for i in range(len(held))], pa.binary())], ["bucket", "chunk", "flags"])

    return run


def _answers(row: dict, name: str, counts: np.ndarray) -> np.ndarray:
    """The bits of all buckets of a unit in rank order; `counts` is how many ranks it sent to each bucket that it used."""
    told = sorted(row[name] or [], key=lambda x: x["bucket"])
    return np.concatenate([np.unpackbits(np.frombuffer(t["flags"], np.uint8), count=int(n)) for t, n in zip(told, counts)]).astype(bool) \
        if told else np.zeros(0, bool)


def _counts(ranks: np.ndarray, buckets: int) -> np.ndarray:
    return np.unique(_bucket_of(ranks, buckets), return_counts=True)[1]


class _Reader:
    """What a unit asks in each round, computed anew from its texts and the answers so far."""

    def __init__(self, row: dict, buckets: int, length: int):
        ids = np.array(row["ids"], np.int64)
        order = np.argsort(ids, kind="stable")
        self.chunk, self.buckets, self.length = row["chunk"], buckets, length
        self.c = _Chunk(ids[order], [row["texts"][i] for i in order])
        self.row = row
        self.key = length - PERIOD + 1
        self.long = length + PERIOD - 1

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the sample, their distinct ranks, the index of each, and which ranks stand in several documents here."""
        places = self.c.sample(self.key)
        ranks = string_ranks(self.c.data, places, self.key)
        distinct, first, index = _distinct(ranks, self.c.owner[places])
        several = np.zeros(len(distinct), bool)
        several[index[self.c.owner[places] != first[index]]] = True
        return places, distinct, index, several

    def tied(self) -> np.ndarray:
        """Sample places whose suffix ties with another document."""
        places, distinct, index, _ = self.sample()
        flags = _answers(self.row, "cover", _counts(distinct, self.buckets))
        return places[flags[index]] if len(places) else places

    def long_ties(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tied sample places with a whole period behind the string: places, distinct ranks, first ids, index."""
        places = tied[self.c.starts(self.long)[tied]]
        ranks = string_ranks(self.c.data, places, self.long)
        distinct, first, index = _distinct(ranks, self.c.owner[places])
        return places, distinct, first, index

    def settled(self, tied: np.ndarray) -> np.ndarray:
        """Starts that the long ties show to repeat an earlier document: a period of them from each such place."""
        places, distinct, first, index = self.long_ties(tied)
        flags = _answers(self.row, "long", _counts(distinct, self.buckets))
        later = (flags[index] | (self.c.ids[self.c.owner[places]] > self.c.ids[first[index]])) if len(places) else np.zeros(0, bool)
        return self.c.reach(places[later], 0, PERIOD - 1) & self.c.starts(self.length)

    def rest(self, tied: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts near a tie that are not settled: places, distinct ranks, first ids, index."""
        places = np.flatnonzero(self.c.reach(tied, PERIOD - 1, 0) & self.c.starts(self.length) & ~settled)
        ranks = string_ranks(self.c.data, places, self.length)
        distinct, first, index = _distinct(ranks, self.c.owner[places])
        return places, distinct, first, index

    def repeated(self) -> np.ndarray:
        """All starts whose string an earlier document holds."""
        tied = self.tied()
        settled = self.settled(tied)
        places, distinct, first, index = self.rest(tied, settled)
        flags = _answers(self.row, "rest", _counts(distinct, self.buckets))
        if len(places):
            settled[places[flags[index] | (self.c.ids[self.c.owner[places]] > self.c.ids[first[index]])]] = True
        return settled


def _units(docs: DataFrame, first: DataFrame, length: int, chunk_bytes: int) -> tuple[DataFrame, int, str]:
    """(chunk, ids, texts): the distinct texts with their smallest id, in units of about `chunk_bytes`; their bytes; and the name of the table.

    Ids are dealt to units by hash. The texts travel once, together with a mark for each text that counts, and are written as a
    table bucketed by unit, so that the joins with the answers of the rounds move only the answers.
    """
    spark = docs.sparkSession
    sized = first.where(F.col("n_bytes") >= length)
    total = sized.agg(F.sum("n_bytes")).head()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    text = F.encode("text", "UTF-8")
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length(text) >= length)).select(chunk, "doc_id", F.xxhash64("text").alias("key"), text.alias("bytes"))
    marks = sized.select(F.col("first_id").alias("doc_id"), "key").select(chunk, "doc_id", "key", F.lit(None).cast("binary").alias("bytes"))
    n = shuffle_partitions(spark)
    order = ["chunk", "doc_id", "key", F.col("bytes").isNotNull()]
    spread = rows.union(marks).repartition(n, "chunk").sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))],
                                              ["chunk", "ids", "texts"])

        unit, ids, texts, wanted = None, [], [], None
        for batch in batches:
            for own, doc, key, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "doc_id", "key", "bytes"))):
                if own != unit:
                    if ids:
                        yield out()
                    unit, ids, texts, wanted = own, [], [], None
                if data is None:
                    wanted = (doc, key)
                elif wanted == (doc, key):
                    # The first row after its mark; equal rows that follow are the same document.
                    ids.append(doc), texts.append(data)
                    wanted = None
        if ids:
            yield out()

    name = f"suffix_units_{uuid.uuid4().hex}"
    path = stage_path(spark, name)
    spread.mapInArrow(pack, "chunk int, ids array<bigint>, texts array<binary>").write.bucketBy(n, "chunk").option("path", path).saveAsTable(name)
    return spark.table(name), total, name


def _read_units(units: DataFrame, total: int, length: int, bucket_suffixes: int) -> DataFrame:
    """(_id, _sha256, _spans, _removed, _kept) for each text of the units, after the rounds of questions and answers."""
    # A bucket holds a bounded number of suffixes, however many there are; ranks are spread evenly by their making.
    buckets = max(1, -(-total * len(COVER) // (PERIOD * bucket_suffixes)), min(shuffle_partitions(units.sparkSession), 1 + total // (1 << 18)))

    def ask(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    reader = _Reader(batch.slice(k, 1).to_pylist()[0], buckets, length)
                    if name == "cover":
                        _, distinct, _, several = reader.sample()
                        yield _send(reader.chunk, distinct, None, buckets, several)
                        continue
                    tied = reader.tied()
                    if name == "long":
                        _, distinct, owner, _ = reader.long_ties(tied)
                    else:
                        _, distinct, owner, _ = reader.rest(tied, reader.settled(tied))
                    yield _send(reader.chunk, distinct, reader.c.ids[owner], buckets)

        return run

    def answered(name: str, asked: DataFrame) -> DataFrame:
        sent = asked.mapInArrow(ask(name), _SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        answers = staged(sent.mapInArrow(_rank_buckets(name == "cover"), _TOLD))
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias(name))

    known = units
    for name in ("cover", "long", "rest"):
        known = known.join(answered(name, known), "chunk", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reader = _Reader(batch.slice(k, 1).to_pylist()[0], buckets, length)
                c = reader.c
                covered = c.reach(np.flatnonzero(reader.repeated()), 0, length - 1)
                data, out = c.data.tobytes(), []
                for doc, b, e in zip(c.ids.tolist(), c.begins.tolist(), c.ends.tolist()):
                    edge = np.flatnonzero(np.diff(covered[b:e].astype(np.int8), prepend=0, append=0)).tolist()
                    runs = list(zip(edge[0::2], edge[1::2]))
                    at, parts = b, []
                    for begin, end in runs:
                        parts.append(data[at:b + begin])
                        at = b + end
                    kept = b"".join([*parts, data[at:e]])
                    out.append((doc, hashlib.sha256(data[b:e]).hexdigest(), [{"start": x, "end": y} for x, y in runs], e - b - len(kept), hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["_id", "_sha256", "_spans", "_removed", "_kept"])

    return known.mapInArrow(cut, "_id bigint, _sha256 string, _spans array<struct<start:bigint,end:bigint>>, _removed bigint, _kept string")


def deduplicate(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """Per row of `docs`: doc_id, text_key, n_bytes, spans (removed runs [start, end) of bytes), n_removed, n_spans, kept_sha256.

    A byte is removed if a string of `length` bytes over it also starts in a document with a smaller doc_id. Strings do not cross
    documents, overlaps count, and strings are judged on the input. A text that several documents hold is read once,
    for the smallest id; for the others the whole text is a run. Texts shorter than `length` lose nothing.

    Null and empty texts have no bytes. Rows without id are left as they are and take nothing from others. Rows that share id and
    text get equal results; with one id on several texts, each is judged against smaller ids. Empty input gives an
    empty result. Only doc_id and text are read.
    """
    with scratch(docs.sparkSession) as keep:
        text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
        told = keep(docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.xxhash64("text").alias("key"), F.octet_length(text).cast("long").alias("n_bytes")))
        first = keep(told.where("doc_id is not null").groupBy("text_sha256").agg(
            F.min("doc_id").alias("first_id"), F.first("key").alias("key"), F.first("n_bytes").alias("n_bytes")))
        units, total, table = _units(docs, first, length, chunk_bytes)
        try:
            read = keep(_read_units(units, total, length, bucket_suffixes))
        finally:
            docs.sparkSession.sql(f"drop table if exists {table}")
    joined = told.join(first.select("text_sha256", "first_id"), "text_sha256", "left")
    joined = joined.join(read, (F.col("doc_id") == F.col("_id")) & (F.col("text_sha256") == F.col("_sha256")), "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= length), F.lit(False))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    out = joined.select(
        "doc_id", F.col("key").alias("text_key"), "n_bytes", F.when(copy, whole).otherwise(F.coalesce("_spans", none)).alias("spans"),
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept", "text_sha256")).alias("kept_sha256"))
    return out.withColumn("n_spans", F.size("spans").cast("long"))


def kept_texts(docs: DataFrame, **settings) -> DataFrame:
    """`docs` with `kept` (binary): the bytes of each text that `deduplicate` leaves, which may cut a character; null for null text."""
    names = [c for c in docs.columns if c != "kept"]
    told = deduplicate(docs, **settings).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_key"])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    joined = packed.join(told, packed["_doc"].eqNullSafe(told["_id"]) & (packed["_text"] == told["_key"]), "left")
    joined = joined.withColumn("_data", F.encode(F.col("_row")["text"], "UTF-8"))
    data = F.col("_data")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["end"]))
    pieces = F.transform(ends, lambda at, i: F.substring(data, at.cast("int") + 1, (F.coalesce(F.get("_spans", i)["start"], F.octet_length(data).cast("long")) - at).cast("int")))
    kept = F.aggregate(pieces, F.lit(b""), lambda a, piece: F.concat(a, piece))
    told = joined.withColumn("_kept", F.when(data.isNotNull(), kept))
    return told.select(*[F.col("_row")[c].alias(c) for c in names], F.col("_kept").alias("kept"))
