"""Language identification: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.session import staged

#: Labelled documents used to fit at most, for each language, those with the smallest hash of their text.
SAMPLE = 400
#: Landmarks for each language, the first of the sample.
LANDMARKS = 24
#: Lengths in bytes of the n-grams, and the slots into which they are hashed.
LENGTHS = (1, 2, 3, 4)
SLOTS = 1 << 13
#: Bytes of a piece at most: its n-grams fill well under half of the slots. Longer texts are the mean of their pieces.
PIECE = 1 << 12
RIDGE = 1e-3
#: Texts that one matrix product scores.
ROWS = 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(31).integers(0, 2**32, (max(LENGTHS), 256), dtype=np.uint32)


class Model(NamedTuple):
    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def has_letter(text: str) -> bool:
    """Whether a character of one of Unicode's letter categories stands in the text, as the pattern \\p{L} of the sample."""
    return any(map(str.isalpha, text))


def presence(texts: list[bytes], slots: int = SLOTS) -> np.ndarray:
    """A row of length 1 for each whole text: which hashed n-grams of any of LENGTHS stand in it. A-Z are lower-cased.

    A text is cut into equal pieces of at most PIECE bytes, with the n-grams over each cut; its row is the mean of the rows of 0
    and 1 of the pieces, each of length 1. So no row is filled by the length of its text.
    """
    out = np.zeros((len(texts), slots), np.float32)
    shift = np.uint32(32 - slots.bit_length() + 1)
    mark = np.zeros(slots, np.float32)
    for row, text in zip(out, texts):
        pieces = max(1, -(-len(text) // PIECE))
        ends = [len(text) * i // pieces for i in range(pieces + 1)]
        for begin, end in zip(ends, ends[1:]):
            data = _LOWER[np.frombuffer(text, np.uint8, min(len(text), end + max(LENGTHS) - 1) - begin, begin)] if text else _LOWER[:0]
            mark.fill(0)
            sums = None
            for k in range(max(LENGTHS)):
                if len(data) <= k:
                    break
                part = _TABLE[k][data[k:]]
                sums = part if sums is None else sums[:len(part)] * np.uint32(0x9E3779B1) + part
                if k + 1 in LENGTHS:
                    mark[(sums * np.uint32(0x85EBCA6B)) >> shift] = 1
            row += mark / np.sqrt(max(mark.sum(), 1))
        row /= max(np.sqrt(row @ row), 1e-9)
    return out


def _kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Of pieces, shared n-grams divided by the geometric mean of both counts; of longer texts the mean over their pieces, normalised."""
    return rows @ landmarks.T


def fit(texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression of +1 / -1 for each language on the Nystroem features of the landmarks; None without texts."""
    names = sorted(set(langs))
    if not names:
        return None
    x = presence(texts)
    chosen = [i for name in names for i in [i for i, v in enumerate(langs) if v == name][:landmarks]]
    marks = x[chosen]
    # K_mm^(-1/2) turns similarities to landmarks into features whose inner products approximate the kernel.
    values, vectors = np.linalg.eigh(_kernel(marks, marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = _kernel(x, marks) @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Each language has the same say, however many of its texts are in the sample.
    share = np.array([1.0 / langs.count(v) for v in langs])[:, None] * len(langs) / len(names)
    mean_f, mean_t = (share * features).sum(0) / share.sum(), (share * target).sum(0) / share.sum()
    centred = features - mean_f
    gram = centred.T @ (share * centred) + ridge * len(langs) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, centred.T @ (share * (target - mean_t)))
    return Model(names, marks, (root @ solved).astype(np.float32), (mean_t - mean_f @ solved).astype(np.float32))


def train_on(docs: DataFrame, sample: int = SAMPLE, **settings) -> Model | None:
    """A model from at most `sample` texts for each value of `lang`, chosen by the hash of the text.

    Rows without text, letter or lang are not used. Only text and lang are read. Each language gives `sample` texts, or all its
    distinct texts if they are fewer, however often some are repeated. Hashes are made distinct on all tasks and thinned
    before they are ordered, so one very common language does not gather in one task; texts are read for the chosen ones only.
    """
    from pyspark.sql import Window

    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    keyed = usable.select("lang", F.xxhash64("text").alias("key"), "text")
    keys = staged(keyed.select("lang", "key").distinct())
    # Hashes are uniform: the share that holds `sample` texts of a language, with room, bounds what is sorted afterwards.
    limits = keys.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * sample + 100) / F.count(F.lit(1))).alias("limit"))
    near = keys.join(F.broadcast(limits), "lang").where((F.col("key") / F.lit(2.0**64) + F.lit(0.5)) <= F.col("limit"))
    chosen = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("place") <= sample)
    placed = keyed.join(F.broadcast(chosen.select("lang", "key", "place")), ["lang", "key"]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    found = sorted((r["lang"], r["place"], r["text"]) for r in placed.collect())
    return fit([text.encode() for _, _, text in found], [lang for lang, _, _ in found], **settings)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred and score, from the text alone, by batched matrix products over the whole texts.

    `score` is the softmax share of the best language, in 0 to 1. Texts that are null, empty or without a letter get `und` and
    0, as does everything when there was nothing to learn from. Columns lang_pred and score of `docs` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            usable = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
            for at in range(0, len(usable), ROWS):
                some = usable[at:at + ROWS]
                similar = _kernel(presence([texts[i].encode() for i in some]), model.landmarks)
                told = similar @ model.weights + model.offset
                power = np.exp(2 * (told - told.max(axis=1, keepdims=True)))
                for i, best, share in zip(some, told.argmax(axis=1), power.max(axis=1) / power.sum(axis=1)):
                    langs[i], scores[i] = model.langs[best], float(share)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
