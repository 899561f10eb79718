"""Quality scores: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text becomes a sparse vector: counts of hashed word unigrams and bigrams and of bigrams of
word shapes (case, length, kind of character), damped by a square root and scaled to unit
length. Training visits a bounded sample of labelled rows in a fixed order with
follow-the-regularised-leader updates; scoring is one sparse dot product per text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.bpe import Memo
from meterframe.llm.common import doc_remainder, map_batches, texts

BITS = 20
SAMPLE_ROWS = 8_192  # bound on the labelled rows that training reads
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
MEMO = 150_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """Case, rough length and kind of a token, e.g. `Aa3`, `A2`, `99`, `**`."""
    first = word[0]
    if first == "\n":
        return first
    if first.isalpha():
        kind = "A" if len(word) > 1 and word.isupper() else "Aa" if first.isupper() else "a"
        return f"{kind}{min(len(word), 20) // 4}"
    return ("9" if first.isdigit() else first) * min(len(word), 4)


def _codes(word: str) -> int:
    """Hash of the word in the upper, of its shape in the lower 32 bits."""
    return zlib.crc32(word.encode("utf-8")) << 32 | zlib.crc32(shape(word).encode("utf-8"))


class Features:
    """Sparse unit vectors of texts; words are hashed once per memo."""

    def __init__(self, bits: int = BITS):
        self.codes = Memo(_codes, MEMO, 64)
        self.shift = np.uint64(64 - bits)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values); a text without words has none."""
        words = WORDS.findall(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))
        word = codes >> np.uint64(32)
        form = codes & np.uint64(0xFFFFFFFF)
        kinds = (
            word,
            (word[:-1] * np.uint64(31) + word[1:]) ^ np.uint64(1 << 60),
            (form[:-1] * np.uint64(37) + form[1:]) ^ np.uint64(1 << 61),
        )
        slots = (np.concatenate(kinds) * PRIME) >> self.shift
        slots.sort()
        starts = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        counts = np.diff(np.append(starts, len(slots)))
        values = np.sqrt(counts)
        return slots[starts].astype(np.int64), values / np.sqrt(counts.sum())


class Ftrl:
    """FTRL-proximal logistic regression; the last weight is the bias."""

    def __init__(self, size: int):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, indices: np.ndarray, values: np.ndarray, label: int) -> float:
        at = np.append(indices, len(self.z) - 1)
        x = np.append(values, 1.0)
        w = self.weights(at)
        p = probability(float(w @ x))
        g = (p - label) * x
        grown = self.n[at] + g * g
        sigma = (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = grown
        return p


def probability(score: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(score, -35.0), 35.0)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    model = Ftrl(1 << bits)
    for epoch in range(epochs):
        for indices, values, label in rows if epoch % 2 == 0 else reversed(rows):
            model.learn(indices, values, label)
    return model.weights()


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from at most `sample_rows` labelled rows outside the held-out fold.

    The sample takes the labels in the order of a hash of their id. Labels that are not 0 or 1
    or have no id are left out; without any label the model is zero (score 0.5). A labelled id that
    several documents have counts once, with the smallest of its texts. The features
    are made where the texts are; one task runs the updates over the bounded sample.
    """
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.filter(doc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = rows.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            vectors = [features(t) for t in texts(batch)]
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([v[0] for v in vectors], pa.list_(pa.int64())),
                pa.array([v[1] for v in vectors], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "slots", "amounts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for i in range(batch.num_rows):
                slots, amounts = batch.column(2)[i].values, batch.column(3)[i].values
                examples.append((slots.to_numpy(), amounts.to_numpy(), batch.column(1)[i].as_py()))
        packed = train(examples).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["weights"])

    vectors = map_batches(
        found.select("doc_id", "text", "quality"),
        featurize,
        "doc_id bigint, quality int, slots array<bigint>, amounts array<double>",
    )
    ordered = vectors.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("slots"))
    learned = map_batches(ordered, learn, "weights binary").collect()
    if not learned:  # Spark skips the task when no row can come
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.frombuffer(learned[0]["weights"], np.float32)


def score(
    documents: DataFrame, weights: np.ndarray, keep: list[str] | None = None, name: str = "score"
) -> DataFrame:
    """The columns `keep` (default: doc_id) plus `name`, the probability of label 1.

    Null texts score as empty ones: the bias alone. One result row per input row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    kept = keep or ["doc_id"]
    rows = documents.select(documents["text"].alias("__text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value
        for batch in batches:
            scores = []
            for text in texts(batch, "__text"):
                slots, amounts = features(text)
                scores.append(probability(float(w[slots] @ amounts) + float(w[-1])))
            columns = [*(batch.column(i + 1) for i in range(len(kept))), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return map_batches(rows, run, f"{kinds}, `{name}` double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of `documents`: doc_id, held_out, score (0 to 1) and predicted (score >= 0.7).

    Null texts count as empty, null ids are passed on (their fold is that of the empty text),
    repeated rows are scored each. Only doc_id and text are read.
    """
    scored = score(documents, fit(documents, labels))
    return scored.select(
        "doc_id",
        (doc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
