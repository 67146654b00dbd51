"""Quality classifier: logistic regression on hashed word n-grams.

Words are runs of characters other than white space. Three streams are hashed
into one space of 2**BITS features: the words themselves (1- and 2-grams), their
shapes (1- to 3-grams; a shape is the sequence of character classes without
repetition, other characters standing for themselves), and whether a word equals
the one before it. A document's vector holds the features' frequencies, scaled
to length 1. Weights are learned by follow-the-regularised-leader updates
(FTRL-proximal) and a score is a sparse dot product put through the logistic
function.

Training takes at most `TRAIN_ROWS` labelled rows, those with the smallest hash
of their id; the bound is a parameter. Everything else covers all rows.

Null and empty texts: no features, the score is the intercept's. Labels of a
document that has several: the smallest counts. Of rows that share a doc_id with
different texts one is learned from, always the same. Without labels, or with labels
of one kind, every weight but the intercept may stay 0. Repeated rows are
scored one by one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

BITS = 18
TRAIN_ROWS = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.3
_U = np.uint64


class Streams:
    """Hashes of words and shapes, kept for words that come again."""

    def __init__(self, most: int = 200_000):
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.word = np.zeros(1024, np.uint64)
        self.shape = np.zeros(1024, np.uint64)

    @staticmethod
    def shape_of(word: str) -> str:
        out, last = [], ""
        for c in word:
            kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
            if kind != last:
                out.append(kind)
                last = kind
        return "".join(out)

    def add(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if not new:
            return
        first = len(self.number)
        while first + len(new) > len(self.word):
            self.word = np.concatenate([self.word, np.zeros_like(self.word)])
            self.shape = np.concatenate([self.shape, np.zeros_like(self.shape)])
        for i, w in enumerate(new, first):
            self.number[w] = i
            self.word[i] = hash_text(w)
            self.shape[i] = hash_text("\0" + self.shape_of(w))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features in order and their values."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.number) > self.most:
            self._reset()
        try:
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.add(words)
            at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        w, s = self.word[at], self.shape[at]
        parts = [w, s]
        if len(at) > 1:
            parts += [w[:-1] * _U(3) + w[1:] * _U(5), s[:-1] * _U(7) + s[1:] * _U(11), np.where(at[1:] == at[:-1], _U(0x51ED270B), _U(0x2545F491))]
        if len(at) > 2:
            parts.append(s[:-2] * _U(13) + s[1:-1] * _U(17) + s[2:] * _U(19))
        slots = (mix64(np.concatenate(parts)) >> _U(64 - BITS)).astype(np.int64)
        slots.sort()
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        counts = np.diff(np.append(first, len(slots))).astype(np.float64)
        return slots[first].astype(np.int32), (counts / np.sqrt((counts * counts).sum())).astype(np.float32)


def hash_text(s: str) -> int:
    """FNV-1a over the UTF-8 bytes, 64 bits."""
    h = 0xCBF29CE484222325
    for b in s.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def train_ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of features and, last, of the intercept, which is not regularised."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)

    def weights(slots: np.ndarray) -> np.ndarray:
        zs = z[slots]
        out = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[slots])) / ALPHA + L2)
        out[np.abs(zs) <= L1] = 0
        return out

    order = np.arange(len(examples))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            y, slots, values = examples[k]
            own = weights(slots)
            bias = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(own @ values + bias, -35, 35)))
            g = (p - y) * values
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / ALPHA
            z[slots] += g - step * own
            n[slots] += g * g
            g0 = p - y
            z[-1] += g0 - (np.sqrt(n[-1] + g0 * g0) - np.sqrt(n[-1])) / ALPHA * bias
            n[-1] += g0 * g0
    w[:-1] = weights(np.arange(size - 1))
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return w


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most `rows` labelled documents outside the held-out fold."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )  # at most `rows` ids and labels: safe to broadcast

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = Streams()
        for batch in batches:
            got = [streams.vector(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
                names=["doc_id", "quality", "slots", "features"],
            )

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        w = train_ftrl([(int(y), np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for y, s, v in zip(frame.quality, frame.slots, frame.features)])
        used = np.flatnonzero(w).astype(np.int32)
        return pd.DataFrame({"slots": [used.tobytes()], "weights": [w[used].astype(np.float32).tobytes()]})

    examples = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
        .mapInArrow(vectors, "doc_id long, quality int, slots binary, features binary")
        .groupBy("doc_id", "quality")  # of rows that share an id, however many, the same one each time
        .agg(F.min(F.struct("slots", "features")).alias("_least"))
        .select("doc_id", "quality", "_least.slots", "_least.features")
    )
    got = examples.groupBy(F.lit(1).alias("all")).applyInPandas(learn, "slots binary, weights binary").collect()
    w = np.zeros((1 << BITS) + 1, np.float32)
    for row in got:
        w[np.frombuffer(row.slots, np.int32)] = np.frombuffer(row.weights, np.float32)
    return w


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """`_row`, all columns of a row, and its `score`. The weights are at most 2**BITS + 1 numbers of 4 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams, own = Streams(), shared.value.astype(np.float64)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(0).field("text")):
                slots, values = streams.vector(t.as_py())
                scores[i] = own[slots] @ values + own[-1]
            scores = 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["_row", "score"])

    return given.mapInArrow(run, f"_row {given.schema['_row'].dataType.simpleString()}, score double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, w).select("_row.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    w = fit(docs, labels)
    return score(docs, w).filter(F.col("score") >= THRESHOLD).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
