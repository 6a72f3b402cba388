"""A quality classifier of supervised subword embeddings.

A document is a bag of features: its words, their character n-grams, the pairs of
equal adjacent words, and one mark for the end.  Each is hashed to a bucket with a
learned vector.  The vectors are averaged over all features of the whole text and a
softmax of two classes is put on top; numpy stochastic gradient descent on a bounded
sample of labelled rows learns both.

The softmax of an average is linear below the exponential, so for scoring every
bucket is reduced to the number it adds to the difference of the classes.  That is
the same score, for one number a feature in place of a vector.

Rows: null and empty texts have the end mark alone and get its score; repeated rows
each get a line; a null key is never held out and never learned from; rows without a
label of 0 or 1 are not learned from; without labels the score is a half; an empty
table gives an empty table.  Columns named like an output column are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.llm.tables import set_aside, written
from couponlab.llm.word_cache import TwoGenerations

#: Buckets of the hashed features, numbers of a vector, lengths of the n-grams.
BUCKETS = 1 << 16
DIMENSIONS = 8
LENGTHS = (3, 4, 5)
#: Labelled rows to learn from at most: those of the smallest hash of the key.  Their bags go to the driver.
SAMPLE = 4000
EPOCHS = 6
RATE = 0.5
SEED = 7
#: The score from which a document counts as good.
THRESHOLD = 0.3
#: Words remembered in each Python worker.
CACHE_WORDS = 600_000
OUTPUT = ("score", "predicted")
#: How the numbers of buckets are packed.
_NUMBER = np.min_scalar_type(BUCKETS - 1)
_END, _REPEAT = crc32(b"\0end") % BUCKETS, crc32(b"\0repeat") % BUCKETS


def word_buckets(word: str) -> list[int]:
    """The word and its n-grams, the edges marked."""
    data = b"<" + word.encode("utf-8") + b">"
    out = [crc32(data) % BUCKETS]
    for n in LENGTHS:
        out += [crc32(data[i : i + n]) % BUCKETS for i in range(len(data) - n + 1)]
    return out


def _repeats(words: list[str]) -> int:
    return sum(map(eq, words, islice(words, 1, None)))


def bag(text: str | None) -> Counter:
    """How often each bucket occurs in the text."""
    words, out = (text or "").split(), Counter({_END: 1})
    for word, times in Counter(words).items():
        for bucket in word_buckets(word):
            out[bucket] += times
    repeats = _repeats(words)
    if repeats:
        out[_REPEAT] += repeats
    return out


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], seed: int = SEED) -> np.ndarray:
    """What each bucket adds to the difference of the classes, and last the bias.

    ``bags``: buckets, their shares of the bag, and the class, for each document.
    """
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(bags)):
            buckets, shares, label = bags[i]
            rate = RATE * (1 - done / steps)
            hidden = shares @ vectors[buckets]
            scores = weights @ hidden + bias
            wrong = np.exp(scores - scores.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = weights.T @ wrong
            weights -= rate * np.outer(wrong, hidden)
            bias -= rate * wrong
            # Shares are small; by their greatest the step keeps the size it has for a single word.
            vectors[buckets] -= rate * np.outer(shares / shares.max(), back)
            done += 1
    return np.append(vectors @ (weights[1] - weights[0]), bias[1] - bias[0])


class Scorer:
    """Scores texts in one Python worker."""

    def __init__(self, model: np.ndarray):
        adds, self._bias = model[:-1], float(model[-1])
        self._end, self._repeat = float(adds[_END]), float(adds[_REPEAT])

        def of(word: str) -> complex:
            # The real part adds up the numbers, the imaginary part counts the features.
            buckets = word_buckets(word)
            return complex(float(adds[buckets].sum()), len(buckets))

        self._of = TwoGenerations(of, CACHE_WORDS)

    def __call__(self, text: str | None) -> float:
        words = (text or "").split()
        both = sum(map(self._of.__getitem__, words), 0j)
        repeats = _repeats(words)
        total = both.real + self._end + repeats * self._repeat
        difference = total / (both.imag + 1 + repeats) + self._bias
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, difference))))


def held_out(key: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def training_bags(documents: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> list:
    """The bags of the sample, made by the executors; at most ``sample`` rows of at most ``BUCKETS`` numbers reach the driver."""
    usable = labels.where(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col("quality").isin(0, 1))
    order = [F.xxhash64(key), F.col(key), F.col("label")]
    chosen = usable.select(key, F.col("quality").cast("int").alias("label")).distinct().orderBy(*order).limit(sample)

    def packed(text):
        made = bag(text)
        counts = np.fromiter(made.values(), np.int64, len(made))
        return np.fromiter(made, _NUMBER, len(made)).tobytes(), (counts / counts.sum()).astype(np.float32).tobytes()

    def run(batches):
        for batch in batches:
            buckets, shares = zip(*(packed(v.as_py()) for v in batch.column("text"))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())],
                names=["key", "label", "buckets", "shares"],
            )

    texts = documents.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key)
    schema = "key bigint, label int, buckets binary, shares binary"
    rows = texts.select(F.col(key).cast("bigint").alias("key"), "label", "text").mapInArrow(run, schema)
    # Made side by side, then fetched a partition at a time: the driver never holds the bags twice.
    table = written(rows.withColumn("place", F.xxhash64("key")), "bags")
    first: list = []
    for at, row in enumerate(table.toLocalIterator()):
        one = (-row["place"], -row["key"], -row["label"], -at, row["buckets"], row["shares"])
        # A key may have several texts; the last of the order goes.
        heapq.heappush(first, one) if len(first) < sample else heapq.heappushpop(first, one)
    first.sort(reverse=True)
    return [(np.frombuffer(b, _NUMBER), np.frombuffer(s, np.float32), -label) for _, _, label, _, b, s in first]


def score(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents with ``score`` (higher: class 1 is likelier) and ``predicted``."""
    bags = training_bags(documents, labels, key, text, sample)
    model = train(bags) if bags else np.zeros(BUCKETS + 1)
    shared = documents.sparkSession.sparkContext.broadcast({"model": model})
    kept = documents.drop(*OUTPUT)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        state = shared.value
        scorer = state.get("scorer") or state.setdefault("scorer", Scorer(state["model"]))
        for batch in batches:
            made = pa.array([scorer(v.as_py()) for v in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not rejected."""
    own, back = set_aside(documents, *OUTPUT)
    return score(own, labels, key, text).where("predicted = 1").select(*back)


def op9_quality(spark, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels of rows that are not held out."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    scored = score(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
