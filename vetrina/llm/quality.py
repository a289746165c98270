"""Document quality by a factorisation machine.

Features of a whole text: its words, hashed to ``1 << WORD_BITS`` buckets and
scaled to length one; structure statistics (shares of character kinds, word
and line shapes, repetition) and metadata (n_chars), each as one of BINS
quantile bins. The score is the logistic function of

    bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

which counts every pairwise interaction of features in time linear in their
number. The machine is trained in numpy on the driver by minibatch Adam, on
``FIT_ROWS`` labelled rows at most: those with the smallest hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.langid import held_out
from vetrina.llm.text import SPACED, Words, chunks, small_batches, utf8

WORD_BITS = 15
BINS = 12
RANK = 8
FIT_ROWS = 8000
STEPS = 400
THRESHOLD = 0.7

# kinds of bytes
_KINDS = np.full(256, 9, dtype=np.int64)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 0, 1, 2, 3
for _i, _chars in enumerate((b" ", b"\n", b".,;:'", b"|", b"#$%&*@^~<>{}[]=_/\\"), start=4):
    _KINDS[list(_chars)] = _i
N_KINDS = 10


def statistics(data: np.ndarray, offsets: np.ndarray, words: Words, n_chars: np.ndarray) -> np.ndarray:
    """(texts, statistics): structure of each text, and its n_chars."""
    n, size = len(offsets) - 1, np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    kind = np.bincount(of * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    count = words.count.astype(float)
    text = words.text_of()

    def share(x: np.ndarray, of_: np.ndarray) -> np.ndarray:
        return x / np.maximum(of_, 1)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(text, x, minlength=n)

    length = (words.end - words.start).astype(float)
    again = np.zeros(len(text))
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((words.hash, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (text[order][1:] != text[order][:-1])
    first = np.flatnonzero(new)
    often = np.zeros(n)
    np.maximum.at(often, text[order][first], np.diff(np.append(first, len(order))))
    mean = share(per_text(length), count)
    # words that end in a symbol or !, that have capitals only
    last = _KINDS[data[words.end - 1]] if len(text) else np.zeros(0, np.int64)
    head = _KINDS[data[words.start]] if len(text) else np.zeros(0, np.int64)
    second = _KINDS[data[np.minimum(words.start + 1, np.maximum(words.end - 1, 0))]] if len(text) else np.zeros(0, np.int64)
    letters = kind[:, 0] + kind[:, 1] + kind[:, 3]
    columns = [np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(share(per_text(length ** 2), count) - mean ** 2, 0)),
               share(kind[:, 0], letters), *(share(kind[:, k], size) for k in (2, 3, 5, 6, 7, 8, 9)),
               share(per_text(again), count), share(per_text(new[np.argsort(order)].astype(float)), count), share(often, count),
               share(per_text((last >= 8).astype(float)), count), share(per_text(((head == 0) & (second == 0) & (length > 1)).astype(float)), count),
               share(per_text((last == 6).astype(float)), count), share(kind[:, 5] + 1, count), share(per_text((length == 1).astype(float)), count),
               np.log1p(np.maximum(n_chars, 0))]
    return np.stack(columns, axis=1) if n else np.zeros((0, N_STATS))


N_STATS = 21


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of buckets of each text, buckets, values): distinct buckets of
    each text, valued by count and scaled to length one."""
    key = words.text_of() << WORD_BITS | (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    text = key >> WORD_BITS
    n = np.bincount(text, minlength=len(words.count))
    norm = np.sqrt(np.bincount(text, count.astype(float) ** 2, minlength=len(words.count)))
    return n, (key & ((1 << WORD_BITS) - 1)).astype(np.int32), (count / norm[text]).astype(np.float32)


class Machine:
    """The factorisation machine over word buckets and binned statistics."""

    def __init__(self, edges: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.edges = edges  # (statistics, BINS - 1)
        self.size = (1 << WORD_BITS) + len(edges) * (BINS + 1)
        self.bias = np.zeros(1)
        self.w = np.zeros(self.size)
        self.v = rng.normal(0, 0.02, (self.size, RANK))

    def rows(self, n: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first, feature, value) of rows that have their statistics' bins
        behind their words; each row has as many statistics, so none is empty."""
        k = len(self.edges)
        width = n + k
        first = np.cumsum(width) - width
        feature = np.empty(int(width.sum()), dtype=np.int64)
        x = np.ones(len(feature))
        stat_at = (first + n)[:, None] + np.arange(k)
        binned = np.stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, np.nan_to_num(stats, nan=-1).T, strict=True)], axis=1)
        binned[np.isnan(stats)] = BINS
        words = np.ones(len(feature), dtype=bool)
        words[stat_at] = False
        feature[stat_at] = (1 << WORD_BITS) + np.arange(k) * (BINS + 1) + binned
        feature[words], x[words] = bucket, value
        x[stat_at] = 1 / np.sqrt(k)
        return first, feature, x

    def margin(self, first: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin, sums of v x) of each row."""
        vx = self.v[feature] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        pairs = 0.5 * ((sums ** 2).sum(axis=1) - np.add.reduceat((vx ** 2).sum(axis=1), first))
        return self.bias[0] + np.add.reduceat(self.w[feature] * x, first) + pairs, sums

    def score(self, first: np.ndarray, feature: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(first, feature, x)[0], -500, 500)))

    def fit(self, n: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, y: np.ndarray,
            steps: int = STEPS, batch: int = 200, rate: float = 0.02, decay: float = 1e-5, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        offsets = np.concatenate(([0], np.cumsum(n)))
        params = {"bias": self.bias, "w": self.w, "v": self.v}
        mean = {k: np.zeros_like(p) for k, p in params.items()}
        square = {k: np.zeros_like(p) for k, p in params.items()}
        order = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(y))
            pick, order = order[:batch], order[batch:]
            at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in pick])
            first, feature, x = self.rows(n[pick], bucket[at], value[at], stats[pick])
            margin, sums = self.margin(first, feature, x)
            err = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[pick]) / len(pick)
            row = np.repeat(np.arange(len(pick)), np.diff(np.append(first, len(feature))))
            ex = err[row] * x
            grad = {"bias": np.array([err.sum()]), "w": np.bincount(feature, ex, minlength=self.size), "v": np.zeros_like(self.v)}
            np.add.at(grad["v"], feature, ex[:, None] * (sums[row] - self.v[feature] * x[:, None]))
            for k, p in params.items():
                g = grad[k] + decay * p
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                p -= rate * (1 - 0.9 * step / steps) * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)


def _of_batch(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    words = Words(data, offsets, SPACED)
    n_chars = batch.column("n_chars").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return word_features(words), statistics(data, offsets, words, n_chars)


_FEATURES = "y double, bucket array<int>, value array<float>, stats array<double>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        (n, bucket, value), stats = _of_batch(batch)
        cuts = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.ListArray.from_arrays(cuts, pa.array(bucket)), pa.ListArray.from_arrays(cuts, pa.array(value)),
             pa.array(list(stats), pa.list_(pa.float64()))], names=["y", "bucket", "value", "stats"])


def train(n: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Machine:
    known = np.where(np.isnan(stats), np.nanmedian(np.vstack((stats, np.zeros(stats.shape[1]))), axis=0), stats)
    edges = np.quantile(known, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(y) else np.zeros((N_STATS, BINS - 1))
    machine = Machine(edges)
    if not len(y):
        machine.v[:] = 0
    else:
        machine.bias[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        machine.fit(n, bucket, value, stats, y, steps)
    return machine


def learn(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, steps: int = STEPS) -> Machine:
    """A machine for ``docs(doc_id, text, n_chars)`` from
    ``labels(doc_id, quality)``; held-out ids are left out, as are null
    labels. Features of ``rows`` labelled rows at most reach the driver."""
    small_batches(docs.sparkSession)
    known = (labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0))
             .distinct().orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "y").limit(rows))
    picked = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id").drop("doc_id")
    found = picked.mapInArrow(_features, _FEATURES).orderBy(F.xxhash64("bucket", "y")).limit(2 * rows).toArrow().combine_chunks()

    def flat(name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in found.column(name).chunks)])

    n = np.diff(np.concatenate([[0], *(np.cumsum(c.value_lengths().to_numpy()) for c in found.column("bucket").chunks)])).astype(np.int64) if found.num_rows else np.zeros(0, np.int64)
    return train(n, flat("bucket").astype(np.int64), flat("value"), flat("stats").reshape(-1, N_STATS), found.column("y").to_numpy(), steps)


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, stats = _of_batch(batch)
            score = machine.score(*machine.rows(*features, stats))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("text", "n_chars")), pa.array(score)],
                                             names=[*(c for c in batch.schema.names if c not in ("text", "n_chars")), "score"])
    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row of ``docs(doc_id, text, n_chars)``: doc_id, held_out, score
    (0 to 1, higher: better), predicted (1 if score >= THRESHOLD, else 0).

    Null and empty texts are scored by their structure; a null n_chars has a
    bin of its own; without labels every score is 0.5. Repeated rows each get
    their row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", "n_chars")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_score(machine), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _keep(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            features, stats = _of_batch(batch)
            yield batch.filter(pa.array(machine.score(*machine.rows(*features, stats)) >= THRESHOLD))
    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(_keep(machine), docs.schema)
