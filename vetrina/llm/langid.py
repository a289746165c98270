"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent 1- to 3-character
n-grams, counted over the whole text of all its training documents. A text's
own most frequent n-grams are ranked the same way, and the language whose
profile is nearest by out-of-place distance wins: the sum of rank differences,
with the profile's length for n-grams it doesn't have.

Only letters count: a text is lower-cased, its runs of letters are words, and
each word has one space on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm.text import chunks, small_batches

#: N-grams in a language's and in a text's profile.
PROFILE = 400
LONGEST = 3
UNKNOWN = "und"

_BMP_LETTER = np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(1 << 16)])
#: Code points of a text that are counted at once.
PIECE = 1 << 20


def _points(text: str) -> np.ndarray:
    """Lower-cased code points, with one space for each run of other than letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _BMP_LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        letter[i] = chr(points[i]).isalpha()
    out = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.int64)
    return out[np.concatenate(([True], (out[1:] != 32) | (out[:-1] != 32)))]


def grams(points: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Codes (21 bits a character) of all n-grams, of the first ``starts``
    positions alone if given. Spaces stand only at an n-gram's ends."""
    out = [points[:starts][points[:starts] != 32]]
    for n in range(2, LONGEST + 1):
        parts = [points[i:max(len(points) - n + 1 + i, 0)] for i in range(n)]
        code, good = parts[0], (parts[0] != 32) | (parts[1] != 32)
        for i in range(1, n):
            code = code << 21 | parts[i]
            if i < n - 1:
                good &= parts[i] != 32
        out.append(code[:starts][good[:starts]])
    return np.concatenate(out)


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, by pieces of a very long text."""
    parts = [np.unique(grams(points[s:s + PIECE + LONGEST - 1], PIECE), return_counts=True) for s in range(0, max(len(points), 1), PIECE)]
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams by rank; ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(_points(text))
        for lang, texts in by.items():
            codes, counts = counted(np.concatenate(texts))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                                             names=["lang", "gram", "n"])


def learn(labelled: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from ``labelled(text, lang)``, over all its rows with a text
    and a lang. Languages without any letter have no profile. At most
    ``size`` n-grams a language reach the driver."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").select("lang", "gram").toPandas()
    return {lang: x.to_numpy(np.int64) for lang, x in best.groupby("lang")["gram"]}


class Classifier:
    """Out-of-place distances of texts to all profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.rank = np.full((len(self.langs), len(self.codes)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(lang, score): the score is the part of the largest distance
        possible that the text stays below; ties go to the first name."""
        points = _points(text) if text else np.zeros(0, np.int64)
        if not self.langs or not (points != 32).any():
            return UNKNOWN, 0.0
        own = top(*counted(points), self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where(self.codes[at] == own, self.rank[:, at], -1)
        apart = np.where(rank >= 0, np.minimum(np.abs(rank - np.arange(len(own))), self.size), self.size).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(own)))


def _predict(profiles: dict[str, np.ndarray], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(profiles, size)
        for batch in chunks(batches, "text"):
            found = [classifier.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def held_out():
    """Documents that no model learns from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Per row of ``docs(doc_id, text, lang)``: doc_id, held_out, lang_pred,
    score. Learns from rows that aren't held out, predicts all.

    ``und`` with score 0 for a null text, one without any letter, and where
    there is nothing to learn from. Repeated rows each get their row; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    profiles = learn(rows.where("not held_out"), size)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.drop("lang").mapInArrow(_predict(profiles, size), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
