"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every window of
``span - k + 1`` consecutive k-grams, so any run of ``span`` words that two
texts share has a fingerprint in both, at the same place of the run. Training
and benchmark fingerprints are joined; a hit carries the word hashes around
it, which is enough to extend it to every shared window that holds it, so the
texts themselves are never shuffled.

An item shorter than ``span`` words is one window. Its fingerprint is the
n-gram of all its n words; texts give all their n-grams for just those lengths
n that occur among the items.

A bit table of the benchmark's fingerprints (``FILTER_BITS``, half a MB
whatever the input) goes to the tasks to leave out text fingerprints without
any partner before the join. It has no false negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.text import ALNUM, Words, chunks, grams, small_batches, utf8
from vetrina.session import cut_lineage

SPAN = 10
K = 5
FILTER_BITS = 22

_HIT = "array<struct<span: int, around: int, fp: bigint, pos: bigint, words: array<bigint>>>"
_HIT_ARROW = pa.list_(pa.struct([("span", pa.int32()), ("around", pa.int32()), ("fp", pa.int64()),
                                 ("pos", pa.int64()), ("words", pa.list_(pa.int64()))]))


def _smallest(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """Whether the hash at ``at``, in a text whose hashes are [low, high), is
    the rightmost smallest of some window: enough neighbours must be larger."""
    reach = np.ones(len(at), dtype=np.int64)
    for step, beats in ((-1, np.greater_equal), (1, np.greater)):
        going = np.ones(len(at), dtype=bool)
        for i in range(1, window):
            p = at + step * i
            inside = (p >= low) & (p < high)
            going &= inside & beats(h[np.where(inside, p, at)], h[at])
            reach += going
    return reach >= np.minimum(window, high - low)


def fingerprints(words: Words, n: int, span: int, bits: np.ndarray | None = None) -> Iterator[tuple[int, dict]]:
    """(text number, hit) of each text's n-gram fingerprints for shared runs
    of ``span`` words; with ``bits``, only of those that may have a partner."""
    h = grams(words.hash, n)
    text = words.text_of()[:len(h)]
    low, high = words.first[:-1][text], words.first[1:][text] - n + 1
    keep = np.arange(len(h)) < high
    if bits is not None:
        keep &= bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
    at = np.flatnonzero(keep)
    at = at[_smallest(h, at, low[at], high[at], span - n + 1)]
    around = span - n
    for p in at.tolist():
        first, last = words.first[text[p]], words.first[text[p] + 1]
        near = np.zeros(n + 2 * around, dtype=np.uint64)  # 0: outside of the text
        a, b = max(p - around, first), min(p + n + around, last)
        near[a - p + around:b - p + around] = words.hash[a:b]
        yield int(text[p]), {"span": span, "around": around, "fp": int(h[p].astype(np.int64)), "pos": int(p - first),
                             "words": near.astype(np.int64)}


def _scan(keys: list[str], plan: list[tuple[int, int]], packed: bytes | None, short: bool):
    """mapInArrow function: key columns, n_words and hits of every text.
    ``plan`` has (n, span); ``short``: a text under SPAN words gives its one gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in chunks(batches, "text"):
            words = Words(*utf8(batch.column("text")), ALNUM)
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            full = plan[0][1]
            todo = plan + sorted({(int(c), int(c)) for c in words.count if 0 < c < full} if short else ())
            for n, span in todo:
                for i, hit in fingerprints(words, n, span, bits):
                    if not short or span == min(full, words.count[i]):
                        hits[i].append(hit)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(words.count, pa.int64()),
                                              pa.array(hits, _HIT_ARROW)], names=[*keys, "n_words", "hits"])
    return run


def _item_windows(items: DataFrame, span: int, k: int) -> DataFrame:
    rows = items.select("item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(_scan(["item_id"], [(k, span)], None, True),
                            f"item_id {kind}, n_words bigint, hits {_HIT}")
    return cut_lineage(found.select("item_id", F.inline("hits")).drop("pos").distinct(), "items")


def _filter_of(windows: DataFrame) -> bytes:
    """The bit table: 2 ** FILTER_BITS slots at most reach the driver."""
    slots = windows.select(F.shiftrightunsigned("fp", 64 - FILTER_BITS).cast("int").alias("slot")).distinct()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[slots.toPandas()["slot"].to_numpy(np.int64)] = True
    return np.packbits(bits).tobytes()


def shared_windows(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` against ``items(item_id, text)``: a row per
    document (doc_id, th = hash of the text, n_words), repeated rows kept, and
    a row per shared window (doc_id, th, item_id, start, span): words
    start .. start + span - 1 of the document are in the item."""
    small_batches(docs.sparkSession)
    windows = _item_windows(items, span, k)
    lengths = [r[0] for r in windows.select("span").where(F.col("span") < span).distinct().collect()]  # under ``span`` many
    plan = [(k, span), *((n, n) for n in sorted(lengths))]
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = cut_lineage(rows.mapInArrow(_scan(["doc_id", "th"], plan, _filter_of(windows), False),
                                          f"doc_id {kind}, th bigint, n_words bigint, hits {_HIT}"), "scanned")
    hits = scanned.where(F.size("hits") > 0).select("doc_id", "th", F.inline("hits"))
    near = windows.select("item_id", "span", "fp", F.col("words").alias("item_words"))
    def part(c, s):
        return F.slice(c, s + F.lit(1), F.col("span"))

    shared = F.filter(F.sequence(F.lit(0), F.col("around")), lambda s: (
        part(F.col("words"), s) == part(F.col("item_words"), s)) & ~F.array_contains(part(F.col("words"), s), F.lit(0).cast("bigint")))
    found = (hits.join(near, ["span", "fp"])
             .select("doc_id", "th", "item_id", "span", (F.col("pos") - F.col("around")).alias("from"), F.explode(shared).alias("s"))
             .select("doc_id", "th", "item_id", (F.col("from") + F.col("s")).alias("start"), "span").distinct())
    return scanned.drop("hits"), found


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``scored`` without the texts' hashes: per row of ``docs``: doc_id, n_words, n_hit (words inside a shared
    window), n_items (items sharing a window), items_sha256 (of their ids,
    sorted as strings, comma-joined), contaminated (n_hit > 0).

    Null and empty texts have no words; items without words share nothing; a
    repeated item counts once per id; repeated documents each get their row;
    null ids are kept as a value of their own. Other columns are ignored.
    """
    return scored(docs, items, span, k).drop("th")


def scored(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """``decontaminate``'s rows with th, the hash of the row's text."""
    rows, found = shared_windows(docs, items, span, k)
    found = cut_lineage(found, "windows")
    runs = found.select("doc_id", "th", "start", (F.col("start") + F.col("span")).alias("end")).distinct()
    covered = F.max("end").over(_before("doc_id", "th"))
    hit = (runs.select("doc_id", "th", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(covered, F.lit(0)))).alias("n"))
           .groupBy("doc_id", "th").agg(F.sum("n").alias("n_hit")))
    named = (found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
             .select("doc_id", "th", F.size("ids").cast("bigint").alias("n_items"), F.array_join("ids", ",").alias("ids")))
    hit = hit.alias("h").join(named.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.th = i.th")).select(
        "h.doc_id", "h.th", "n_hit", "n_items", "ids")
    zero = F.lit(0).cast("bigint")
    return rows.alias("d").join(hit.alias("h"), F.expr("d.doc_id <=> h.doc_id AND d.th = h.th"), "left").select(
        "d.doc_id", "d.th", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def _before(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. A row is judged by its own
    text, also where its doc_id is null or repeats."""
    found = scored(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = cut_lineage(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_th"]), "left_anti")
