"""Reproducible shuffle into shards by a Feistel permutation.

Rows get global numbers 0..n-1 in the order of (doc_id, size, text hash). A
keyed Feistel network permutes the smallest domain of 2 ** (2 h) numbers that
holds them; numbers outside of 0..n-1 walk on along their cycle until they are
inside. The permuted place p gives shard p % shards and slot p // shards, so
row counts differ by one at most, slots have no gaps, and both can be computed
from a row's number, or the number from them (``place_of``, ``row_at``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.text import mix
from vetrina.session import cut_lineage

SHARDS = 24
SEED = 2024
ROUNDS = 6
#: Low bits of monotonically_increasing_id, the row's place in its partition.
_ROW_BITS = 33


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    return mix(half ^ np.uint64(key)) & mask


def _keys(seed: int) -> list[int]:
    return [int(x) for x in mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed))]


def _half_bits(n: int) -> int:
    return max((max(n - 1, 1).bit_length() + 1) // 2, 1)


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at the numbers ``x``."""
    bits = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):  # cycle walking; the domain is under 4 n, so a few rounds on average
        left, right = x[todo] >> bits, x[todo] & mask
        for key in reversed(_keys(seed)) if back else _keys(seed):
            if back:
                left, right = right ^ _round(left, key, mask), left
            else:
                left, right = right, left ^ _round(right, key, mask)
        x[todo] = left << bits | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


def place_of(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number among n rows."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` 0..n-1 in the global order of columns that
    tell all rows apart that differ, and n. One row a partition reaches the driver."""
    sorted_ = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", _ROW_BITS)
    counts = sorted_.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    first, total = {}, 0
    for part_, n in counts:
        first[part_], total = total, total + n
    table = rows.sparkSession.createDataFrame(list(first.items()), "part int, start long")  # a row a partition
    inside = F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)
    return (sorted_.withColumn("part", part.cast("int")).join(F.broadcast(table), "part")
            .withColumn("row_number", F.col("start") + inside).drop("at", "part", "start")), total


def _place(n: int, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                                             names=[*batch.schema.names, "shard", "slot"])
    return run


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, size (UTF-8 bytes of the
    text, null: none, plus 8), text_crc32, law (``rows``), shard, slot,
    grown_shard (null under this law), row_number.

    The same rows in any order and layout give the same result. Equal rows
    are interchangeable, and each has a place of its own; null ids come first;
    a null text has the checksum of an empty one. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("th"))
    rows, n = numbered(rows, "doc_id", "size", "text_crc32", "th")
    rows = rows.drop("th")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(_place(n, shards, seed), f"{schema}, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_number")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
