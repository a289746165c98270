"""Best-fit packing into sequences of several permitted lengths.

A document is its UTF-8 bytes and an end mark; ``CAPACITIES`` are the permitted
sequence lengths in these. A document longer than the largest is cut, at
character boundaries, into pieces. Pieces are packed in blocks, dealt by a hash
of the piece, best fit decreasing: a piece goes to the open bin that it leaves
least room in, of whatever size; where none holds it, a new bin opens. A policy
names the size that opens, by the smallest size that holds the piece: that one
or any larger. Every policy is tried (24 with four sizes), each bin is
downsized at last to the smallest size that holds its contents, and the plan
with the least total cost stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.text import chunks, small_batches, utf8

CAPACITIES = (2048, 4096, 8192, 16384)
#: Pieces in an average block. Each block leaves a few bins unfilled at most.
BLOCK = 8192
#: Bytes of text in an average block, where pieces carry theirs.
BLOCK_BYTES = 24 << 20


def cost(capacity: int) -> float:
    """Of one sequence: linear work, attention's square, and a fixed part."""
    return capacity + capacity * capacity / 65536 + 64


def openings(lengths: list[int], capacities: tuple[int, ...], largest: int) -> Iterator[dict[int, int]]:
    """Every opening policy up to ``largest``: by the smallest size that holds
    a piece, the size that opens for it. Pieces over ``largest`` open their own."""
    own = sorted({capacities[bisect_left(capacities, x)] for x in lengths})
    for opened in product(*([c for c in capacities if o <= c <= max(o, largest)] for o in own)):
        yield dict(zip(own, opened, strict=True))


def filled(lengths: list[int], capacities: tuple[int, ...], opened: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, load of each bin) for pieces in
    falling order of length, under one opening policy."""
    room: dict[int, list[int]] = {}  # bins by the room they have left
    rooms: list[int] = []
    where, offset, load = [], [], []
    for length in lengths:
        at = bisect_left(rooms, length)
        if at < len(rooms):
            left = rooms[at]
            bin_ = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            bin_, left = len(load), opened[capacities[bisect_left(capacities, length)]]
            load.append(0)
        where.append(bin_)
        offset.append(load[bin_])
        load[bin_] += length
        left -= length
        if left > 0:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append(bin_)
    return where, offset, load


def best_fit(lengths: list[int], capacities: tuple[int, ...], largest: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, load of each bin) for pieces in
    falling order of length: the cheapest plan, its bins downsized, of all
    policies that open bins up to ``largest`` where they can."""
    plans = (filled(lengths, capacities, opened) for opened in openings(lengths, capacities, largest))
    return min(plans, key=lambda plan: total(plan[2], capacities))


def downsized(load: list[int], capacities: tuple[int, ...]) -> list[int]:
    return [capacities[bisect_left(capacities, x)] for x in load]


def total(load: list[int], capacities: tuple[int, ...]) -> float:
    return sum(map(cost, downsized(load, capacities)))


def pack_block(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset, capacity of each bin) of the cheapest plan."""
    where, offset, load = best_fit(lengths, capacities, capacities[-1])
    return where, offset, downsized(load, capacities)


def _pieces(longest: int, with_text: bool):
    """mapInArrow function: (doc_id, th, piece, start, length[, text])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            row, piece, start, end = [], [], [], []
            for i in range(batch.num_rows):
                at, stop, n = int(offsets[i]), int(offsets[i + 1]), 0
                while True:
                    to = min(at + longest, stop)
                    if stop - at + 1 <= longest:  # with its end mark
                        to = stop
                    elif to == stop:
                        to = stop - 1
                    while to < stop and data[to] & 0xC0 == 0x80:
                        to -= 1
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    end.append(to)
                    n += 1
                    at = to
                    if at == stop:
                        break
            of = pa.array(row, pa.int64())
            last = np.array([e == offsets[i + 1] for i, e in zip(row, end, strict=True)], dtype=np.int64)
            begin = np.array(start, np.int64)
            columns = [batch.column("doc_id").take(of), batch.column("th").take(of), pa.array(piece, pa.int32()),
                       pa.array(begin - offsets[np.array(row, np.int64)]), pa.array(np.array(end, np.int64) - begin + last)]
            if with_text:
                raw = data.tobytes()
                columns.append(pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(start, end, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "piece", "start", "length", *["text"] * with_text])
    return run


def _pack(capacities: tuple[int, ...]):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        # rows stay where they are and only their keys are sorted, so the texts of a block aren't copied
        order = pc.sort_indices(group.select(["length", "doc_id", "th", "piece"]), sort_keys=[
            ("length", "descending"), ("doc_id", "ascending"), ("th", "ascending"), ("piece", "ascending")]).to_numpy()
        where, offset, size = pack_block(group.column("length").to_numpy()[order].tolist(), capacities)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        bins = np.array(where, np.int64)[place]
        return (group.drop_columns(["block", "th"]).append_column("bin_id", pa.array((key[0].as_py() << 32) + bins))
                .append_column("capacity", pa.array(np.array(size, np.int32)[bins]))
                .append_column("offset", pa.array(np.array(offset, np.int64)[place])))
    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, with_text: bool = False, block: int = BLOCK) -> DataFrame:
    """Per piece of ``docs(doc_id, text)``: doc_id, piece (0 ..), start (byte
    of the text), length (bytes, and 1 for the end mark of a last piece),
    [text,] bin_id, capacity, offset (in the bin).

    Pieces of a bin fill it without gaps or overlap, the capacity is the
    smallest that holds them, and the pieces of a document are its whole text.
    Null and empty texts are one piece, the end mark. Repeated rows are packed
    each; other columns are ignored. The result doesn't depend on the layout.
    """
    small_batches(docs.sparkSession)
    capacities = tuple(sorted(capacities))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    pieces, nbytes = docs.agg(F.sum(F.floor(size / capacities[-1]) + 1), F.sum(size.cast("long"))).first()
    blocks = max(-(-(pieces or 0) // block), -(-(nbytes or 0) // BLOCK_BYTES) if with_text else 0, 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = ", text string" if with_text else ""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        _pieces(capacities[-1], with_text), f"doc_id {kind}, th long, piece int, start long, length long{text}")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "th", "piece"), F.lit(blocks)))
    return rows.groupBy("block").applyInArrow(
        _pack(capacities), f"doc_id {kind}, piece int, start long, length long{text}, bin_id long, capacity int, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences: pieces with their text and place."""
    return pack(docs, with_text=True)
