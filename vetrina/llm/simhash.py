"""SimHash near-duplicates by a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint. Distinct fingerprints are sorted by
Gray rank, so neighbours share long masked bit patterns; the index factors
these into upper nodes, one per distinct pattern of each 8-bit segment. A
search joins the index with itself from the top: two nodes stand for two
groups of fingerprints, their accumulated differences are a lower bound for
every pair below, and beyond the limit the whole pair of groups is pruned.

Two fingerprints within d bits differ in d // 2 bits at most in one of their
halves, so the index is built in two bit orders, each with one half in front,
and a search allows d // 2 differences there and d in all. That keeps the
number of nodes visited near-linear.

Spark deals out the uppermost nodes: the first ``prefix`` bits in an order
name a group, a fingerprint belongs to one group and visits those groups whose
pattern is within the front limit. A pair is looked for in one group only. A
group of over ``SPLIT`` fingerprints, as a template in a third of all documents
makes it, is dealt in blocks by hash, and each two blocks are a task of their
own. Tasks give back spanning edges, never all their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.components import components, smallest_labels
from vetrina.llm.text import chunks, small_batches, utf8
from vetrina.session import bounded_broadcast, cut_lineage

SHINGLE = 3
BITS = 3
SEED = 42
#: Fingerprints in an average group; it sets the number of groups, not the result.
GROUP = 2048
#: Fingerprints that one task compares, on average; a larger group is dealt in blocks.
SPLIT = 1 << 16
SEGMENT = 8
#: Node pairs that are compared at once; a pair of nodes has 65,536 pairs of children at most.
BLOCK = 1 << 19

_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For texts with ``counts`` hashes each, the bits set in over half of them."""
    out = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    part = (n + 254) // 255  # byte-wide counters hold 255 hashes
    of = np.repeat(np.arange(len(n)), part)
    part_first = np.concatenate(([0], np.cumsum(part)[:-1]))
    cut = first[of] + (np.arange(len(of)) - part_first[of]) * 255
    bits = np.zeros(len(n), dtype=np.uint64)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cut)
        per_text = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), part_first, axis=0)
        for byte in range(8):  # byte i holds the count of bit 8 i + j
            bits |= (2 * per_text[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + j)
    out[some] = bits
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    raw, digest, join = data.tobytes(), xxhash.xxh64_intdigest, b" ".join
    for i in range(len(counts)):
        words = raw[offsets[i]:offsets[i + 1]].lower().split()  # bytes: A-Z, and the six ASCII spaces
        if len(words) > shingle:
            found = [digest(join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)))]
        else:
            found = [digest(join(words), SEED)] if words else []
        counts[i] = len(found)
        hashes += found
    return _majority(np.array(hashes, dtype=np.uint64), counts)


def _fingerprint(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = fingerprints(*utf8(batch.column("text")), shingle).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found)], names=["doc_id", "th", "fp"])
    return run


def _reordered(fp: np.ndarray, order: int) -> np.ndarray:
    """Order 0 has the upper half in front, order 1 the lower half."""
    return fp if order == 0 else (fp << np.uint64(32)) | (fp >> np.uint64(32))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Index:
    """Nodes by level: level i has the distinct patterns of the first
    SEGMENT * (i + 1) bits, in Gray order; the last level has the codes."""

    def __init__(self, codes: np.ndarray):
        codes = np.unique(codes)
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.first: list[np.ndarray] = []  # of each level: first code of each node
        for bits in range(SEGMENT, 65, SEGMENT):
            pattern = self.codes >> np.uint64(64 - bits)
            self.first.append(np.flatnonzero(np.concatenate(([True], pattern[1:] != pattern[:-1])))[:len(codes)])

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children (in level + 1) of each node."""
        first = np.searchsorted(self.first[level + 1], self.first[level])
        return first, np.diff(np.append(first, len(self.first[level + 1])))

    def close(self, other: Index, bits: int, front: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of positions (in self.codes, in other.codes) within ``bits``
        differences in all and ``front`` in the upper half."""
        def near(level: int, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
            done = SEGMENT * (level + 1)
            diff = np.bitwise_count((self.codes[self.first[level][a]] ^ other.codes[other.first[level][b]]) >> np.uint64(64 - done))
            keep = diff <= (front if done <= 32 else bits)  # upper bits stay within ``front`` from the levels above
            if other is self:  # each pair once
                keep &= a <= b
            return level, a[keep], b[keep]

        if not len(self.codes) or not len(other.codes):
            return
        tops = len(other.first[0])
        todo = [near(0, *np.divmod(np.arange(len(self.first[0]) * tops), tops))]
        while todo:
            level, a, b = todo.pop()
            if not len(a):
                continue
            if level == 64 // SEGMENT - 1:
                yield self.first[level][a], other.first[level][b]
                continue
            (first_a, n_a), (first_b, n_b) = self.children(level), other.children(level)
            pairs = n_a[a] * n_b[b]
            if pairs.sum() > BLOCK and len(a) > 1:
                half = len(a) // 2
                todo += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            at = np.repeat(np.arange(len(a)), pairs)
            i = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            todo.append(near(level + 1, first_a[a][at] + i // n_b[b][at], first_b[b][at] + i % n_b[b][at]))


def spanning_edges(members: np.ndarray, visitors: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what close pairs among the members, and between
    members and visitors, connect: as many as there are codes at most."""
    own, guests = Index(_reordered(members, order)), Index(_reordered(visitors, order))
    codes = np.concatenate((own.codes, guests.codes))
    label = np.arange(len(codes))
    for other, shift in ((own, 0), (guests, len(own.codes))):
        for a, b in own.close(other, bits, bits // 2):
            a, b = label[a], label[b + shift]
            open_ = a != b
            if open_.any():
                label = smallest_labels(len(codes), np.concatenate((np.arange(len(codes)), a[open_])),
                                        np.concatenate((label, b[open_])))
    linked = np.flatnonzero(label != np.arange(len(codes)))
    back = _reordered(codes, order)
    return back[linked], back[label[linked]]


def _groups(prefix: int, reach: int):
    """mapInPandas function: (group, fp, visitor) of each fingerprint."""
    flips = [sum(1 << p for p in x) for r in range(1, reach + 1) for x in combinations(range(prefix), r)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for order in (0, 1):
                own = (_reordered(fp, order) >> np.uint64(64 - prefix)).astype(np.int64) if prefix else np.zeros(len(fp), np.int64)
                yield pd.DataFrame({"grp": own << 1 | order, "fp": fp.view(np.int64), "visitor": False})
                for flip in flips:
                    there = own ^ flip
                    to = there < own  # the pair of groups meets in the smaller one
                    yield pd.DataFrame({"grp": there[to] << 1 | order, "fp": fp.view(np.int64)[to], "visitor": True})
    return run


def _group_edges(bits: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        visits = group["visitor"].to_numpy(bool)
        a, b = spanning_edges(fp[~visits], fp[visits], int(key[0]) & 1, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
    return run


def _tasks(dealt: DataFrame, split: int) -> DataFrame:
    """``dealt`` with columns i, j: a group of over ``split`` rows has blocks
    of about half as many, and a row goes to each pair i < j that has its
    block. Every two rows of the group meet there. Other groups have i = j = 0."""
    n = F.count(F.lit(1))
    large = cut_lineage(dealt.groupBy("grp").agg(n.alias("n")).where(F.col("n") > split)
                        .select("grp", F.ceil(F.col("n") * 2 / split).cast("int").alias("blocks")), "large-groups")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    placed = dealt.join(bounded_broadcast(large), "grp", "left").withColumn("own", own)
    return placed.select("grp", "fp", "visitor", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(pairs)).alias("at")).select(
        "grp", "at.i", "at.j", "fp", "visitor")


def link_fingerprints(distinct: DataFrame, bits: int = BITS, split: int = SPLIT) -> DataFrame:
    """(node, root) of the components of ``distinct(fp)`` under links of
    ``bits`` or fewer differing bits; fingerprints without links don't appear.
    ``split`` bounds what one task compares, not the result."""
    n = distinct.count()
    prefix = min(max(math.ceil(math.log2(max(n, 1) / GROUP)), 0), 24)
    dealt = distinct.select("fp").mapInPandas(_groups(prefix, bits // 2), "grp long, fp long, visitor boolean")
    edges = _tasks(dealt, split).groupBy("grp", "i", "j").applyInPandas(_group_edges(bits), "a long, b long")
    # written, as ``components`` starts with a Python step: in one stage the two would take two workers a core,
    # and an executor that has started a worker uses it, and its memory, in all later stages
    return components(cut_lineage(edges, "links"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits)
    and component_id, the smallest doc_id reachable by links.

    Null, empty and blank texts have fingerprint zero, linked like any other.
    Repeated rows each get their row. A row without doc_id links others; its
    component_id is null only if no doc_id is reachable. Other columns are
    ignored.
    """
    prints, rooted = linked(docs, shingle, bits)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, prints["fp"] == named["of"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th = hash of the text, fp) of every row, and (fp, least =
    smallest doc_id, root = a fingerprint of its component) of every distinct
    fingerprint; both written."""
    small_batches(docs.sparkSession)
    prints = cut_lineage(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        _fingerprint(shingle), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long"), "fingerprints")
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = link_fingerprints(distinct, bits)
    rooted = cut_lineage(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                         .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    return prints, rooted


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the smallest doc_id (rows without one
    come last), then the smallest hash of its text. A row is judged by its own
    text, also where its doc_id is null or repeats; of rows that repeat both,
    one stays."""
    prints, rooted = linked(docs)
    rows = prints.join(rooted.select(F.col("fp").alias("of"), "root"), F.col("fp") == F.col("of")).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    rows = cut_lineage(rows, "rows")  # ids and hashes only, written so that the planner knows their size before it moves texts
    first = cut_lineage(rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("one")), "first")
    stays = F.expr("doc_id <=> one.doc_id AND th = one.th")
    judged = rows.join(first, "root").select(F.col("doc_id").alias("of_id"), F.col("th").alias("of_th"), "n", stays.alias("stays"))
    gone = cut_lineage(judged.where("NOT stays OR n > 1"), "gone")
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["of_id"]) & (F.xxhash64(docs["text"]) == gone["of_th"]), "left_anti")
    repeated = gone.where("stays").select("of_id", "of_th")
    if repeated.isEmpty():
        return kept
    whole = docs.select(F.struct("*").alias("d"))  # its own columns may have any names
    one = whole.join(repeated, F.col("d.doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("d.text") == F.col("of_th")))
    return kept.unionByName(one.dropDuplicates(["of_id", "of_th"]).select("d.*"))  # partial aggregation: a row a task at most
