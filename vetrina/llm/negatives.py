"""Hard negatives by lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster with centre c whose members
are within the angle w of it, no member a scores a candidate x over
|a| |x| cos(max(0, angle(x, c) - w)); the part behind |a| orders the candidates
alike for every member. So each cluster has one list, sorted by that bound
once, and every member walks it from the top until its results are certified:
until it has as many as it needs and the next bound lies under the last of
them, or under all that it may take.

A list can hold all rows, so it is never gathered. A pass counts, for each
cluster, candidates by bins of the bound; a round deals the next bins (at least
``FIRST`` candidates, each round ``GROWTH`` times more) in blocks to tasks,
walks them with the thresholds of the rounds before, and merges. Only members
that are not certified go on, and only their clusters' candidates are dealt. A
first walk finds the positives, a second one the negatives of each positive.

Bounded on the driver: ``SAMPLE`` anchors and as many candidates, which only
steer the clusters and bins, ``MAX_CLUSTERS`` centres (one for each dimension
at least) and their bins. Scores are integers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm.text import small_batches
from vetrina.session import cut_lineage

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 80, 100

MEMBERS = 64
MAX_CLUSTERS = 1024
SAMPLE = 4096
BINS = 64
FIRST = 1 << 14
GROWTH = 8
BLOCK = 4096
STEP = 512
BLOCK_BYTES = 32 << 20
#: Angles and bounds are widened by more than double precision can err.
SLACK = 1e-7
#: Squared lengths from here on could give scores that a hundredfold doesn't fit a long.
MAX_SQUARE = 2.0 ** 56
NO_SCORE = -(1 << 62)

_LIST = "row long, vec_id long, label long, q array<double>, norm double"


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, q, norm) of the rows that take part, written; row
    is a number of its own."""
    e = F.col("embedding").cast("array<double>")
    q = F.transform(e, lambda x: F.floor(x * scale).cast("double"))
    square = F.aggregate(e, F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    good = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (square < MAX_SQUARE)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)))
    rows = rows.select("vec_id", "label", F.when(good, q).alias("q")).where("q IS NOT NULL")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q", norm.alias("norm")), "vectors")


# ---- clusters and the bound

def _matrix(column) -> np.ndarray:
    """The vectors of a list column (all of one dimension) as rows."""
    if isinstance(column, pa.Array):
        values = column.flatten().to_numpy(zero_copy_only=False)
        return values.reshape(len(column), -1)
    return np.stack(column.to_numpy())


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of rows to unit centres; of a zero vector 0."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(length > 0, np.arccos(np.clip((x @ centres.T) / np.where(length > 0, length, 1), -1, 1)), 0)


def centres_of(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means: k unit rows at most."""
    u = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    c = np.unique(u[np.random.default_rng(seed).permutation(len(u))[:k]], axis=0)
    for _ in range(rounds):
        near = (u @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    length = np.sqrt((c * c).sum(axis=1, keepdims=True))
    first = np.eye(1, x.shape[1])
    return np.where(length > 0.5, c / np.maximum(length, 1e-9), first)  # a zero anchor alone: any direction


@dataclass
class Clusters:
    """Of one dimension: ids, unit centres and widths (largest angle of a
    member), and the ascending inner edges of the bound's bins."""

    first: int
    centres: np.ndarray
    width: np.ndarray
    edges: np.ndarray

    def bounds(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(rows, clusters): what the score over |a| can't exceed."""
        return norm[:, None] * np.cos(np.maximum(_angles(x, self.centres) - self.width, 0)) + SLACK * norm[:, None]


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        sizes = np.asarray(batch.column("q").value_lengths())
        for dim in np.unique(sizes).tolist():
            yield dim, batch.filter(pa.array(sizes == dim))


def _assign(all_: dict[int, Clusters]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dim(batches):
            angle = _angles(_matrix(batch.column("q")), all_[dim].centres)
            near = angle.argmin(axis=1)
            yield batch.append_column("cluster", pa.array(near + all_[dim].first, pa.int32())).append_column("angle", pa.array(angle.min(axis=1)))
    return run


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(F.size("q").alias("dim")).count().collect()}  # a row a dimension


def _sample(rows: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """About SAMPLE vectors of each of these dimensions, by a hash."""
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(y) for dim, n in sizes.items() for y in (dim, min(1.0, SAMPLE / n))))
    place = F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 53)) / float(1 << 53)
    picked = rows.select("q", F.size("q").alias("dim"), place.alias("place")).where(F.col("place") < share[F.col("dim")]).orderBy("place").toPandas()
    return {dim: _matrix(x["q"]) for dim, x in picked.groupby("dim")}


def cluster_anchors(anchors: DataFrame, rows: DataFrame) -> tuple[dict[int, Clusters], DataFrame]:
    """The clusters by dimension, and the anchors with ``cluster``."""
    sizes = _sizes(anchors)
    total = sum(sizes.values())
    all_, first = {}, 0
    seen = _sample(anchors, sizes)
    for dim in sorted(seen):
        room = max(BLOCK_BYTES // (8 * dim), 1)
        k = max(min(math.ceil(sizes[dim] / MEMBERS), MAX_CLUSTERS * sizes[dim] // total, room, SAMPLE), 1)
        c = centres_of(seen[dim], k)
        all_[dim] = Clusters(first, c, np.zeros(len(c)), np.zeros((len(c), 0)))
        first += len(c)
    kind = "row long, vec_id long, label long, q array<double>, norm double, cluster int, angle double"
    assigned = cut_lineage(anchors.select("row", "vec_id", "label", "q", "norm").mapInArrow(_assign(all_), kind), "anchors")
    for cluster, width in assigned.where("norm > 0").groupBy("cluster").agg(F.max("angle")).collect():  # a row a cluster
        for x in all_.values():
            if 0 <= cluster - x.first < len(x.centres):
                x.width[cluster - x.first] = width + SLACK
    likely = _sample(rows, {dim: n for dim, n in _sizes(rows).items() if dim in all_}) if all_ else {}
    for dim, x in all_.items():
        y = likely.get(dim, seen[dim])
        at = np.unique((np.geomspace(1, len(y) + 1, BINS) - 1).astype(int))[1:-1]  # fine at the top
        ub = -np.sort(-x.bounds(y, np.sqrt((y * y).sum(axis=1))), axis=0)
        x.edges = ub[np.minimum(at, len(y) - 1)][::-1].T.copy()
    return all_, assigned.drop("angle")


def _bins(x: Clusters, bounds: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(x.edges[i], bounds[:, i], side="right") for i in range(len(x.centres))], axis=1)


def _count(all_: dict[int, Clusters]):
    """mapInArrow function: (cluster, bin, n) of a batch's candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dim(batches):
            if dim in all_:
                x = all_[dim]
                got = _bins(x, x.bounds(_matrix(batch.column("q")), batch.column("norm").to_numpy()))
                n = np.stack([np.bincount(got[:, i], minlength=x.edges.shape[1] + 1) for i in range(got.shape[1])])
                c, b = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(c + x.first, pa.int32()), pa.array(b, pa.int32()), pa.array(n[c, b], pa.int64())], names=["cluster", "bin", "n"])
    return run


# ---- the walk

@dataclass
class Band:
    """What a round deals of a cluster's list: bounds in [low, high), in
    ``blocks`` blocks of candidates, to ``parts`` parts of its members."""

    low: float
    high: float
    blocks: int
    parts: int


def _deal(all_: dict[int, Clusters], bands: dict[int, Band]):
    """mapInArrow function: each candidate of the bands, once for each part of a cluster's members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dim(batches):
            if dim not in all_:
                continue
            x, norm = all_[dim], batch.column("norm").to_numpy()
            ub = x.bounds(_matrix(batch.column("q")), norm)
            mixed = batch.column("row").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for i in range(len(x.centres)):
                band = bands.get(i + x.first)
                if band is None:
                    continue
                # a bound that falls on an edge in one pass and beside it in another is dealt in both rounds
                at = np.flatnonzero((ub[:, i] >= band.low - SLACK * norm) & (ub[:, i] < band.high + SLACK * norm))
                for part in range(band.parts if len(at) else 0):
                    got = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*got.columns, pa.array(ub[at, i]), pa.array(np.full(len(at), i + x.first), pa.int32()), pa.array(np.full(len(at), part), pa.int32()),
                         pa.array((mixed[at] % np.uint64(band.blocks)).astype(np.int32))], names=[*batch.schema.names, "ub", "cluster", "part", "block"])
    return run


def _best(need: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each need the k highest scores, ties by smaller ids."""
    order = np.lexsort((row, vec, -score, need))
    need = need[order]
    starts = np.searchsorted(need, need, side="left")
    keep = np.arange(len(need)) - starts < k
    return need[keep], score[order][keep], vec[order][keep], row[order][keep]


def _scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles hold them exactly where ``exact``."""
    return (a @ x.T).astype(np.int64) if exact else a.astype(np.int64) @ x.astype(np.int64).T


def _reach(norm, bound):
    """What a member's scores below this bound can't exceed."""
    return norm * bound + abs(norm * bound) * SLACK


def _walk(k: int, step: int = STEP):
    """cogroup function: each need (an anchor's own, or one of its positives')
    walks a block of its cluster's list from the largest bound down."""
    def run(needs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "need": [], "score": [], "vec_id": [], "found_row": []}
        if len(needs) and len(found):
            found = found.sort_values("ub", ascending=False, kind="stable")
            x, ub = _matrix(found["q"]), found["ub"].to_numpy()
            vec, label, rows = (found[c].to_numpy(np.int64) for c in ("vec_id", "label", "row"))
            members, of = np.unique(needs["row"].to_numpy(np.int64), return_index=True)
            member = np.searchsorted(members, needs["row"].to_numpy(np.int64))
            a, norm = _matrix(needs["q"].iloc[of]), needs["norm"].to_numpy()
            low, high, own, own_label, same = (needs[c].to_numpy() for c in ("low", "high", "vec_id", "label", "same"))
            exact = norm.max() * found["norm"].max() < 2.0 ** 52
            kth = needs["kth"].to_numpy(np.int64).copy()
            best = tuple(np.zeros(0, np.int64) for _ in range(4))
            open_ = np.ones(len(needs), dtype=bool)
            for at in range(0, len(x), step):
                reach = _reach(norm, ub[at])
                open_ &= (reach >= kth) & (reach >= low)  # certified ones stop; an equal score may still win by its id
                if not open_.any():
                    break
                here = slice(at, at + step)
                s = _scores(a, x[here], exact)[member[open_]]
                ok = (s >= np.maximum(low, kth)[open_, None]) & (s <= high[open_, None])
                equal = label[here] == own_label[open_, None]
                ok &= np.where(same[open_, None], equal & (vec[here] != own[open_, None]), ~equal)
                i, j = np.nonzero(ok)
                if len(i):
                    best = _best(*(np.concatenate(y) for y in zip(best, (np.flatnonzero(open_)[i], s[i, j], vec[here][j], rows[here][j]), strict=True)), k)
                    count = np.bincount(best[0], minlength=len(needs))
                    last = np.zeros(len(needs), np.int64)
                    last[best[0]] = best[1]  # sorted by need and falling score: the last one stays
                    kth = np.where(count == k, np.maximum(kth, last), kth)
            out = {"row": needs["row"].to_numpy(np.int64)[best[0]], "need": needs["need"].to_numpy()[best[0]], "score": best[1], "vec_id": best[2], "found_row": best[3]}
        return pd.DataFrame(out).astype({"need": "int32", "row": "int64", "score": "int64", "vec_id": "int64", "found_row": "int64"})
    return run


_FOUND = "row long, need int, score long, vec_id long, found_row long"


def walk(needs: DataFrame, rows: DataFrame, all_: dict[int, Clusters], counts: dict[int, np.ndarray], k: int) -> DataFrame:
    """(row, need, score, vec_id, found_row): the k best of each need of
    ``needs(row, vec_id, label, q, norm, cluster, need, low, high, same)``."""
    spark, state = needs.sparkSession, None
    open_ = cut_lineage(needs.withColumn("kth", F.lit(NO_SCORE)), "needs")
    at = {c: len(n) for c, n in counts.items()}  # bins from here on are walked
    size = FIRST
    while True:
        members = {r[0]: r[1] for r in open_.groupBy("cluster").count().collect()}  # a row a cluster
        bands, after = {}, []
        for x in all_.values():
            for i in range(len(x.centres)):
                c = i + x.first
                if c not in members or not at[c]:
                    continue
                top, dealt = at[c], 0
                while at[c] and dealt < size:
                    at[c] -= 1
                    dealt += int(counts[c][at[c]])
                edge = [-math.inf, *x.edges[i], math.inf]
                block = max(min(BLOCK, BLOCK_BYTES // (8 * x.centres.shape[1])), 1)
                bands[c] = Band(edge[at[c]], edge[top], max(math.ceil(dealt / block), 1), math.ceil(members[c] / (MEMBERS * POSITIVES)))
                after.append((c, bands[c].blocks, bands[c].parts, float(edge[at[c]])))
        if not bands:
            return state if state is not None else spark.createDataFrame([], _FOUND)
        size *= GROWTH
        plan = F.broadcast(spark.createDataFrame(after, "cluster int, blocks int, parts int, left double"))  # a row a cluster
        dealt = rows.mapInArrow(_deal(all_, bands), f"{_LIST}, ub double, cluster int, part int, block int")
        part = F.pmod(F.xxhash64("row", F.lit(9)), F.col("parts").cast("long")).cast("int")
        walkers = open_.join(plan, "cluster").select(*open_.columns, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        keys = ["cluster", "part", "block"]
        found = walkers.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_walk(k, STEP), _FOUND)
        if state is not None:
            found = found.unionByName(state)
        rank = F.row_number().over(Window.partitionBy("row", "need").orderBy(F.desc("score"), "vec_id", "found_row"))
        state = cut_lineage(found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "state")
        last = state.groupBy("row", "need").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        bound = F.col("norm") * F.col("left")
        reach = bound + F.abs(bound) * SLACK
        going = open_.join(plan.drop("blocks", "parts"), "cluster").join(last, ["row", "need"], "left").withColumn("kth", F.coalesce("least", F.col("kth"))).where(
            (F.col("left") > -math.inf) & (reach >= F.col("kth")) & (reach >= F.col("low")))
        open_ = cut_lineage(going.select(*open_.columns), "needs")


def hard_negatives(vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """Of each anchor, a row of ``vectors(vec_id, embedding, label)`` for which
    ``anchor`` (over vec_id and label) holds, and each of its positives, the
    best other rows of its label, the best rows of other labels whose score is
    between ``low`` and ``high`` hundredths of the positive's: anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x); higher ones come first,
    ties by smaller vec_id. Rows with a null vec_id or label, a null or empty
    vector or a null or non-finite component take no part, nor do those with a
    squared scaled length of 2 ** 56 or more, whose scores are not sure to fit
    a long. Vectors of different dimensions don't meet. Repeated rows are rows
    of their own, as anchors too; a row that shares an anchor's vec_id is not
    its positive. Other columns are ignored. No rows give no rows.
    """
    small_batches(vectors.sparkSession)
    rows = prepared(vectors, scale)
    all_, anchors = cluster_anchors(rows.where(anchor), rows)
    counts = {x.first + i: np.zeros(x.edges.shape[1] + 1, np.int64) for x in all_.values() for i in range(len(x.centres))}
    for c, b, n in rows.select("row", "vec_id", "label", "q", "norm").mapInArrow(_count(all_), "cluster int, bin int, n long").groupBy("cluster", "bin").agg(F.sum("n")).collect():
        counts[c][b] = n  # BINS rows a cluster at most
    wide = F.lit(1 << 62)
    own = anchors.select("*", F.lit(0).alias("need"), (-wide).alias("low"), wide.alias("high"), F.lit(True).alias("same"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "found_row"))
    close = cut_lineage(walk(own, rows, all_, counts, positives).select(
        "row", rank.alias("need"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the least score s with low * p <= 100 * s is the quotient rounded up, the largest with 100 * s <= high * p that rounded down
    least = F.expr(f"(positive_score * {low}L + 99L) DIV 100L")
    most = F.expr(f"(positive_score * {high}L) DIV 100L")
    wanted = anchors.join(close.where("positive_score >= 0"), "row").select(
        *anchors.columns, "need", least.cast("long").alias("low"), most.cast("long").alias("high"), F.lit(False).alias("same"))
    far = walk(wanted, rows, all_, counts, negatives)
    place = F.row_number().over(Window.partitionBy("row", "need").orderBy(F.desc("score"), "vec_id", "found_row"))
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return far.select("row", "need", place.cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        close, ["row", "need"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; labels of those
    divisible by 7 move on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q) AND (a.label <> b.label OR a.vec_id <> b.vec_id)
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
