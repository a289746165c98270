"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine >= t are within r = sqrt(2 - 2 t) of each other.
Pivots partition the vectors of a label into cells, each vector in that of its
nearest pivot. By the triangle inequality a vector y of cell B can only have a
partner x in cell A if d(y, A's pivot) <= radius of A + r and d(y, A's pivot)
<= d(y, B's pivot) + 2 r, sharpened to the distance from the plane between the
two pivots; then y is replicated to A. Cells join independently, and a pair of
cells meets in the lower-numbered one only.

Equal vectors are one class from the start. A cell is joined in blocks of
``BLOCK`` vectors against ``BLOCK``, however many it holds, so no task's memory
grows with a cell. A task gives back link counts by class and spanning edges,
never all pairs. Pivots number 2 * ``MAX_PIVOTS`` at most, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm.components import components, star_edges
from vetrina.session import cut_lineage

COSINE = 0.93
CELL = 2048
BLOCK = 2048
MAX_PIVOTS = 4096
SLACK = 1e-9


def unit(vectors: list) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


Pivots = dict[tuple[int, int], np.ndarray]


def _assign(pivots: Pivots):
    """mapInPandas function: cell and distance of each class."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, near = np.zeros(len(batch), np.int64), np.full(len(batch), -1.0)  # -1: the label has no pivots
            for key, rows in batch.groupby(["label", "dim"]).indices.items():
                if key in pivots:
                    d = _distances(unit(batch["embedding"].iloc[rows].tolist()), pivots[key])
                    cell[rows], near[rows] = d.argmin(axis=1), d.min(axis=1)
            yield batch[["label", "dim", "cls", "copies", "embedding"]].assign(cell=cell, near=near)
    return run


def _visit(pivots: Pivots, radius: dict[tuple[int, int], np.ndarray], r: float):
    """mapInPandas function: each class in its own cell, and as a visitor in
    those lower cells where it may have a partner."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="near").assign(visitor=False)
            for key, rows in batch.groupby(["label", "dim"]).indices.items():
                if key not in pivots:
                    continue
                p = pivots[key]
                own, near = batch["cell"].to_numpy()[rows], batch["near"].to_numpy()[rows][:, None]
                d = _distances(unit(batch["embedding"].iloc[rows].tolist()), p)
                apart = _distances(p, p)[own]
                go = (d <= radius[key] + r + SLACK) & (d <= near + 2 * r + SLACK) & (d * d - near * near <= 2 * r * apart + SLACK)
                go &= np.arange(len(p)) < own[:, None]
                for cell in np.flatnonzero(go.any(axis=0)):
                    yield batch.iloc[rows[go[:, cell]]].drop(columns="near").assign(cell=cell, visitor=True)
    return run


def _join(cosine: float):
    """Of one pair of blocks: (cls, null, links) and spanning edges (a, b, 0)."""
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"]], group[~group["left"]]
        same = key[3] == key[4]
        right = left if same else right
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "int64", "b": "Int64", "n": "int64"})
        x, y = unit(left["embedding"].tolist()), unit(right["embedding"].tolist())
        i, j = np.nonzero(x @ y.T >= cosine)
        if same:
            i, j = i[i < j], j[i < j]
        a, b = left["cls"].to_numpy(np.int64), right["cls"].to_numpy(np.int64)
        links_a = np.bincount(i, right["copies"].to_numpy(np.int64)[j], len(a)).astype(np.int64)
        links_b = np.bincount(j, left["copies"].to_numpy(np.int64)[i], len(b)).astype(np.int64)
        node, root = star_edges(a[i], b[j])
        n = np.concatenate((links_a, links_b))
        out = pd.DataFrame({"a": np.concatenate((a, b))[n > 0], "b": pd.array([None] * int((n > 0).sum()), dtype="Int64"), "n": n[n > 0]})
        return pd.concat([out, pd.DataFrame({"a": node, "b": pd.array(root, dtype="Int64"), "n": np.zeros(len(node), np.int64)})])
    return run


def _choose(classes: DataFrame) -> Pivots:
    """Pivots of the labels that have over a cell's worth of vectors: those
    with the smallest hashes, as many as cells."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cell = max(CELL, math.ceil(total / MAX_PIVOTS))
    wanted = sizes.where(F.col("n") > cell).select("label", "dim", F.ceil(F.col("n") / cell).alias("cells"))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("k2", "k1"))
    picked = (classes.select("label", "dim", "k1", "k2").withColumn("rank", rank).where(F.col("rank") <= MAX_PIVOTS + 1)
              .join(wanted, ["label", "dim"]).where("rank <= cells").drop("cells"))
    rows = classes.select("label", "dim", "k1", "k2", "embedding").join(picked, ["label", "dim", "k1", "k2"]).drop("k1", "k2").toPandas()
    return {key: unit(x.sort_values("rank")["embedding"].tolist()) for key, x in rows.groupby(["label", "dim"])}


def _blocks(dealt: DataFrame) -> DataFrame:
    """Each row in every pair of blocks (i, j) of its cell that needs it: i is
    a block of members, j a later one or a block of visitors."""
    cell = ["label", "dim", "cell"]
    size = dealt.groupBy(*cell).agg(F.ceil(F.sum((~F.col("visitor")).cast("int")) / BLOCK).cast("int").alias("own"),
                                    F.ceil(F.sum(F.col("visitor").cast("int")) / BLOCK).cast("int").alias("guests"))
    rows = dealt.join(size, cell).where("own > 0")
    at = F.pmod(F.xxhash64("cls", F.lit(3)), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("own")).cast("long")).cast("int")
    rows = rows.withColumn("at", at + F.when(F.col("visitor"), F.col("own")).otherwise(0))
    last = F.col("own") + F.col("guests") - 1
    as_left = F.transform(F.sequence(F.col("at"), last), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    to = F.least(F.col("at"), F.col("own")) - 1
    as_right = F.when(to >= 0, F.transform(F.sequence(F.lit(0), to), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(False).alias("left"))))
    none = F.slice(as_left, 1, 0)
    places = F.when(F.col("visitor"), F.coalesce(as_right, none)).otherwise(F.concat(as_left, F.coalesce(as_right, none)))
    return rows.select(*cell, "cls", "copies", "embedding", F.inline(places))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: vec_id, n_links
    (other vectors of the label within the cosine), component_id (smallest
    vec_id reachable by links, itself included), kept (vec_id is that).

    Vectors that are null, empty, zero or hold a null or non-finite component,
    and those with a null label, link with nothing; vectors of different
    dimensions don't link. Repeated rows are vectors of their own, and
    so are rows that share a vec_id. A null vec_id links others, and is its
    component's id only where there is no other.
    """
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists(e, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"),
                          F.xxhash64("embedding").alias("k1"), F.xxhash64(F.reverse("embedding"), F.lit(11)).alias("k2"))
    # a class has a number of its own, since one vec_id may stand at several vectors
    classes = cut_lineage(rows.where("good").groupBy("label", F.size("embedding").alias("dim"), "k1", "k2").agg(
        F.min("vec_id").cast("long").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    pivots = _choose(classes)
    own = classes.schema
    kinds = f"label {own['label'].dataType.simpleString()}, dim int, cls long, copies long, embedding {own['embedding'].dataType.simpleString()}, cell long"
    assigned = cut_lineage(classes.select("label", "dim", "cls", "copies", "embedding").mapInPandas(_assign(pivots), f"{kinds}, near double"), "cells")
    radius = {k: np.full(len(p), -1.0) for k, p in pivots.items()}
    if pivots:
        for label, dim, cell, near in assigned.groupBy("label", "dim", "cell").agg(F.max("near")).where(F.col("max(near)") >= 0).collect():
            radius[label, dim][cell] = near  # as many rows as there are pivots
    dealt = cut_lineage(assigned.mapInPandas(_visit(pivots, radius, math.sqrt(2 - 2 * cosine)), f"{kinds}, visitor boolean"), "dealt")
    found = cut_lineage(_blocks(dealt).groupBy("label", "dim", "cell", "i", "j").applyInPandas(_join(cosine), "a long, b long, n long"), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    rooted = cut_lineage(classes.select("label", "k1", "k2", "cls", "copies", "least").join(links, "cls", "left")
                         .join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
    named = (rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
             .select(F.col("label").alias("of_label"), F.col("k1").alias("of_k1"), F.col("k2").alias("of_k2"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.drop("embedding").join(named, F.expr("good AND label = of_label AND k1 = of_k1 AND k2 = of_k2"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a
"""
