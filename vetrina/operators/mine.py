"""Ground-truth query mining.

A query is a set of (feature, value) pairs over five features; it is kept when
at least ``min_support`` catalogue rows match all of its predicates. Instead of
one full scan per candidate, every row emits the combinations it matches and
one aggregation counts them:

1. Per row, build its items: frequent brand, categories of the domain it
   contains, top capacity, labels and top label pairs, and its *tightest*
   price bucket (the smallest cap above its price). Caps nest, so a row that
   matches ``<30`` also matches every larger cap; carrying only the tightest
   bucket keeps the expansion free of the up-to-|caps| factor.
2. Expand the n-combinations with distinct features by a higher-order
   expression (no join, no shuffle) and count them with a partial
   (map-side) aggregation.
3. Roll bucket counts up to caps with an equi-join on a tiny (bucket, cap)
   table, then keep the combinations with support >= min_support.
4. Gather the IDs of supported queries only: re-expand and equi-join the row
   combinations on (key, bucket) with the supported queries spread over their
   buckets. Answers stay long, one row per (query_id, id); unsupported
   combinations never hold ID lists.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..session import bounded_broadcast, cut_lineage
from . import labels as L

_STR = "string"


def top_values(df: DataFrame, column: str, n: int = V.TOP_CAPACITIES) -> DataFrame:
    """The n most frequent non-null values; ties by value ascending."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), F.asc(column)).limit(n))


def frequent_values(df: DataFrame, column: str, min_count: int = V.MIN_VALUES) -> DataFrame:
    """Values with at least ``min_count`` rows."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_count))


def query_key(brand, category, capacity, olfactory, price) -> Column:
    """Query id: ``feature=value`` pairs joined by '&', absent features skipped."""
    parts = [F.concat(F.lit(f + "="), c) for f, c in zip(V.FEATURES, (brand, category, capacity, olfactory, price))]
    return F.concat_ws("&", *parts)


def _combos(items: dict[str, Column], n: int) -> Column:
    """All structs with one value per feature of every n-subset of features."""
    nul = F.lit(None).cast(_STR)

    def build(feats, bound):
        if not feats:
            return F.array(F.struct(*[(bound.get(f, nul)).alias(f) for f in V.FEATURES]))
        f, rest = feats[0], feats[1:]
        if not rest:
            return F.transform(items[f], lambda x: F.struct(
                *[(x if g == f else bound.get(g, nul)).alias(g) for g in V.FEATURES]))
        return F.flatten(F.transform(items[f], lambda x: build(rest, {**bound, f: x})))

    return F.concat(*[build(list(s), {}) for s in itertools.combinations(V.FEATURES, n)])


def feature_items(catalogue: DataFrame, *, categories: Sequence[str], caps: Sequence[int],
                  min_values: int = V.MIN_VALUES, top_capacities: int = V.TOP_CAPACITIES,
                  labels: Sequence[str] | None = tuple(V.LABELS), pairs: Sequence[str] | None = None,
                  top_pair_count: int = V.TOP_PAIR_COUNT) -> DataFrame:
    """Per row: (id, brand, category, capacity, olfactory_category, price) item arrays.

    ``price`` holds the tightest cap bucket (at most one). ``labels`` is the
    label domain (None: every label of the data); ``pairs=None`` takes the top
    pairs of the domain (C10). A label counts once a row.
    """
    # Small aggregates; AQE reuses their broadcast stages across the count and
    # gather passes of one plan.
    brands = frequent_values(catalogue, "brand", min_values).select(F.col("brand").alias("_fb"))
    caps_top = top_values(catalogue, "capacity", top_capacities).select(F.col("capacity").alias("_tc"))
    if pairs is None:
        # Bounded by top_pair_count: the only driver-side values in the plan.
        pairs = [r["pair"] for r in L.top_pairs(L.pair_counts(catalogue, domain=labels), top_pair_count).collect()]
    cats = F.array(*[F.lit(c) for c in categories])
    caps_sorted = F.array(*[F.lit(c) for c in sorted(caps)])
    singles = F.array_distinct(F.coalesce("labels", F.array().cast("array<string>")))
    if labels is not None:
        dom = F.array(*[F.lit(x) for x in labels])
        singles = F.filter(singles, lambda x: F.array_contains(dom, x))
    empty = F.array().cast("array<string>")
    bucket = F.array_min(F.filter(caps_sorted, lambda c: F.col("price") < c))
    # Frequent brands: bounded by distinct brands; AQE turns this join into a
    # broadcast when the aggregate is small, and top capacities are <= k rows.
    rows = (catalogue.select("id", "brand", "category", "capacity", "price", "labels")
            .join(brands, F.col("brand") == F.col("_fb"), "left")
            .join(F.broadcast(caps_top), F.col("capacity") == F.col("_tc"), "left"))
    return rows.select(
        "id",
        F.when(F.col("_fb").isNotNull(), F.array("brand")).otherwise(empty).alias("brand"),
        F.filter(cats, lambda c: F.coalesce(F.col("category").contains(c), F.lit(False))).alias("category"),
        F.when(F.col("_tc").isNotNull(), F.array("capacity")).otherwise(empty).alias("capacity"),
        F.concat(F.coalesce(singles, empty), L.keep_pairs(F.coalesce(F.col("labels"), empty), pairs))
         .alias("olfactory_category"),
        F.when(bucket.isNotNull(), F.array(bucket.cast(_STR))).otherwise(empty).alias("price"),
    )


def _bucket_table(spark, caps: Sequence[int]) -> DataFrame:
    """(bucket, cap) for every cap >= bucket, plus ('', NULL) for combinations
    without price: at most |caps|^2 / 2 + 1 rows."""
    cs = sorted(caps)
    rows = [(str(b), str(c)) for i, b in enumerate(cs) for c in cs[i:]] + [("", None)]
    return spark.createDataFrame(rows, "bucket string, cap string")


def mine_queries(catalogue: DataFrame, n: int, *, categories: Sequence[str] = V.CATEGORIES,
                 caps: Sequence[int] = V.PRICE_CAPS, min_support: int = V.MIN_SUPPORT,
                 **item_options) -> tuple[DataFrame, DataFrame]:
    """(queries, answers) for queries of exactly n features.

    queries: (query_id, n_features, brand, category, capacity,
              olfactory_category, price, support)
    answers: (query_id, id) -- the truth, long form.
    """
    spark = catalogue.sparkSession
    items = feature_items(catalogue, categories=categories, caps=caps, **item_options)
    cols = {f: F.col(f) for f in V.FEATURES}
    # An outer explode, as an inner one comes with a filter that expands the combinations a second time.
    row_combos = items.select("id", F.explode_outer(_combos(cols, n)).alias("c")).where(F.col("c").isNotNull()).select("id", "c.*")

    buckets = F.broadcast(_bucket_table(spark, caps))
    # One partial aggregation over the expanded rows, then the (small) counts
    # roll up from buckets to caps through the broadcast bucket table.
    counts = row_combos.groupBy(*V.FEATURES).agg(F.count(F.lit(1)).alias("cnt"))
    supported = (counts.join(buckets, F.coalesce(F.col("price"), F.lit("")) == F.col("bucket"))
                 .groupBy(*[F.col(f) for f in V.FEATURES[:-1]], F.col("cap").alias("price"))
                 .agg(F.sum("cnt").alias("support"))
                 .where(F.col("support") >= min_support))
    # Small, and read by the query table, the gather join and its size check:
    # written once so the expansion and count run once.
    supported = cut_lineage(supported, "supported")

    price_text = F.when(F.col("price").isNotNull(), F.concat(F.lit("<"), F.col("price")))
    queries = supported.select(
        query_key(*[F.col(f) for f in V.FEATURES[:-1]], price_text).alias("query_id"),
        F.lit(n).alias("n_features"),
        *[F.col(f) for f in V.FEATURES[:-1]],
        price_text.alias("price"),
        F.col("support").cast("bigint").alias("support"),
    )

    # Spread each supported query over the buckets that roll up into it, then
    # gather IDs with one equi-join on (base key, bucket).
    base = query_key(*[F.col(f) for f in V.FEATURES[:-1]], F.lit(None).cast(_STR))
    sup_keys = (supported.join(buckets, F.col("price").eqNullSafe(F.col("cap")))
                .select(F.concat_ws("|", base, F.col("bucket")).alias("k"),
                        query_key(*[F.col(f) for f in V.FEATURES[:-1]],
                                  F.when(F.col("price").isNotNull(), F.concat(F.lit("<"), F.col("price"))))
                        .alias("query_id")))
    row_keys = row_combos.select("id", F.concat_ws("|", base, F.coalesce(F.col("price"), F.lit(""))).alias("k"))
    # A hot key (one combination matching a third of the rows) stays on the
    # streamed side: the supported keys are broadcast after a size check.
    answers = row_keys.join(bounded_broadcast(sup_keys), "k").select("query_id", "id")
    return queries, answers
