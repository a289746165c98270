"""Which sets are contained in a row's set: the join behind the graph and the
keyword retrieval.

The log's sets are written in one order of their items, rarest first, so that
they share their beginnings. Rows walk along these beginnings item by item: a
row is extended by those of its own later items that lead to a beginning of
some set. A beginning that a row holds is one row, however many sets begin
so, and a set whose rarest items a row lacks costs it nothing. Steps are joins
with small tables, broadcast after a size check, so rows stay where they are
and nothing is shuffled between the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage

#: Items of a set that steps look for; what a longer set has more is checked within the row.
DEPTH = 4


def contained(rows: DataFrame, sets: DataFrame, nbytes: int) -> DataFrame:
    """``rows`` once per distinct set that they contain, with ``mult`` (the
    product of the counts of its items) and ``asks`` (the asks of that set).

    ``rows`` has ``hits``, its items as ARRAY<STRUCT<item, cnt>>; ``sets`` is
    (need, ask) of ``nbytes`` at most, with ``need`` a non-empty array of
    distinct items. Items of both stand in one and the same order of all
    items, ``mult`` counts the first ``DEPTH`` items of a set.
    """
    base = cut_lineage(sets.groupBy("need").agg(F.collect_list("ask").alias("asks")).withColumn("s", F.monotonically_increasing_id()), "sets")
    least, most = base.agg(F.min(F.size("need")), F.max(F.size("need"))).first()
    least, most = least or 1, most or 1  # no sets: one step, without rows
    depth = min(DEPTH, most)
    # The number of each beginning of 1 to ``depth`` items.
    size = F.size("need")
    begun = base.select("s", "need")
    for i in range(1, depth + 1):
        names = begun.where(size >= i).groupBy(F.slice("need", 1, i).alias("_begin")).agg((F.min("s") * (DEPTH + 1) + i).alias(f"c{i}"))
        begun = begun.join(names, (size >= i) & (F.slice("need", 1, i) == F.col("_begin")), "left").drop("_begin")
    begun = cut_lineage(begun.withColumn("end", F.coalesce(*[f"c{i}" for i in range(depth, 0, -1)])), "beginnings")

    # Items with their places, and a last one that is null, over which sets that end before go on. No step
    # has a lambda, which Spark interprets, so that all of them are compiled into one loop.
    item = rows.schema["hits"].dataType.elementType["item"].dataType
    end = F.array(F.struct(F.lit(None).cast(item).alias("item"), F.lit(1).cast("bigint").alias("cnt"), (F.size("hits") + 1).alias("at")))
    placed = F.concat(F.transform("hits", lambda h, j: F.struct(h["item"].alias("item"), h["cnt"].cast("bigint").alias("cnt"), (j + 1).alias("at"))), end)
    keep = [c for c in rows.columns if c != "hits"]
    state = rows.select(*keep, *(["hits"] if most > depth else []), placed.alias("_all"), F.lit(1).cast("bigint").alias("mult"), F.lit(0).cast("bigint").alias("_c"), F.lit(0).alias("_at"))
    kept = state.columns[:-3]
    for i in range(1, depth + 1):
        edges = begun.where(size >= i).select((F.col(f"c{i - 1}") if i > 1 else F.lit(0).cast("bigint")).alias("_from"),
                                              F.col("need")[i - 1].alias("_item"), F.col(f"c{i}").alias("_next"))
        if least < i:  # some sets end before: their rows stay
            edges = edges.unionByName(begun.where(size < i).select(F.col("end").alias("_from"), F.lit(None).cast(edges.schema["_item"].dataType).alias("_item"),
                                                                   F.col("end").alias("_next")))
        later = F.slice("_all", F.col("_at") + 1, F.size("_all"))
        steps = state.select(*kept, "mult", "_c", "_at", F.explode_outer(later).alias("_h"))
        edges = bounded_broadcast(edges.distinct(), nbytes)
        state = (steps.join(edges, (F.col("_c") == F.col("_from")) & F.col("_h.item").eqNullSafe(F.col("_item")))
                      .select(*kept, (F.col("mult") * F.coalesce(F.col("_h.cnt"), F.lit(1))).alias("mult"), F.col("_next").alias("_c"), F.coalesce(F.col("_h.at"), F.col("_at")).alias("_at")))
    ends = begun.select("s", F.col("end").alias("_end"), F.slice("need", depth + 1, F.greatest(size, F.lit(1))).alias("_rest")).join(base.select("s", "asks"), "s").drop("s")
    found = state.join(bounded_broadcast(ends, nbytes), F.col("_c") == F.col("_end"))
    if most > depth:
        items = F.transform("hits", lambda h: h["item"])
        found = found.where(F.size(F.array_except("_rest", items)) == 0)
    return found.select(*keep, "mult", "asks")
