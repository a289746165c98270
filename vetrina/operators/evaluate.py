"""Evaluation (F1-F10): precision, recall and F1 per query and system, macro
averages per slice.

Answers and truth stay long ((query_id, id) rows) and are compared as sets of
ID strings, all systems by one aggregation over (query, id) that sets a bit for
the truth and for each system; what is joined has a row per query. Slices are
one ``explode`` of a 2-element array, so the data are read once for all of
them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Systems that one aggregation scores: bits of a mark besides the truth's.
BITS = 62
#: Rows of truth and answers that a task compares, about.
PART_IDS = 2_000_000


def _whole(*tables: DataFrame) -> bool:
    return all(isinstance(t.schema["id"].dataType, Ty.IntegralType) for t in tables)


def as_id_set(answers: DataFrame, *keys: str, mark: str | None = None) -> DataFrame:
    """IDs compared as strings, duplicates removed. Whole numbers are equal
    where their texts are and stay numbers. ``mark``: each ID has the bits
    of all its rows in this column."""
    ids = F.col("id") if _whole(answers) else F.col("id").cast("string")
    if mark is None:
        return answers.select(*keys, ids.alias("id")).distinct()
    return answers.select(*keys, ids.alias("id"), mark).groupBy(*keys, "id").agg(F.bit_or(mark).alias(mark))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def f1(p: Column, r: Column) -> Column:
    """2PR / (P + R), 0 when P + R = 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def log_answers(log: DataFrame, systems: dict[str, str], keys: Sequence[str] = ("file", "query_id")) -> DataFrame:
    """Saved entries to long answers (*keys, system, id): ``systems`` names
    the ID list of each system. A missing or empty list gives no rows."""
    pairs = F.array(*[F.struct(F.lit(s).alias("system"), F.col(field).alias("ids")) for s, field in systems.items()])
    return log.select(*keys, F.inline(pairs)).select(*keys, "system", F.explode("ids").alias("id"))


def per_query(queries: DataFrame, truth: DataFrame, answers: DataFrame, systems: Sequence[str],
              keys: Sequence[str] = ("query_id",), rows: int | None = None) -> DataFrame:
    """(*keys, system, n_truth, n_answer, tp, precision, recall, f1).

    ``truth``: (*keys, id); ``answers``: (*keys, system, id); ``keys`` tell
    queries apart, such as a log's file and query id. Every query appears once
    per system (an unanswered query scores 0). ``truth`` and ``answers`` are read
    once, and ids are shuffled once, for all systems. Keys that are texts travel
    as a 96-bit hash (xxhash64 and murmur3). ``rows``: how many ``truth`` and
    ``answers`` have, where that is known; the number of tasks goes by it then.
    Equal ids meet after that one shuffle, not in front of it also, where a task
    of a few long lists would hold all of their ids at once.
    """
    if len(systems) > BITS:
        some = [per_query(queries, truth, answers, systems[i:i + BITS], keys, rows) for i in range(0, len(systems), BITS)]
        return reduce(DataFrame.unionByName, some)
    k = list(keys)
    grid, by, own = queries.select(*k).distinct(), k, k
    if all(t.schema[c].dataType == Ty.StringType() for t in (queries, truth, answers) for c in k):
        by, own = ["_u1", "_u2"], [F.xxhash64(*k).alias("_u1"), F.hash(*k).alias("_u2")]
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in k])  # a key with a null is equal to none
        truth, answers = truth.where(known), answers.where(known)
        grid = grid.select("*", *[F.when(known, h).alias(n) for n, h in zip(by, own)])
    id_type = "bigint" if _whole(truth, answers) else "string"
    bits = {s: 2 << i for i, s in enumerate(systems)}
    bit = F.coalesce(F.lit(None).cast("bigint"), *[F.when(F.col("system") == s, F.lit(b).cast("bigint")) for s, b in bits.items()])
    marked = (truth.select(*own, F.col("id").cast(id_type).alias("id"), F.lit(1).cast("bigint").alias("mark"))
              .unionByName(answers.where(F.col("system").isin(list(bits))).select(*own, F.col("id").cast(id_type).alias("id"), bit.alias("mark"))))

    def n(mask):
        return F.count_if(F.col("mark").bitwiseAND(F.lit(mask).cast("bigint")) == mask)

    both = F.col("id").isNotNull()  # a null id counts where it is, and is equal to none
    session = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = [max(session, -(-rows // PART_IDS))] if rows is not None else []
    found = as_id_set(marked.repartition(*dealt, *by, "id"), *by, mark="mark").groupBy(*by).agg(
        n(1).alias("n_truth"), *[n(b).alias(f"_n{b}") for b in bits.values()],
        *[F.count_if(both & (F.col("mark").bitwiseAND(F.lit(b | 1).cast("bigint")) == b | 1)).alias(f"_tp{b}") for b in bits.values()])
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"_n{bits[s]}").alias("n_answer"), F.col(f"_tp{bits[s]}").alias("tp")) for s in systems]))
    j = (grid.join(found, by, "left").select(*k, "n_truth", each)
             .select(*k, "system",
                     *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_truth", "n_answer", "tp")]))
    p, r = ratio(F.col("tp"), F.col("n_answer")), ratio(F.col("tp"), F.col("n_truth"))
    return j.select("*", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", f1(F.col("precision"), F.col("recall")))


def macro(scores: DataFrame, group: Sequence[str | Column] = ("system",)) -> DataFrame:
    """averages over queries with a non-empty truth; ``query_count``
    counts every query of the group; 0 when nothing is averaged."""
    ev = F.col("n_truth") > 0

    def avg(c):
        return F.coalesce(F.avg(F.when(ev, F.col(c))), F.lit(0.0)).alias(c)

    return scores.groupBy(*group).agg(avg("precision"), avg("recall"), avg("f1"),
                                      F.count(F.lit(1)).alias("query_count"))


def slices(scores: DataFrame, has_feature: Column, group: Sequence[str] = ("system",)) -> DataFrame:
    """F8: slices 'all', 'without' and 'with' the feature, in one pass.
    ``has_feature`` is a boolean Column of the scored rows (NULL -> without)."""
    tagged = scores.withColumn("slice", F.explode(F.array(
        F.lit("all"), F.when(F.coalesce(has_feature, F.lit(False)), F.lit("with")).otherwise(F.lit("without")))))
    out = macro(tagged, ["slice", *group])
    # Every group shows all three slices; an empty slice has 0 queries and 0s.
    grid = (scores.select(*group).distinct()
            .withColumn("slice", F.explode(F.array(F.lit("all"), F.lit("with"), F.lit("without")))))
    return (grid.join(out, ["slice", *group], "left")
                .select("slice", *group,
                        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
                        F.coalesce(F.col("query_count"), F.lit(0)).cast("bigint").alias("query_count")))


def report(metrics: DataFrame, digits: int = 3) -> DataFrame:
    """rounded figures for printing."""
    return metrics.select(*[F.round(F.col(c), digits).alias(c) if c in ("precision", "recall", "f1") else F.col(c)
                            for c in metrics.columns])
