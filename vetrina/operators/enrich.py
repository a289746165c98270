"""Enrichment (C12-C14): product facts and attribute tables joined to nodes.

Joins are plain equi-joins; Catalyst/AQE pick broadcast for a small attribute
side and sort-merge (with skew splitting) otherwise. Nodes keep their unknown
keys: only ``additionalProperty`` and ``category`` are rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import bounded_broadcast, cut_lineage
from .extract import node_id


def attach_facts(catalogue: DataFrame, facts: DataFrame, left_on: str = "permalink",
                 right_on: str = "link") -> DataFrame:
    """Catalogue left join facts; duplicate facts multiply rows; NULL
    keys never join (SQL semantics).

    The facts, which are extracted from pages, are written once. Matches are
    an inner join, where AQE may split either side, so a page crawled into a
    huge group of copies is no single task (a left join's right side can't be
    split); rows without a match come from an anti join with the distinct
    links, a partial aggregation.
    """
    facts = cut_lineage(facts, "page-facts")
    matched = catalogue.join(facts, catalogue[left_on] == facts[right_on])
    links = facts.select(F.col(right_on).alias("_link")).distinct()
    alone = catalogue.join(links, catalogue[left_on] == links["_link"], "left_anti")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields]
    return matched.unionByName(alone.select("*", *empty))


def latest_by_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key, the row that is last by ``order`` wins.

    ``max_by`` over a struct keeps a NULL cell of the winning row (a per-column
    ``last`` would skip it). A partial aggregate: each task keeps one row per
    key before the shuffle, so a hot key costs one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in (columns or df.columns) if c not in keys]
    row = F.struct(*[F.col(c) for c in cols])
    pos = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.max_by(row, pos).alias("_r"))
              .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def with_position(df: DataFrame) -> DataFrame:
    """Row position of a file-based table, which sorts rows as the files have
    them: (file path, row index) where the format counts rows, else (file
    path, start of the split, number that rises within the split), as for CSV,
    JSON and text. Take it before filters, on the table as it was read."""
    path = F.col("_metadata.file_path").alias("file")
    if "row_index" in df.select("_metadata").schema["_metadata"].dataType.names:
        return df.withColumn("_pos", F.struct(path, F.col("_metadata.row_index").alias("row")))
    return df.withColumn("_pos", F.struct(path, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")))


def with_line_number(df: DataFrame, name: str = "line") -> DataFrame:
    """``df``, a table as it was read from line-based files, with each row's
    number in its file, from 0. Rows are counted per split, and a split's
    first number is the sum of those before it; no file is read as a whole by
    one task, and the only sorted table has a row per split."""
    placed = cut_lineage(with_position(df), "lines")
    first = placed.groupBy(F.col("_pos.file").alias("_file"), F.col("_pos.split").alias("_split")).agg(
        F.min("_pos.row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    starts = first.select("_file", "_split", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = placed.join(bounded_broadcast(starts), (F.col("_pos.file") == F.col("_file")) & (F.col("_pos.split") == F.col("_split")))
    return numbered.select(*df.columns, (F.col("_pos.row") + F.col("_shift")).alias(name))


def _attributes(attrs: DataFrame, key: str, capacity: str, scent: str, category: str,
                order: Sequence[str] | None) -> DataFrame:
    """The attributes of each key, its last row by ``order`` (C13): by
    default the file position of ``with_position`` if the table has it, else
    the values themselves, so that a node never gets two rows."""
    cols = [F.col(key).alias("_k"), F.col(capacity).alias("_cap"), F.col(scent).alias("_scent"), F.col(category).alias("_cat")]
    by = list(order or (["_pos"] if "_pos" in attrs.columns else []))
    last = attrs.where(F.col(key).isNotNull()).select(*cols, F.struct(*by, capacity, scent, category).alias("_order"))
    return latest_by_key(last, "_k", ["_order"], ["_cap", "_scent", "_cat"])


def _prop(name: str, value: Column) -> Column:
    return F.struct(F.lit("PropertyValue").alias("@type"), F.lit(name).alias("name"), value.alias("value"))


def enrich_typed(products: DataFrame, attrs: DataFrame, *, key: str = "permalink",
                 capacity: str = "capacity", scent: str = "scent_group", category: str = "category",
                 order: Sequence[str] | None = None) -> DataFrame:
    """C14 on typed product rows (uri, category, properties, ...). Of several
    attribute rows of one permalink the last by ``order`` counts (C13).

    C14a appends {PropertyValue, Capacita, v} when v is not NULL; C14b appends
    {PropertyValue, Gruppo Olfattivo, v} when v is neither NULL nor ''; C14c
    replaces the category when the new one is not NULL. Unmatched rows pass.
    """
    a = _attributes(attrs, key, capacity, scent, category, order)
    j = products.join(a, T.strip_suffix(F.col("uri")) == F.col("_k"), "left")
    prop_t = "struct<`@type` string, name string, value string>"
    add_cap = F.when(F.col("_cap").isNotNull(), F.array(_prop(V.PROP_CAPACITY, F.col("_cap"))))
    add_scent = F.when(F.col("_scent").isNotNull() & (F.col("_scent") != ""),
                       F.array(_prop(V.PROP_SCENT, F.col("_scent"))))
    empty = F.array().cast(f"array<{prop_t}>")
    props = F.concat(F.coalesce(F.col("properties"), empty), F.coalesce(add_cap, empty),
                     F.coalesce(add_scent, empty))
    return (j.withColumn("properties", props)
             .withColumn("category", F.coalesce(F.col("_cat"), F.col("category")))
             .drop("_k", "_cap", "_scent", "_cat"))


def enrich_nodes(nodes: DataFrame, attrs: DataFrame, *, key: str = "permalink", capacity: str = "capacity",
                 scent: str = "scent_group", category: str = "category",
                 order: Sequence[str] | None = None) -> DataFrame:
    """C14 on VARIANT nodes: product nodes ⟕ attributes; every other node and
    every unknown key unchanged; node count and order columns kept. Of several
    attribute rows of one permalink the last by ``order`` counts (C13)."""
    a = _attributes(attrs, key, capacity, scent, category, order)
    is_prod = F.col("type") == "Product"
    j = nodes.join(a, is_prod & (T.strip_suffix(node_id()) == F.col("_k")), "left")
    n = F.col("node")
    existing = F.coalesce(
        F.try_variant_get(n, "$.additionalProperty", "array<variant>"),
        F.when(F.try_variant_get(n, "$.additionalProperty", "map<string,variant>").isNotNull(),
               F.array(F.try_variant_get(n, "$.additionalProperty", "variant"))),
        F.array().cast("array<variant>"))

    def prop(name, value):
        return F.array(F.to_variant_object(_prop(name, value)))

    # Conditions on the joined cells only: a lambda evaluates them for every field of a node.
    has_cap, has_cat = F.col("_cap").isNotNull(), F.col("_cat").isNotNull()
    has_scent = F.coalesce(F.col("_scent") != "", F.lit(False))
    has_props = has_cap | has_scent
    empty = F.array().cast("array<variant>")
    add_cap = F.when(has_cap, prop(V.PROP_CAPACITY, F.col("_cap"))).otherwise(empty)
    add_scent = F.when(has_scent, prop(V.PROP_SCENT, F.col("_scent"))).otherwise(empty)
    appended = F.concat(existing, add_cap, add_scent)
    fields = F.try_variant_get(n, "$", "map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: ~((has_props & (k == "additionalProperty")) | (has_cat & (k == "category"))))
    updates = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("additionalProperty").alias("key"), F.to_variant_object(appended).alias("value")),
        F.struct(F.lit("category").alias("key"), F.col("_cat").cast("variant").alias("value")),
    ), lambda e: F.when(e["key"] == "category", has_cat).otherwise(has_props)))
    new_node = F.to_variant_object(F.map_concat(kept, updates))
    touched = F.col("_k").isNotNull() & (has_props | has_cat)
    return (j.withColumn("node", F.when(touched, new_node).otherwise(n))
             .drop("_k", "_cap", "_scent", "_cat"))
