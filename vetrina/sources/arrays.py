"""JSON arrays read by many tasks.

A file that holds one array, also on a single line, is read in pieces that end
at ``}``, so its splits go to different tasks. Whether a piece starts within a
string, and how deep it is, follows from the pieces before it: each split is
summed up by its quote parity and by its change of depth for either state, and
prefix sums over the splits, a row each, give every split its start. An element
ends at the ``}`` that leads back to depth one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.enrich import with_position
from ..session import bounded_broadcast, cut_lineage

_LEAD = r"^[\x{FEFF}\s,\[]+"
_NOTHING = r"^[\x{FEFF}\s,\[\]]*$"


def _net(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(text, "}]", "")) - F.length(F.translate(text, "{[", ""))


def _pieces(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(path, split, row, value; quotes: parity of the quotes in it; out,
    within: change of depth where it starts outside or within a string)."""
    r = spark.read.option("lineSep", "}")
    rows = with_position((r.option("pathGlobFilter", glob) if glob else r).text(path))
    # A backslash stands in strings only, and never alone in front of the cut.
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    rows = rows.select("_pos.file", "_pos.split", "_pos.row", "value", parts.alias("parts")).withColumnRenamed("file", "path")
    quotes = (F.size("parts") - 1) % 2
    even = F.array_join(F.filter("parts", lambda x, i: i % 2 == 0), "")
    odd = F.array_join(F.filter("parts", lambda x, i: i % 2 == 1), "")
    return rows.select("path", "split", "row", "value", quotes.alias("quotes"), (_net(even) - (1 - quotes)).cast("long").alias("out"),
                       (_net(odd) - quotes).cast("long").alias("within"))


def array_elements(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, pos, value): the text of every object of the top-level arrays in
    the files at ``path``, and its number in its file, from 0.

    A row is held by the size of one element, a task by the size of one split.
    Text that belongs to no whole object (a cut-off array, other values) comes
    with the element behind it or, at the end, as a row of its own, so that a
    parser reports it. Commas aren't checked. Empty files and arrays give no
    rows. The pieces are written once, for ``session.drop_intermediates``.
    """
    here = Window.partitionBy("path", "split").orderBy("row")
    before, up_to = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(what, window):
        return F.coalesce(F.sum(what).over(window), F.lit(0))

    # Sums within the split, for a split that starts outside (0) or within (1) a string.
    rows = _pieces(spark, path, glob).withColumn("quoted", so_far("quotes", before) % 2)
    for state in (0, 1):
        rows = rows.withColumn(f"depth{state}", F.sum(F.when(F.col("quoted") == state, F.col("out")).otherwise(F.col("within"))).over(up_to))
    rows = cut_lineage(rows.drop("out", "within"), "pieces")

    splits = rows.groupBy("path", "split").agg((F.sum("quotes") % 2).alias("odd"), F.max_by("depth0", "row").alias("d0"), F.max_by("depth1", "row").alias("d1"))
    splits = splits.withColumn("state", so_far("odd", earlier) % 2)
    splits = splits.withColumn("base", so_far(F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1")), earlier))
    starts = bounded_broadcast(cut_lineage(splits.select("path", "split", "state", "base"), "split-starts"))

    depth = F.col("base") + F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    outside = (F.col("state") + F.col("quoted") + F.col("quotes")) % 2 == 0
    rows = rows.join(starts, ["path", "split"]).select("path", "split", "row", "value", (outside & (depth == 1)).cast("int").alias("ends"))
    ended = rows.groupBy("path", "split").agg(F.sum("ends").alias("n"))
    shift = bounded_broadcast(cut_lineage(ended.select("path", "split", so_far("n", earlier).alias("shift")), "split-elements"))
    rows = rows.withColumn("nth", so_far("ends", before)).join(shift, ["path", "split"])

    whole = rows.groupBy("path", (F.col("nth") + F.col("shift")).alias("pos")).agg(
        F.array_sort(F.collect_list(F.struct("split", "row", "value"))).alias("parts"), F.max("ends").alias("ends"))
    text = F.array_join(F.transform("parts", lambda x: x["value"]), "}")
    text = F.when(F.col("ends") == 1, F.concat(text, F.lit("}"))).otherwise(text)
    return (whole.select("path", "pos", text.alias("value"), "ends").where((F.col("ends") == 1) | ~F.col("value").rlike(_NOTHING))
                 .select("path", "pos", F.regexp_replace("value", _LEAD, "").alias("value")))
