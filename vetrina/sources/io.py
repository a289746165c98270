"""Sources and sinks.

Readers return DataFrames with a file key where the reference works per file
(``_metadata.file_name``); writers are plain DataFrame writers. Nothing is
read to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import extract as X
from ..operators.triples import to_ntriples
from .arrays import array_elements

QUERY_TYPE = T.StructType([T.StructField(f, T.StringType()) for f in
                           ("brand", "category", "capacity", "olfactory_category", "olfactory category", "price")])
#: ID lists of a log entry: the truth, then what each system answered.
RESULT_FIELDS = ("results", "original_results", "true_results", "sparql_results", "text_results", "llm_results")
LOG_SCHEMA = T.StructType([
    T.StructField("query", QUERY_TYPE),
    *(T.StructField(f, T.ArrayType(T.LongType())) for f in RESULT_FIELDS),
    *(T.StructField(f, T.StringType()) for f in ("sparql", "text_query", "llm_sparql", "_corrupt_record")),
])


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV, column ``permalink``; ``pos`` sorts rows as the files
    have them, over any number of splits."""
    df = spark.read.option("header", True).csv(path)
    return df.select("permalink", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                           F.monotonically_increasing_id().alias("at")).alias("pos"))


def read_graph(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A2: graph documents -> node rows (src, block, pos, id, type, node);
    ``src`` is the file's full path.

    ``lines=False``: each file is one document with ``@graph`` (default []);
    a file is one row, so use it for small documents. ``lines=True``: the
    scale form, one JSON node per line. A line's position is a hash of its
    text and of its number among equal lines of the file, so it doesn't depend
    on splits and retries.
    """
    if lines:
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), "value")
        same = Window.partitionBy("src", "value").orderBy("value")
        raw = raw.withColumn("pos", F.xxhash64("value", F.row_number().over(same)))
        nodes = raw.select("src", F.lit(0).alias("block"), "pos", F.try_parse_json("value").alias("node")).where(F.col("node").isNotNull())
    else:
        docs = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("url"), F.lit(0).alias("block"), F.try_parse_json("value").alias("doc"))
        nodes = X.explode_graph(docs).withColumnRenamed("url", "src")
    return nodes.select("src", "block", "pos", X.node_id().alias("id"), X.node_type().alias("type"), "node")


def write_graph(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON node per line, non-ASCII kept, every node kept."""
    nodes.select(F.to_json("node").alias("value")).write.mode(mode).text(path)


def read_query_log(spark: SparkSession, path: str, glob: str | None = None, multi_line: bool = False,
                   schema=LOG_SCHEMA) -> DataFrame:
    """A3/A4: JSON Lines, or JSON arrays of entries with ``multi_line`` (a
    task per file then; ``read_log_arrays`` splits them), one row per entry,
    with the file name. ``glob`` filters by suffix (``*_LLM.json``)."""
    r = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return _entries(r.json(path), F.col("_metadata.file_name"))


def read_logs(spark: SparkSession, path: str, suffix: str = "_LLM.json", multi_line: bool = False, schema=LOG_SCHEMA) -> DataFrame:
    """A4: all logs below ``path`` whose name ends in ``suffix``, each a file
    or a folder of part files; ``file`` is the name that was found. What can't
    be parsed comes as rows with ``_corrupt_record`` (see ``valid_entries``),
    so a broken log is reported and the others are read."""
    r = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True)  # logs differ in their folders
    name = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]*" + re.escape(suffix) + ")(?:/|$)", 1)
    return _entries(r.json(f"{path.rstrip('/')}/*{suffix}"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))


def read_log_arrays(spark: SparkSession, path: str, glob: str | None = None, schema=LOG_SCHEMA) -> DataFrame:
    """A3 at scale: as ``read_query_log`` for files that hold one JSON array
    each, of any size; an array's splits are read by different tasks (see
    ``arrays.array_elements``). ``_pos`` is the entry's number in its file."""
    entry = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = array_elements(spark, path, glob).select("path", "pos", entry.alias("_e"))
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    return _entries(rows.select("_e.*", name.alias("_name"), F.col("pos").alias("_pos")), F.col("_name")).drop("_name")


def _entries(log: DataFrame, file) -> DataFrame:
    df = log.withColumn("file", file)
    q = F.col("query")
    # Q15: the slot name may be written with a space.
    fixed = F.when(q.isNotNull(), F.struct(
        q["brand"].alias("brand"), q["category"].alias("category"), q["capacity"].alias("capacity"),
        F.coalesce(q["olfactory_category"], q["olfactory category"]).alias("olfactory_category"),
        q["price"].alias("price")))
    return df.withColumn("query", fixed)


def valid_entries(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with a query, errors for the rest); one bad file does not
    stop the others (PERMISSIVE read, per-row filter)."""
    ok = log.where(F.col("query").isNotNull())
    bad = log.where(F.col("query").isNull()).select(
        "file", F.coalesce(F.col("_corrupt_record"), F.lit("no query")).alias("error"))
    return ok, bad


def read_id_csv(spark: SparkSession, path: str) -> DataFrame:
    """A5: every cell of every row as BIGINT, long: (file, id). Bad cells are
    dropped one by one (the reference keeps the prefix read before the first
    bad cell). ``id_lists`` gathers small files."""
    cells = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"),
                                         F.explode(F.split("value", ",")).alias("cell"))
    return cells.select("file", F.trim("cell").try_cast("bigint").alias("id")).where(F.col("id").isNotNull())


def id_lists(ids: DataFrame) -> DataFrame:
    """A5 as lists, for small files: (file, ids ARRAY<BIGINT> sorted)."""
    return ids.groupBy("file").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", blank_to_null: bool = True) -> DataFrame:
    """Tabular load; empty string cells become NULL (as a spreadsheet load)."""
    r = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = r.format(fmt).load(path)
    if not blank_to_null:
        return df
    return df.select(*[F.when(F.trim(F.col(f.name)) != "", F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Tabular save."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_query_log(queries: DataFrame, answers: dict[str, DataFrame], path: str, mode: str = "overwrite",
                    lists: bool = False) -> None:
    """The query log, one file set per query size (``partitionBy n_features``).

    ``answers`` maps a field name (``results``, ``sparql_results`` ...) to long
    answers (query_id, id[, solutions]). By default the log is written long:
    ``{path}/queries`` (JSON, one entry per query) and ``{path}/<name>``
    (Parquet rows query_id, id, solutions), so no answer list is ever held in
    one row. ``lists=True`` writes the reference layout (one JSON entry with
    an ID list per field); use it only for logs whose answers are small.
    """
    feats = ["brand", "category", "capacity", "olfactory_category", "price"]
    if not lists:
        queries.select("n_features", "query_id", F.struct(*[F.col(f) for f in feats]).alias("query")) \
            .write.mode(mode).partitionBy("n_features").json(f"{path}/queries")
        sizes = queries.select("query_id", "n_features")
        for name, ans in answers.items():
            sol = ans if "solutions" in ans.columns else ans.withColumn("solutions", F.lit(1).cast("bigint"))
            sol.select("query_id", "id", "solutions").join(sizes, "query_id") \
                .write.mode(mode).partitionBy("n_features").parquet(f"{path}/{name}")
        return
    # One aggregation gathers all lists. Query ids that are texts begin alike, so rows are sorted by their hash.
    texts = all(t.schema["query_id"].dataType == T.StringType() for t in (queries, *answers.values()))
    h = (F.xxhash64("query_id") if texts else F.lit(0).cast("bigint")).alias("_h")
    rows = None
    for name, ans in answers.items():
        reps = ans
        if "solutions" in ans.columns:
            reps = ans.select("query_id", F.explode(F.array_repeat("id", F.col("solutions").cast("int"))).alias("id"))
        reps = reps.select(h, "query_id", F.col("id").alias(name))
        rows = reps if rows is None else rows.unionByName(reps, allowMissingColumns=True)
    out = queries
    if rows is not None:
        lists = rows.groupBy("_h", "query_id").agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in answers])
        out = queries.withColumn("_h", h).join(lists, ["_h", "query_id"], "left").select(
            *queries.columns, *[F.coalesce(name, F.array().cast("array<bigint>")).alias(name) for name in answers])
    query = F.struct(*[F.col(f) for f in feats])
    cols = [c for c in answers]
    out.select("n_features", "query_id", query.alias("query"), *cols).write.mode(mode) \
        .partitionBy("n_features").json(path)


def write_triples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """N-Triples text, partitioned by predicate (predicate pruning on read)."""
    lines = to_ntriples(triples).withColumn("p", F.regexp_replace("p", r"[^A-Za-z0-9]+", "_"))
    lines.write.mode(mode).partitionBy("p").text(path)
