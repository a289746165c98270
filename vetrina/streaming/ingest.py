"""Incremental page ingestion (A10) with Structured Streaming.

The reference walks a URL list and saves a progress index every 5 URLs; here
a file source of crawl tables is the list, ``maxFilesPerTrigger`` the batch
size and the checkpoint the progress index: a stopped job resumes exactly
where it left, and every batch is committed once to an append-only sink
(no whole-file rewrite per checkpoint).

``ingest_crawl`` is the whole job in one stream: a page is parsed once for its
products and its rejects, and ``current`` gives what the last crawl of each url
left, so a page that is crawled again replaces its products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract as X

PAGE_SCHEMA = "url string, status int, html string"
#: Where a page's row stands: batch, then the file's time and name, then the row in it.
PLACE = ["modified", "file", "row"]
CRAWL_SCHEMA = ("url string, modified timestamp, file string, row bigint, block int, pos int, id string, type string, "
                "node string, reason string, detail string, batch bigint, kind string")


def _pages(spark: SparkSession, source: str, max_files: int) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(source)


def product_stream(spark: SparkSession, source: str, max_files: int = 5) -> DataFrame:
    """Streaming product nodes of the crawl tables arriving in ``source``."""
    products, _ = X.extract_products(_pages(spark, source, max_files))
    return products.select("src", "block", "pos", "id", "type", F.to_json("node").alias("node"))


def reject_stream(spark: SparkSession, source: str, max_files: int = 5) -> DataFrame:
    """Streaming rejects (url, reason, detail) of the same crawl tables."""
    return X.extract_products(_pages(spark, source, max_files))[1]


def _start(rows: DataFrame, sink: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink)


def ingest_pages(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 5,
                 available_now: bool = True) -> StreamingQuery:
    """Start (or resume) the ingestion; ``available_now`` processes what is
    there in batches of ``max_files`` files and stops."""
    return _start(product_stream(spark, source, max_files), sink, checkpoint, available_now)


def ingest_rejects(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 5,
                   available_now: bool = True) -> StreamingQuery:
    """The same for rejected pages and blocks, into a sink and checkpoint of
    their own."""
    return _start(reject_stream(spark, source, max_files), sink, checkpoint, available_now)


def _crawl_rows(pages: DataFrame) -> DataFrame:
    """Rows of three kinds for crawl rows with their place: ``page`` (one a
    row: the url was crawled), ``product`` and ``reject``. Only the parse reads
    html, once; the others need url and status."""
    marks = pages.select("url", *PLACE, F.lit("page").alias("kind"))
    status = (pages.where(F.col("status").isNull() | (F.col("status") != 200))
                   .select("url", *PLACE, F.lit("reject").alias("kind"), F.lit("status").alias("reason"),
                           F.col("status").cast("string").alias("detail")))
    blocks = X.ld_json_blocks(pages.where(F.col("status") == 200), *PLACE).withColumn("doc", F.try_parse_json("body"))
    graph = F.try_variant_get("doc", '$["@graph"]', "array<variant>")
    good = X.is_object()
    nodes = blocks.select("url", *PLACE, "block", good.alias("good"), F.posexplode_outer(F.when(good, graph)).alias("pos", "item"))
    kind = F.when(~F.col("good"), "reject").when(X.is_product("item"), "product")
    parsed = nodes.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "url", *PLACE, "kind", "block", "pos", X.node_id("item").alias("id"), X.node_type("item").alias("type"),
        F.to_json("item").alias("node"), F.when(~F.col("good"), "json").alias("reason"),
        F.when(~F.col("good"), F.col("block").cast("string")).alias("detail"))
    return parsed.unionByName(status, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)


def ingest_crawl(spark: SparkSession, source: str, sink: str, checkpoint: str, max_files: int = 5,
                 start: int = 0, available_now: bool = True) -> StreamingQuery:
    """Start (or resume) the ingestion of products and rejects in one stream.

    Each batch is a folder of ``sink`` that a repeated batch overwrites, so a
    stopped job resumes without loss or repetition. ``start`` leaves out so
    many of the source's crawl files, the oldest first (ties by path); a start past
    the last file is an error (ValueError). Give a resumed job the same
    ``start``: files are told by time and path, which later files don't change.
    """
    pages = _pages(spark, source, max_files).select(
        "*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"))
    if start:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
                      .select(F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file")))
        last = files.orderBy("modified", "file").offset(start - 1).limit(1).collect()
        if start < 0 or not last:
            raise ValueError(f"start {start} is past the end of the list: {files.count()} files")
        at = F.lit(last[0]["modified"])
        pages = pages.where((F.col("modified") > at) | ((F.col("modified") == at) & (F.col("file") > last[0]["file"])))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{sink.rstrip('/')}/batch={number}")

    w = _crawl_rows(pages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def current(spark: SparkSession, sink: str) -> tuple[DataFrame, DataFrame]:
    """(products(src, block, pos, id, type, node as JSON), rejects(url, reason,
    detail)) of the last row of each url in a sink of ``ingest_crawl``. Rows
    without a url are pages of their own and all stay."""
    rows = spark.read.schema(CRAWL_SCHEMA).parquet(sink)
    place = F.struct("batch", *PLACE)
    latest = rows.where((F.col("kind") == "page") & F.col("url").isNotNull()).groupBy("url").agg(F.max(place).alias("last"))
    kept = (rows.where(F.col("kind") != "page").withColumn("place", place).join(latest, "url", "left")
                .where(F.col("url").isNull() | (F.col("place") == F.col("last"))))
    products = kept.where(F.col("kind") == "product").select(F.col("url").alias("src"), "block", "pos", "id", "type", "node")
    return products, kept.where(F.col("kind") == "reject").select("url", "reason", "detail")
