"""Shop catalogue over the test tables.

The test tables hold no shop, so one is derived from ``part`` by Spark, with
deterministic faults keyed on ``p_partkey`` (k):

  id         k
  permalink  SHOP/p/k
  title      p_name + ' ' + p_size + ('ML' when k even, ' ml' when odd); k % 10 = 0: no size
  content    small HTML description
  category   p_type
  brand      p_brand
  price      p_retailprice as DECIMAL(18,4)
  labels     the words of p_name (the scent labels of the test shop)

Attribute table for the enrichment (C14): capacity; scent group = p_name
('' when k % 9 = 0); category = p_type (NULL when k % 7 = 0).

Product pages (B1-B5): status 404 when k % 31 = 0; one JSON-LD block with an
Organization and the Product node, except k % 23 = 0 (no block) and
k % 17 = 0 (truncated JSON); ``@type`` is ``["Product"]`` when k % 13 = 0;
a second, upper-case, single-quoted block holding the product again when
k % 11 = 0; what only looks like a block, in a comment when k % 19 = 0, with
other attributes and in a quoted value when k % 29 = 0. The page's own category is lower-case; the enrichment overwrites it.

Offers (E8): one per lineitem, see ``offers``.

The same view is written in SQL (``*_SQL``) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SHOP = "http://shop.example"
# Domains of the test shop (its categories and price caps).
TEST_CATEGORIES = ["SMALL", "LARGE"]
TEST_CAPS = [910, 920, 930, 940, 950, 975, 1000]
OFFER_CAPS = [10000, 25000, 50000, 75000]
# Label domain of the test shop: the words that part names are made of.
TEST_LABELS = ["anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring",
               "rod", "small", "widget"]


#: Rows of a table that CPU-heavy steps take in one task at most, about.
TASK_ROWS = 25_000

_scans: dict[tuple[str, str], tuple[int, int]] = {}


def table(spark: SparkSession, sf_dir: str, name: str, task_rows: int | None = None) -> DataFrame:
    """A test table. One that only a few scan tasks get rows of, fewer than
    the default parallelism, is spread, else every CPU-heavy step (HTML
    patterns, JSON parsing, combination expansion) would run in those: a file
    is cut into splits by its bytes, but a split without the middle of a row
    group has no rows. Other tables stay as they are; with ``task_rows`` they
    too are spread where a task would have more rows. The number of tasks
    grows with the rows then, so the longest one doesn't.

    Spark moves filters below a repartition, also the one that it adds to an
    ``explode``, and with them the work that they test: all of it would run in
    the scan's few tasks. Nothing moves below a task's own number, so each column
    has it in its guard, which always holds."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    try:
        n = spark.sparkContext.defaultParallelism
        key = (spark.sparkContext.applicationId, path)
        if key not in _scans:  # row counts per split, from the files' footers
            rows = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
            used, most = rows.agg(F.count(F.lit(1)), F.max("n")).first()
            _scans[key] = (used, used * (most or 0))
    except Exception:  # Spark Connect: no parallelism to see, leave the scan as it is
        return df
    used, bound = _scans[key]  # ``bound``: rows, if all splits had as many as the largest
    if n > 1 and (used < n or (task_rows and bound > used * task_rows)):
        spread = df.repartition(max(n, -(-bound // task_rows) if task_rows else 0))
        return spread.select(*[F.when(F.spark_partition_id() >= 0, F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that pages, replies and catalogue rows are made of: few bytes
    a row, much work on each."""
    return table(spark, sf_dir, "part", TASK_ROWS)


def _title(k, name, size):
    return (F.when(k % 10 == 0, name)
            .when(k % 2 == 0, F.concat(name, F.lit(" "), size.cast("string"), F.lit("ML")))
            .otherwise(F.concat(name, F.lit(" "), size.cast("string"), F.lit(" ml"))))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    k = F.col("p_partkey")
    title = _title(k, F.col("p_name"), F.col("p_size"))
    return p.select(
        k.alias("id"),
        F.concat(F.lit(SHOP + "/p/"), k.cast("string")).alias("permalink"),
        title.alias("title"),
        F.concat(F.lit("<div><p>"), F.col("p_name"), F.lit("</p><p>"), F.col("p_type"),
                 F.lit(" &amp; "), F.col("p_brand"), F.lit("</p></div>")).alias("content"),
        F.col("p_type").alias("category"),
        T.capacity(title).alias("capacity"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("decimal(18,4)").alias("price"),
        F.array_distinct(F.split(F.col("p_name"), " ")).alias("labels"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute table keyed by permalink (input of C14)."""
    p = part(spark, sf_dir)
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit(SHOP + "/p/"), k.cast("string")).alias("permalink"),
        T.capacity(_title(k, F.col("p_name"), F.col("p_size"))).alias("capacity"),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("p_name")).alias("scent_group"),
        F.when(k % 7 != 0, F.col("p_type")).alias("category"),
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl table (url, status, html) with JSON-LD product nodes."""
    p = part(spark, sf_dir)
    k = F.col("p_partkey")
    permalink = F.concat(F.lit(SHOP + "/p/"), k.cast("string"))
    title = _title(k, F.col("p_name"), F.col("p_size"))
    brand = F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name"))
    offer = F.struct(F.lit("Offer").alias("@type"), F.col("p_retailprice").cast("string").alias("price"),
                     F.lit("EUR").alias("priceCurrency"))

    def product(type_value):
        return F.to_json(F.struct(
            type_value.alias("@type"),
            F.concat(permalink, F.lit("/#richSnippet")).alias("@id"),
            title.alias("name"),
            F.lower(F.col("p_type")).alias("category"),
            brand.alias("brand"),
            offer.alias("offers"),
            k.cast("string").alias("sku"),
        ))

    node = F.when(k % 13 == 0, product(F.array(F.lit("Product")))).otherwise(product(F.lit("Product")))
    org = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.lit(SHOP + "/#organization").alias("@id"),
                             F.lit("Shop").alias("name")))
    doc = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), org, F.lit(","), node, F.lit("]}"))
    doc = F.when(k % 17 == 0, doc.substr(F.lit(1), F.length(doc) / 2)).otherwise(doc)
    block1 = F.when(k % 23 == 0, F.lit("")).otherwise(
        F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>")))
    block2 = F.when(k % 11 == 0, F.concat(
        F.lit("<SCRIPT type='application/ld+json'>\n{\"@graph\":["), node, F.lit("]}\n</SCRIPT>"))).otherwise(F.lit(""))
    ghost = '{"@graph":[{"@type":"Product","@id":"ghost"}]}</script>'
    faults = F.concat(
        F.when(k % 19 == 0, F.lit(f'<!-- <script type="application/ld+json">{ghost} -->')).otherwise(F.lit("")),
        F.when(k % 29 == 0, F.lit(f'<script data-type="application/ld+json">{ghost}<script type="application/ld+json-patch">{ghost}'
                                  f"<img alt='<script type=\"application/ld+json\">{ghost}' title=\"a>b\">")).otherwise(F.lit("")))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), title, F.lit("</title>"), faults, block1,
        F.lit('<script>var t="</p>";</script></head><body><h1>'), title, F.lit("</h1><div><p>"),
        F.col("p_name"), F.lit("</p><p>"), F.col("p_type"), F.lit(" &amp; "), F.col("p_brand"),
        F.lit("</p></div>"), block2, F.lit("</body></html>"))
    return p.select(permalink.alias("url"),
                    F.when(k % 31 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
                    html.alias("html"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long offer table (product id, price text, currency) from lineitem.

    Price text is l_extendedprice; faults: l_linenumber = 4 has no currency,
    5 writes a decimal comma, 6 an exponent (neither is an xsd:decimal).
    """
    li = table(spark, sf_dir, "lineitem")
    txt = F.col("l_extendedprice").cast("string")
    ln = F.col("l_linenumber")
    price = (F.when(ln == 5, F.replace(txt, F.lit("."), F.lit(",")))
              .when(ln == 6, F.concat(txt, F.lit("e0"))).otherwise(txt))
    return li.select(F.col("l_partkey").alias("id"), price.alias("price"),
                     F.when(ln != 4, F.lit("EUR")).alias("currency"))


# --------------------------------------------------------------------------
# The same view in DuckDB SQL (oracle side).

CATALOGUE_SQL = f"""
cat0 AS (
  SELECT p_partkey AS id,
         '{SHOP}/p/' || CAST(p_partkey AS VARCHAR) AS permalink,
         CASE WHEN p_partkey % 10 = 0 THEN p_name
              WHEN p_partkey % 2 = 0 THEN p_name || ' ' || CAST(p_size AS VARCHAR) || 'ML'
              ELSE p_name || ' ' || CAST(p_size AS VARCHAR) || ' ml' END AS title,
         p_name, p_type AS category, p_brand AS brand,
         '<div><p>' || p_name || '</p><p>' || p_type || ' &amp; ' || p_brand || '</p></div>' AS content,
         CAST(p_retailprice AS DECIMAL(18,4)) AS price,
         list_distinct(string_split(p_name, ' ')) AS labels
  FROM part),
cat AS (
  SELECT *, CASE WHEN regexp_extract(title, '(?i)(\\d+)\\s*ml', 1) <> ''
                 THEN regexp_extract(title, '(?i)(\\d+)\\s*ml', 1) || ' ml' END AS capacity
  FROM cat0)"""


def sql_with(*ctes: str) -> str:
    """``WITH`` prefix holding the catalogue CTE and extra CTEs."""
    return "WITH " + ",\n".join((CATALOGUE_SQL,) + ctes) + "\n"


# Expected product nodes after extraction (one row per node copy) and the
# enriched view of each distinct product (m = number of copies).
PAGES_SQL = f"""
pg AS (
  SELECT c.*, p_retailprice, p_type,
         (CASE WHEN id % 23 <> 0 AND id % 17 <> 0 AND id % 13 <> 0 THEN 1 ELSE 0 END)
       + (CASE WHEN id % 11 = 0 AND id % 13 <> 0 THEN 1 ELSE 0 END) AS m
  FROM cat c JOIN part ON part.p_partkey = c.id
  WHERE id % 31 <> 0),
ext AS (
  SELECT * FROM pg WHERE id % 23 <> 0 AND id % 17 <> 0 AND id % 13 <> 0
  UNION ALL SELECT * FROM pg WHERE id % 11 = 0 AND id % 13 <> 0),
gp AS (
  SELECT id, permalink, title AS name, m, brand,
         COALESCE(CASE WHEN id % 7 <> 0 THEN p_type END, lower(p_type)) AS gcategory,
         capacity AS gcapacity,
         CASE WHEN id % 9 <> 0 THEN p_name END AS gscent,
         CAST(p_retailprice AS DECIMAL(18,4)) AS gprice
  FROM pg WHERE m > 0)"""
