"""Extraction and shaping (B1-B12): crawl table -> JSON-LD nodes -> products.

Nodes stay ``VARIANT`` end to end so unknown keys survive; typed columns are
projected early for the plans that need them, so the scan of ``node`` is
pruned wherever it is not used. Every step is a narrow projection or
generator: no shuffle until someone aggregates.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

NODE_OFFER = "struct<price string, priceCurrency string>"
NODE_PROP = "struct<`@type` string, name string, value string>"


def ok_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1: (pages with status 200, rejects as errors(url, reason, detail))."""
    ok = pages.where(F.col("status") == 200)
    bad = pages.where(F.col("status").isNull() | (F.col("status") != 200)).select(
        "url", F.lit("status").alias("reason"), F.col("status").cast("string").alias("detail"))
    return ok, bad


def ld_json_blocks(pages: DataFrame, *keep: str) -> DataFrame:
    """B2: (url, block, body) and the columns ``keep`` for every script element whose type attribute
    (the last, if it repeats) is ld+json, in document order. Comments, raw
    elements and quoted values hold no elements; a script that isn't closed
    runs to the end of the page."""
    scripts = F.regexp_extract_all(F.col("html"), F.lit(P.HTML_SCRIPT), 1)

    def is_ld_json(script: Column) -> Column:
        inside = F.regexp_extract(script, P.SCRIPT_PARTS, 1)
        names = F.regexp_extract_all(inside, F.lit(P.ATTRIBUTE), 1)
        values = F.regexp_extract_all(inside, F.lit(P.ATTRIBUTE), 2)
        types = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda a: F.lower(a["name"]) == "type")
        return F.regexp_replace(F.try_element_at(types, F.lit(-1))["value"], r"""\A["']|["']\z""", "") == P.LD_JSON

    blocks = F.filter(scripts, lambda s: s.contains(P.LD_JSON) & is_ld_json(s))
    # An outer explode, as an inner one comes with a filter that evaluates its array a second time.
    return pages.select("url", *keep, F.posexplode_outer(blocks).alias("block", "script")).where(F.col("block").isNotNull()).select(
        "url", *keep, "block", F.regexp_extract("script", P.SCRIPT_PARTS, 2).alias("body"))


def is_object(doc="doc", body="body") -> Column:
    """Whether a parsed body is a JSON object. The first character tells an
    object from a list or scalar; no walk over the document."""
    return F.coalesce(F.col(doc).isNotNull() & F.regexp_like(body, F.lit(r"\A\s*\{")), F.lit(False))


def parse_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed documents, errors). A block that is not a JSON object
    (truncated, empty, a top-level list) is reported and skipped."""
    doc = F.try_parse_json(F.col("body"))
    parsed = blocks.select("url", "block", "body", doc.alias("doc"))
    is_obj = is_object()
    good = parsed.where(is_obj).select("url", "block", "doc")
    bad = parsed.where(~is_obj).select("url", F.lit("json").alias("reason"),
                                       F.col("block").cast("string").alias("detail"))
    return good, bad


def explode_graph(docs: DataFrame) -> DataFrame:
    """One row per item of ``@graph``; no ``@graph`` -> no rows."""
    graph = F.try_variant_get(F.col("doc"), '$["@graph"]', "array<variant>")
    return docs.select("url", "block", F.posexplode_outer(graph).alias("pos", "node")).where(F.col("pos").isNotNull())


def node_type(node="node") -> Column:
    return F.try_variant_get(F.col(node) if isinstance(node, str) else node, '$["@type"]', "string")


def node_id(node="node") -> Column:
    return F.try_variant_get(F.col(node) if isinstance(node, str) else node, '$["@id"]', "string")


def is_product(node="node") -> Column:
    """``@type`` is exactly the string ``Product`` (a list does not match)."""
    return F.coalesce(node_type(node) == "Product", F.lit(False))


def extract_nodes(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(src, block, pos, id, type, node), errors)."""
    ok, bad_status = ok_pages(pages)
    good, bad_json = parse_blocks(ld_json_blocks(ok))
    nodes = explode_graph(good).select(
        F.col("url").alias("src"), "block", "pos",
        node_id().alias("id"), node_type().alias("type"), "node")
    return nodes, bad_status.unionByName(bad_json)


def extract_products(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Product nodes of every page, duplicates kept."""
    nodes, errors = extract_nodes(pages)
    return nodes.where(F.col("type") == "Product"), errors


def seed_nodes(spark, nodes: Sequence[dict]) -> DataFrame:
    """Fixed nodes (Organization, WebSite, ...) as node rows."""
    rows = [("seed", 0, i, json.dumps(n)) for i, n in enumerate(nodes)]
    df = spark.createDataFrame(rows, "src string, block int, pos int, j string")
    v = F.parse_json("j")
    return df.select("src", "block", "pos", node_id(v).alias("id"), node_type(v).alias("type"), v.alias("node"))


def assemble_graph(seed: DataFrame, products: DataFrame) -> DataFrame:
    """The fixed nodes followed by every product, duplicates kept."""
    return seed.unionByName(products.select(*seed.columns))


def product_facts(products: DataFrame) -> DataFrame:
    """(link, price, brand), each '' when missing; link without the suffix."""
    n = F.col("node")
    return products.select(
        T.strip_suffix(F.coalesce(node_id(n), F.lit(""))).alias("link"),
        F.coalesce(F.try_variant_get(n, "$.offers.price", "string"), F.lit("")).alias("price"),
        F.coalesce(F.try_variant_get(n, "$.brand.name", "string"), F.lit("")).alias("brand"),
    )


def _array_or_single(node: Column, path: str, elem: str) -> Column:
    """A node value that may be one object or a list of objects, as an array."""
    as_list = F.try_variant_get(node, path, f"array<{elem}>")
    one = F.try_variant_get(node, path, elem)
    return F.coalesce(as_list, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<{elem}>"))


def typed_products(products: DataFrame) -> DataFrame:
    """Product rows with typed columns, keeping ``node``:

    (src, block, pos, uri, name, category, brand_type, brand, offers, properties, node)
    """
    n = F.col("node")
    return products.select(
        "src", "block", "pos",
        node_id(n).alias("uri"),
        F.try_variant_get(n, "$.name", "string").alias("name"),
        F.try_variant_get(n, "$.category", "string").alias("category"),
        F.try_variant_get(n, '$.brand["@type"]', "string").alias("brand_type"),
        F.try_variant_get(n, "$.brand.name", "string").alias("brand"),
        _array_or_single(n, "$.offers", NODE_OFFER).alias("offers"),
        _array_or_single(n, "$.additionalProperty", NODE_PROP).alias("properties"),
        n.alias("node"),
    )


def add_columns(df: DataFrame, *cols: Column) -> DataFrame:
    """Derived columns side by side with the row they come from (a
    projection; never a join on row position)."""
    return df.select("*", *cols)


def move_column(df: DataFrame, name: str, index: int) -> DataFrame:
    """Put column ``name`` at position ``index`` (an ordered select)."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest[:index], name, *rest[index:])
