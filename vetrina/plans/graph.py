"""Annotate and refine plans over the test shop: pages -> nodes -> enriched
typed products, plus the permalink -> id mapping (C13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import extract as X
from . import catalogue as C

#: Fixed nodes of the test shop's graph; any list of nodes may take their place.
SEED = [{"@type": "Organization", "@id": C.SHOP + "/#organization", "name": "Shop"},
        {"@type": "WebSite", "@id": C.SHOP + "/#website", "url": C.SHOP}]


def products(spark: SparkSession, sf: str) -> DataFrame:
    prods, _ = X.extract_products(C.product_pages(spark, sf))
    return prods


def enriched_products(spark: SparkSession, sf: str) -> DataFrame:
    """Typed product rows after C14 (uri, name, category, brand, offers, properties)."""
    typed = X.typed_products(products(spark, sf)).drop("node")
    return E.enrich_typed(typed, C.attributes(spark, sf))


def enriched_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed nodes and every product node after C14, as VARIANT rows."""
    nodes = X.assemble_graph(X.seed_nodes(spark, SEED), products(spark, sf))
    return E.enrich_nodes(nodes, C.attributes(spark, sf))


def id_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """(permalink, id), last row per permalink wins."""
    cat = C.catalogue(spark, sf).select("permalink", "id")
    return E.latest_by_key(cat, "permalink", order=["id"])


def offer_products(spark: SparkSession, sf: str, offers: DataFrame | None = None) -> DataFrame:
    """Typed product rows whose offers (id, price, currency) come from
    lineitem, one offer per row (long form: a hot product is many rows, never
    one big array)."""
    cat = C.catalogue(spark, sf).select("id", "permalink", "title")
    off = C.offers(spark, sf) if offers is None else offers
    return (off.join(cat, "id").select(
        F.concat("permalink", F.lit("/#richSnippet")).alias("uri"),
        F.col("title").alias("name"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("brand_type"),
        F.lit(None).cast("string").alias("brand"),
        F.array(F.struct(F.col("price").alias("price"), F.col("currency").alias("priceCurrency"))).alias("offers"),
        F.array().cast(f"array<{X.NODE_PROP}>").alias("properties")))
