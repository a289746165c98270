"""Semantic product-catalogue analytics as Spark DataFrame operators.

Layout:
  sources/    readers and writers (seed lists, graphs, query logs, ID files)
  functions/  Column expressions (regex extractors, text normalisers)
  operators/  DataFrame -> DataFrame operators (extract, labels, enrich,
              mine, retrieve, search, slots, evaluate, triples)
  plans/      end-to-end plans and the catalogue view over the test tables
  streaming/  incremental page ingestion with Structured Streaming
"""

__all__ = ["session"]
