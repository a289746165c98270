"""End-to-end evaluation plan: mined truth -> three retrieval systems ->
metrics, for any catalogue.

    queries, truth = mine_queries(catalogue, n)           (D6, D7)
    graph  = match_queries(queries, products, mapping)    (E3-E13)
    text   = keyword_search(to_keywords(queries), docs)   (E1, E14)
    slots  = match_queries(fill_slots(keywords), ...)     (E15-E19, E10)
    scores = per_query(...); slices(...)                  (F1-F10)

The query log, its truth and all answers are written once (``cut_lineage``),
because the systems and the scorer read them several times.

The slot system sends ``fill_slots`` straight to E10. E16 and E18 guard and
respell the replies of a model; the tagger's values come from the vocabulary,
in the catalogue's own spelling, which E18 would only take from them.
``resolve_replies`` has the full chain for replies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import mine as M
from ..operators import retrieve as R
from ..operators import search as S
from ..operators import slots as SL
from ..session import cut_lineage

SYSTEMS = ["graph", "text", "slots"]


def evaluate_catalogue(catalogue: DataFrame, products: DataFrame, mapping: DataFrame, docs: DataFrame,
                       vocab: DataFrame, n: int, *, categories: Sequence[str], caps: Sequence[int],
                       min_support: int = 20, **mine_options) -> tuple[DataFrame, DataFrame]:
    """(queries, per-query scores) of the three systems for queries of size n."""
    queries, truth = M.mine_queries(catalogue, n, categories=categories, caps=caps, min_support=min_support,
                                    **mine_options)
    truth = cut_lineage(truth, "truth")
    kw = queries.select("query_id", R.to_keywords(queries).alias("text_query"))
    index = R.graph_index(products)  # shared by the graph and slot systems
    graph = R.match_queries(queries, index, mapping)
    text = S.keyword_search(kw, docs, prices=catalogue.select("id", "price"))
    slots = R.match_queries(SL.fill_slots(kw, vocab), index, mapping)
    answers = (graph.select("query_id", F.lit("graph").alias("system"), "id")
               .unionByName(text.select("query_id", F.lit("text").alias("system"), "id"))
               .unionByName(slots.select("query_id", F.lit("slots").alias("system"), "id")))
    answers = cut_lineage(answers, "answers")
    return queries, EV.per_query(queries, truth, answers, SYSTEMS, rows=truth.count() + answers.count())
