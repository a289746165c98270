"""Keyword search (E14, re-aimed): all-terms match over an inverted index.

The shop's search box is a black box; its stand-in answers a keyword string
with the products whose text (title, brand, category, description) holds every
query term, and, when the string carries a price phrase ("minori di N euro"),
whose price is below N.

Plan: only terms of the log matter, so the texts are tokenised once, their
tokens semi-joined with the log's distinct terms, and that is written. Each
text's terms are gathered into one row, which meets the queries that it holds
all terms of (``subsets.contained``): queries share what they have in common,
and a common term never fans out across queries. Prices are compared in the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..session import bounded_broadcast, cut_lineage, table_bytes
from .subsets import contained

#: Terms of texts that a task has which looks for the queries they answer.
PART_TERMS = 100_000


def product_postings(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(term, id): distinct tokens of every document."""
    return docs.select(key, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).select("term", key)


def query_terms(queries: DataFrame, text: str = "text_query") -> DataFrame:
    """(query_id, term, cap, n_terms): terms of the string without its price phrase."""
    t = F.col(text)
    cap = F.regexp_extract(t, P.PRICE_PHRASE, 1)
    body = F.regexp_replace(t, P.PRICE_PHRASE, " ")
    terms = F.array_distinct(T.tokens(body))
    return (queries.select("query_id", terms.alias("terms"),
                           F.when(cap != "", cap.cast(T.DECIMAL)).alias("cap"))
                   .select("query_id", "cap", F.size("terms").alias("n_terms"),
                           F.explode("terms").alias("term")))


def keyword_search(queries: DataFrame, docs: DataFrame, prices: DataFrame | None = None,
                   key: str = "id", text: str = "text") -> DataFrame:
    """(query_id, id) for products holding every term of the query.

    ``docs``: (id, text); ``prices``: (id, price) for the price phrase. A query
    without terms matches nothing (an empty search).
    """
    qt = cut_lineage(query_terms(queries), "query-terms")  # small; read several times
    log_bytes = table_bytes(qt)  # bounds every query-side table below
    asked = bounded_broadcast(qt.select("term").distinct(), log_bytes)
    post = cut_lineage(product_postings(docs, key, text).join(asked, "term", "left_semi"), "postings")
    dfreq = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asks = (qt.join(dfreq, "term", "left").groupBy("query_id", "cap")
              .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("ts")))
    asks = cut_lineage(asks.select("query_id", "cap", F.transform("ts", lambda t: t["term"]).alias("ts")), "asks")

    # A row per id: its terms in the same order, how many texts of the id hold each, and its price.
    # The number of tasks goes by the rows, not the bytes, as each row makes many.
    ordered = F.array_sort(F.collect_list(F.struct("df", "term", "cnt")))
    session = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = post.repartition(max(session, -(-post.count() // PART_TERMS)), key)
    rows = (dealt.groupBy("term", key).agg(F.count(F.lit(1)).alias("cnt")).join(bounded_broadcast(dfreq, log_bytes), "term").groupBy(key)
                .agg(F.transform(ordered, lambda h: F.struct(h["term"].alias("item"), h["cnt"].alias("cnt"))).alias("hits")))
    if prices is None:
        rows = rows.withColumn("_price", F.lit(None).cast(T.DECIMAL))
    else:
        rows = rows.join(prices.select(key, F.col("price").alias("_price")), key, "left")
    rows = rows.withColumn("_one", F.col(key).isNotNull() & F.forall("hits", lambda h: h["cnt"] == 1))

    # An id of one text: all terms of the query are among its own.
    sets = asks.select(F.array_distinct("ts").alias("need"), F.struct("query_id", "cap").alias("ask"))
    found = contained(rows.where("_one").select(key, "_price", "hits"), sets, log_bytes)
    within = F.col("ask.cap").isNull() | (F.col("_price") < F.col("ask.cap"))
    out = found.select(key, "_price", F.explode("asks").alias("ask")).where(within).select("ask.query_id", key)
    # Ids of several texts are matched by the numbers of texts: the rarest term's times each other's add up to the other terms' number.
    first = asks.select("query_id", "cap", F.col("ts")[0].alias("term"), F.slice("ts", 2, F.size("ts")).alias("rest"))
    many = rows.where(~F.col("_one")).select(key, "_price", F.map_from_entries("hits").alias("has"), F.explode_outer("hits").alias("h")).where(F.col("h").isNotNull())
    many = many.join(bounded_broadcast(first, log_bytes), F.col("h.item") == F.col("term"))
    n_has = F.aggregate("rest", F.lit(0).cast("bigint"), lambda n, t: n + F.when(F.col(key).isNull(), 0).otherwise(F.coalesce(F.try_element_at("has", t), F.lit(0)) * F.col("h.cnt")))
    many = many.where((n_has == F.size("rest")) & (F.col("cap").isNull() | (F.col("_price") < F.col("cap"))))
    return out.unionByName(many.select("query_id", key))


#: Saturation of a term's count and weight of a text's length in a score (BM25).
K1, B = 1.2, 0.75


def ranked(queries: DataFrame, docs: DataFrame, answers: DataFrame, k: int = 10, key: str = "id", text: str = "text", digits: int = 6) -> DataFrame:
    """E14 with a rank: the ``k`` best of each query's ``answers(query_id,
    id)``, as (query_id, id, rank, score).

    A term weighs ln(1 + (N - n + 0.5) / (n + 0.5)), with n of N texts holding
    it; a text scores, over the query's terms, weight times the count of the
    term damped by the text's length against the mean (BM25). Scores are
    rounded to ``digits``; ties go to the smaller id. Texts without tokens and
    equal ids count each for itself in N; a text's answers appear once.

    Terms are counted for the log's terms only, and only answers meet their
    query's terms, by one equi-join on (term, id). The k best are a group
    limit in front of the shuffle, so a query with very many answers sends k
    rows a task.
    """
    qt = cut_lineage(query_terms(queries).select("query_id", "term"), "query-terms")
    log_bytes = table_bytes(qt)
    toks = docs.select(key, T.tokens(F.col(text)).alias("toks")).select(key, F.size("toks").alias("length"), "toks")
    size = toks.agg(F.count("*").alias("N"), F.avg("length").alias("mean")).first()
    n, mean = size["N"] or 0, size["mean"] or 1.0
    asked = bounded_broadcast(qt.select("term").distinct(), log_bytes)
    counts = toks.select(key, "length", F.explode("toks").alias("term")).join(asked, "term", "left_semi").groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    post = cut_lineage(counts, "counts")
    weight = post.groupBy("term").agg(F.count("*").alias("n")).select("term", F.log1p((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("weight"))
    part = post.join(bounded_broadcast(weight, log_bytes * 2), "term").select(
        "term", key, (F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))).alias("part"))
    pairs = answers.select("query_id", key).distinct().join(bounded_broadcast(qt, log_bytes), "query_id")
    scores = pairs.join(part, ["term", key]).groupBy("query_id", key).agg(F.round(F.sum("part"), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "rank", "score")
