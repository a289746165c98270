"""Labels and features.

Labels travel as ``ARRAY<STRING>`` per product (the long form of 13 one-hot
columns). Pairs are built by one higher-order expression per row instead of 78
row-wise passes; counts are plain partial aggregations.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import vocab as V
from ..session import bounded_broadcast


def with_capacity(df: DataFrame, title: str = "title", out: str = "capacity") -> DataFrame:
    """C1 as a column of the catalogue."""
    return df.withColumn(out, T.capacity(title))


def label_pairs(labels) -> Column:
    """Sorted pairs ``'A B'`` of a label array (A < B); fewer than two -> []."""
    lab = F.array_sort(F.array_distinct(F.col(labels) if isinstance(labels, str) else labels))
    return F.flatten(F.transform(
        lab,
        lambda x, i: F.transform(F.slice(lab, i + 2, F.greatest(F.size(lab) - i - 1, F.lit(0))),
                                 lambda y: F.concat_ws(" ", x, y)),
    ))


def _pair_structs(labels) -> Column:
    lab = F.array_sort(F.array_distinct(F.col(labels) if isinstance(labels, str) else labels))
    return F.flatten(F.transform(
        lab,
        lambda x, i: F.transform(F.slice(lab, i + 2, F.greatest(F.size(lab) - i - 1, F.lit(0))),
                                 lambda y: F.struct(x.alias("a"), y.alias("b"))),
    ))


def pair_counts(df: DataFrame, labels: str = "labels", domain: Sequence[str] | None = tuple(V.LABELS)) -> DataFrame:
    """(a, b, pair, n) for every pair a < b of the label domain, with 0
    where no row has it. ``domain=None`` counts just the pairs that occur.

    The domain's pairs are a table of |domain|^2 / 2 rows; counts are a
    partial aggregation, so a hot pair costs one row per task.
    """
    counts = (df.select(F.explode(_pair_structs(labels)).alias("p"))
                .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
                .agg(F.count(F.lit(1)).alias("n")))
    if domain is not None:
        pairs = list(itertools.combinations(sorted(set(domain)), 2))
        every = df.sparkSession.createDataFrame(pairs, "a string, b string")
        counts = every.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return counts.withColumn("pair", F.concat_ws(" ", "a", "b"))


def top_pairs(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent pairs; ties go to the earlier pair (a, b)."""
    return counts.orderBy(F.desc("n"), F.asc("a"), F.asc("b")).limit(k)


def keep_top_pairs(df: DataFrame, top: DataFrame, labels: str = "labels", out: str = "pairs") -> DataFrame:
    """C11: each row with the array of its pairs that are among ``top``.

    ``top`` is bounded by k, so it is broadcast; the row side is never shuffled
    except to re-gather its own pairs by id (one partial aggregation).
    """
    exploded = df.select("id", F.explode(label_pairs(labels)).alias("pair"))
    kept = exploded.join(F.broadcast(top.select("pair")), "pair", "left_semi")
    gathered = kept.groupBy("id").agg(F.array_sort(F.collect_list("pair")).alias(out))
    return (df.join(gathered, "id", "left")
              .withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>"))))


def keep_pairs(labels, pairs: Sequence[str]) -> Column:
    """C11 with a known pair list: filter the row's pairs, no join."""
    lit = F.array(*[F.lit(p) for p in pairs]) if pairs else F.array().cast("array<string>")
    return F.filter(label_pairs(labels), lambda p: F.array_contains(lit, p))


# ---------------------------------------------------------------- C3 - C7

def valid_scores(reply) -> Column:
    """The reply is a list of [string, int] pairs (empty list passes)."""
    r = F.col(reply) if isinstance(reply, str) else reply
    return F.coalesce(r.rlike(P.SCORE_LIST), F.lit(False))


def malformed(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """C4: quarantine of replies that fail C3."""
    return replies.where(~valid_scores(reply))


def parse_scores(reply) -> Column:
    """Reply -> ARRAY<STRUCT<label, score>>; NULL when not a score list.
    A score may carry a sign."""
    return F.when(valid_scores(reply), _parsed(reply))


def _parsed(reply) -> Column:
    """The pairs of a reply that is known to be a score list."""
    r = F.col(reply) if isinstance(reply, str) else reply
    cleaned = F.regexp_replace(F.regexp_replace(r, r",\s*\]", "]"), r",\s*\+(\d)", ", $1")
    arr = F.from_json(cleaned, "array<array<string>>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.transform(arr, lambda p: F.struct(p[0].alias("label"), p[1].try_cast("int").alias("score")))


def repair_scores(reply) -> Column:
    """Every ("name", 0|1) pair found anywhere in a damaged reply; the
    score may be quoted or signed."""
    r = F.col(reply) if isinstance(reply, str) else reply
    names = F.regexp_extract_all(r, F.lit(P.SCORE_PAIR), 1)
    scores = F.regexp_extract_all(r, F.lit(P.SCORE_PAIR), 2)
    return F.transform(F.arrays_zip(names.alias("label"), scores.alias("score")),
                       lambda z: F.struct(z["label"].alias("label"), z["score"].cast("int").alias("score")))


def score_vector(pairs: Column, labels: Sequence[str]) -> Column:
    """ARRAY<STRUCT<label, score>> over the label domain, in its order: the
    last score that ``pairs`` has for a label, 0 without one. Other labels
    are left out."""
    def last(label):
        scores = F.filter(pairs, lambda p: (p["label"] == label) & p["score"].isNotNull())
        return F.coalesce(F.try_element_at(scores, F.lit(-1))["score"], F.lit(0))

    return F.array(*[F.struct(F.lit(x).alias("label"), last(x).alias("score")) for x in labels])


def _score_pairs(replies: DataFrame, reply: str) -> DataFrame:
    """(id, valid, _pairs): each reply checked once and parsed or repaired
    once, in columns of their own, which every label reads."""
    checked = replies.select("id", F.col(reply).alias("_reply"), valid_scores(reply).alias("valid"))
    return checked.select("id", "valid", F.when(F.col("valid"), _parsed("_reply")).otherwise(repair_scores("_reply")).alias("_pairs"))


def scores(replies: DataFrame, labels: Sequence[str] = tuple(V.LABELS), reply: str = "reply") -> DataFrame:
    """C3-C6 in one projection: valid replies parsed, invalid ones repaired.

    (id, valid, label, score), one row per reply and label of the domain: a
    reply without usable pairs (empty, an empty list, NULL) is the zero vector.
    """
    return (_score_pairs(replies, reply).select("id", "valid", score_vector(F.col("_pairs"), labels).alias("v"))
                                        .select("id", "valid", F.inline_outer("v")))  # never empty


def one_hot(replies: DataFrame, labels: Sequence[str] = tuple(V.LABELS), reply: str = "reply") -> DataFrame:
    """One row per reply, one 0/1 column per label; a reply without
    labels has zeros. A projection, no pivot."""
    vector = _score_pairs(replies, reply).select("id", score_vector(F.col("_pairs"), labels).alias("v"))
    return vector.select("id", *[F.col("v")[i]["score"].alias(x) for i, x in enumerate(labels)])


# ---------------------------------------------------------------- C2, C2b

def tag_labels(docs: DataFrame, lexicon: DataFrame, labels: Sequence[str] = tuple(V.LABELS), *, key: str = "id",
               text: str = "text") -> DataFrame:
    """C2 (re-aimed): lexicon multi-label tagger.

    ``lexicon`` is (term, label); a document has a label when the words of
    any of the label's terms follow each other among its tokens. (key, label,
    score), one row per document and label of the domain: a document without
    hits, also one without any text, is the zero vector.

    The lexicon is a fixed vocabulary, broadcast after a size check and joined
    by each term's first word; the rest is verified in place, against the few
    tokens (as many as the longest term has) that a row carries. A text costs
    one row per distinct run of that many tokens, and its labels (bounded by
    the domain) are gathered by a partial aggregation.
    """
    lex = lexicon.select(T.tokens(F.col("term")).alias("words"), "label").where(F.col("label").isin(*labels) & (F.size("words") > 0)).distinct()
    longest = lex.agg(F.max(F.size("words"))).first()[0] or 1
    toks = T.tokens(F.col(text))
    if longest == 1:
        runs = docs.select(key, F.explode_outer(F.array_distinct(toks)).alias("term"))
        hit = F.col("term") == F.col("words")[0]
    else:
        runs = docs.select(key, toks.alias("toks")).select(key, F.explode_outer(F.array_distinct(F.transform(
            "toks", lambda _, i: F.slice("toks", i + 1, longest)))).alias("run")).select(key, F.try_element_at("run", F.lit(1)).alias("term"), "run")
        hit = (F.col("term") == F.col("words")[0]) & (F.slice("run", 1, F.size("words")) == F.col("words"))
    found = (runs.join(bounded_broadcast(lex), hit, "left")
                 .groupBy(key).agg(F.collect_set("label").alias("found")))
    vector = F.array(*[F.struct(F.lit(x).alias("label"), F.array_contains("found", x).cast("int").alias("score"))
                       for x in labels])
    return found.select(key, F.inline(vector))


def unlabelled_only(products: DataFrame, labelled: DataFrame, key: str = "id") -> DataFrame:
    """Products that have no saved reply yet."""
    return products.join(labelled.select(key), key, "left_anti")
