"""Slot filling (E15-E19, re-aimed): keyword string -> five query slots.

The model call is replaced by a dictionary tagger:

* price from the phrase "minori di N" / "meno di N" -> "< N";
* capacity from "N ml" -> "N ml";
* then brand, category and label, in that order, each taking its longest
  (then leftmost) vocabulary n-gram among the words no earlier slot used.

Plan: the n-grams of every text are exploded and equi-joined with the
vocabulary (phrase, slot, value); the matches of one text are gathered (one
text's matches are bounded by its length) and resolved by a fold
(``aggregate``), so no pairs of matches are ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..session import bounded_broadcast, cut_lineage

SLOT_ORDER = ["brand", "category", "olfactory_category"]
SLOTS = ["brand", "category", "capacity", "olfactory_category", "price"]
CAPACITY_WORDS = r"(?U)\b(\d+)\s*ml\b"


def vocabulary(values: DataFrame, slot: str, column: str) -> DataFrame:
    """(phrase, slot, value) from the distinct values of a column."""
    return (values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
                  .select(T.collapse_spaces(F.lower("value")).alias("phrase"), F.lit(slot).alias("slot"), "value"))


def _ngrams(words: Column, lengths: Sequence[int]) -> Column:
    n = F.size(words)

    def gram(length):
        return lambda i: F.struct(i.alias("start"), F.lit(length).alias("len"),
                                  F.array_join(F.slice(words, i, length), " ").alias("phrase"))

    per_len = [F.when(n >= L, F.transform(F.sequence(F.lit(1), n - L + 1), gram(L))) for L in lengths]
    empty = F.array().cast("array<struct<start:int,len:int,phrase:string>>")
    return F.concat(empty, *[F.coalesce(x, empty) for x in per_len])


def fill_slots(texts: DataFrame, vocab: DataFrame, key: str = "query_id", text: str = "text_query") -> DataFrame:
    """(key, brand, category, capacity, olfactory_category, price);
    an unmatched slot is ''. N-grams are made of just those lengths that the
    vocabulary's phrases have, however long (one row per length reaches the
    driver)."""
    vocab = cut_lineage(vocab.select("phrase", "slot", "value"), "vocabulary")  # measured, then joined
    lengths = sorted(r[0] for r in vocab.select(F.size(F.split("phrase", " "))).distinct().collect())
    norm = T.collapse_spaces(F.lower(F.col(text)))
    price_n = F.regexp_extract(norm, P.PRICE_PHRASE, 1)
    rest = F.regexp_replace(norm, P.PRICE_PHRASE, " | ")
    cap_n = F.regexp_extract(rest, CAPACITY_WORDS, 1)
    rest = F.regexp_replace(rest, CAPACITY_WORDS, " | ")
    base = texts.select(
        key,
        F.when(price_n != "", F.concat(F.lit("< "), price_n)).otherwise(F.lit("")).alias("price"),
        F.when(cap_n != "", F.concat(cap_n, F.lit(" ml"))).otherwise(F.lit("")).alias("capacity"),
        F.filter(F.split(F.trim(rest), " "), lambda w: w != "").alias("words"))
    # An outer explode, as an inner one comes with a filter that makes the n-grams a second time.
    grams = base.select(key, F.explode_outer(_ngrams(F.col("words"), lengths)).alias("g")).where(F.col("g").isNotNull()).select(key, "g.*")
    rank = F.create_map(*[x for i, s in enumerate(SLOT_ORDER) for x in (F.lit(s), F.lit(i))])
    hits = (grams.join(bounded_broadcast(vocab), "phrase")
                 .select(key, F.struct(rank[F.col("slot")].alias("r"), (-F.col("len")).alias("nl"),
                                       F.col("start").alias("start"), F.col("len").alias("len"),
                                       F.col("slot").alias("slot"), F.col("value").alias("value")).alias("m")))
    acc0 = F.struct(F.array().cast("array<string>").alias("slots"),
                    F.array().cast("array<int>").alias("used"),
                    F.array().cast("array<struct<slot:string,value:string>>").alias("chosen"))

    def step(acc, m):
        span = F.sequence(m["start"], m["start"] + m["len"] - 1)
        ok = ~F.array_contains(acc["slots"], m["slot"]) & ~F.arrays_overlap(acc["used"], span)
        return F.when(ok, F.struct(
            F.concat(acc["slots"], F.array(m["slot"])).alias("slots"),
            F.concat(acc["used"], span).alias("used"),
            F.concat(acc["chosen"], F.array(F.struct(m["slot"].alias("slot"), m["value"].alias("value"))))
             .alias("chosen"))).otherwise(acc)

    resolved = (hits.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("ms"))
                    .select(key, F.aggregate("ms", acc0, step)["chosen"].alias("chosen")))

    def pick(slot):
        return F.coalesce(F.try_element_at(F.filter("chosen", lambda c: c["slot"] == slot), F.lit(1))["value"], F.lit(""))

    out = (base.join(resolved, key, "left")
               .select(key, *[pick(s).alias(s) if s in SLOT_ORDER else F.col(s) for s in SLOTS]))
    return out


def to_reply(brand="brand", category="category", capacity="capacity", olfactory="olfactory_category",
             price="price") -> Column:
    """The five slots written as a reply: [["brand", "v"], ...]."""
    def pair(name, c):
        v = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
        v = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit(f'["{name}", "'), v, F.lit('"]'))
    return F.concat(F.lit("["), F.concat_ws(", ", pair("brand", brand), pair("category", category),
                                            pair("capacity", capacity), pair("olfactory category", olfactory),
                                            pair("price", price)), F.lit("]"))


# A reply: a list of [string, string] pairs (single or double quotes; a
# backslash keeps the next character).
_Q = r'''(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')'''
REPLY_LIST = (r"(?s)\A\s*\[\s*(?:\[\s*" + _Q + r"\s*,\s*" + _Q + r"\s*\]"
              r"\s*(?:,\s*(?=\[)|(?=\])))*+\]\s*\z")
REPLY_PAIR = (r'''(?s)\[\s*(?:"((?:[^"\\]|\\.)*+)"|'((?:[^'\\]|\\.)*+)')'''
              r'''\s*,\s*(?:"((?:[^"\\]|\\.)*+)"|'((?:[^'\\]|\\.)*+)')\s*\]''')


def reply_pairs(reply) -> Column:
    """ARRAY<STRUCT<name, value>> of a reply, in order; NULL when not a list
    of string pairs."""
    return T.once(F.col(reply) if isinstance(reply, str) else reply, _pairs)


def _pairs(r: Column) -> Column:
    n1 = F.regexp_extract_all(r, F.lit(REPLY_PAIR), 1)
    n2 = F.regexp_extract_all(r, F.lit(REPLY_PAIR), 2)
    v1 = F.regexp_extract_all(r, F.lit(REPLY_PAIR), 3)
    v2 = F.regexp_extract_all(r, F.lit(REPLY_PAIR), 4)
    z = F.arrays_zip(n1.alias("n1"), n2.alias("n2"), v1.alias("v1"), v2.alias("v2"))
    # The quote that matched decides: an empty group of the other alternative is ''.
    def plain(c):
        return F.regexp_replace(c, r"(?s)\\(.)", "$1")

    pairs = F.transform(z, lambda p: F.struct(plain(F.concat(p["n1"], p["n2"])).alias("name"),
                                              plain(F.concat(p["v1"], p["v2"])).alias("value")))
    return F.when(F.coalesce(r.rlike(REPLY_LIST), F.lit(False)), pairs)


def valid_slots(reply) -> Column:
    """Exactly five pairs; capacity '' or 'N ml'; price '' or '< N';
    names other than capacity and price are not checked."""
    def ok(pairs):
        return pairs.isNotNull() & (F.size(pairs) == 5) & F.forall(pairs, lambda p: (
            F.when(p["name"] == "capacity", (p["value"] == "") | p["value"].rlike(P.SLOT_CAPACITY))
             .when(p["name"] == "price", (p["value"] == "") | p["value"].rlike(P.SLOT_PRICE))
             .otherwise(F.lit(True))))

    return F.coalesce(T.once(reply_pairs(reply), ok), F.lit(False))


def capitalise_slots(pairs) -> Column:
    """Capacity lower-cased when not empty; every other value with the
    first letter of each word upper, the rest lower, single spaces."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.transform(p, lambda x: F.struct(
        x["name"].alias("name"),
        F.when((x["name"] == "capacity") & (x["value"] != ""), F.lower(x["value"]))
         .otherwise(T.capitalise_words(x["value"])).alias("value")))


def pairs_to_query(pairs) -> list[Column]:
    """The five slot columns; the last pair of a name wins; names are
    normalised ('olfactory category' -> 'olfactory_category'). Each column
    evaluates ``pairs``: where they are dear, give the name of a column."""
    p = F.col(pairs) if isinstance(pairs, str) else pairs
    norm = F.transform(p, lambda x: F.struct(F.replace(F.trim(x["name"]), F.lit(" "), F.lit("_")).alias("name"),
                                             x["value"].alias("value")))

    def named(slot):
        return lambda x: x["name"] == slot

    return [F.try_element_at(F.filter(norm, named(s)), F.lit(-1))["value"].alias(s) for s in SLOTS]


def resolve_replies(replies: DataFrame, texts: DataFrame, vocab: DataFrame, key: str = "query_id",
                    reply: str = "reply", text: str = "text_query") -> tuple[DataFrame, DataFrame]:
    """E16-E19 with E17 re-aimed: (slots, quarantine).

    Valid replies are parsed, capitalised (E18) and folded to one value per
    slot (E19); invalid ones are not retried in a loop: they go to the
    quarantine table and their texts are filled by the dictionary tagger (E15).
    """
    ok = valid_slots(reply)
    parsed = replies.where(ok).select(key, capitalise_slots(reply_pairs(reply)).alias("_pairs"))
    good = parsed.select(key, *pairs_to_query("_pairs"))
    bad = replies.where(~ok).select(key, reply)
    fallback = fill_slots(texts.join(bad.select(key), key, "left_semi"), vocab, key=key, text=text)
    return good.unionByName(fallback), bad
