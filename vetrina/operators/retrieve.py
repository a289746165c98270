"""Graph retrieval (E1-E13): structured queries answered over product nodes.

A graph-pattern query (product typed ``Product`` with a name; category
CONTAINS v; a ``Capacita`` property equal to v; a typed Brand named v; a
``Gruppo Olfattivo`` property CONTAINS v; an offer with price and currency
below N) is answered for a whole query log at once, as a relational division:

* Product nodes become long *facts* ``(node, feature, value, price, cnt)``.
  Literal values collapse per node id (RDF set semantics for literals);
  brand, property and offer objects are blank nodes, so duplicates count
  (``cnt``): the bag multiplicity of the SPARQL answer is the product of the
  per-feature counts times the number of names.
* The log's distinct values are resolved against the facts once: equal values,
  and for CONTAINS the fact values that hold a query value (a q-gram index: a
  query value meets the fact values that share its rarest gram, then each pair
  is verified). What is left is *hits* ``(node, vid, cnt)``, the facts of the
  log's values only.
* The log's caps are a table. Distinct prices and caps are put in one order
  by a range partitioning, whose running counts give each price the place of the
  tightest cap above it. Prices add up per node and place by a partial
  aggregation, so a node has at most one row per cap however many offers it has.
* A product is one row with its hits and its price rows, and meets the queries
  whose values it has all of (``subsets.contained``): queries share the rows
  that they have in common, and none is made for a query's rarest value alone.
  Caps are compared within the row. Products stay where their ids add up, so
  answers are not shuffled.
* Queries of a price only meet a node's prices at places of such caps, so each
  row made for them is an answer.
* Queries without features are set apart, and only where there are any: each
  gets every named product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import BROADCAST_MAX_BYTES, bounded_broadcast, cut_lineage, row_bytes
from .subsets import contained

FACT_FEATURES = ["brand", "category", "capacity", "olfactory_category", "price"]
CONTAINS = ("category", "olfactory_category")
#: Longest gram of the CONTAINS index; shorter query values are grams themselves.
GRAM = 3
#: Places of the cap order whose running sums one window group holds.
BLOCK = 4096
#: Products of a task that looks for the queries they answer.
PART_ROWS = 20_000
#: Parts of the products where the queries without features are too many to broadcast.
SALTS = 256
#: Ids of an answer list that one group gathers, about.
LIST_IDS = 100_000
#: Copies of one id that a row of a list makes at once.
COPIES = 4096


# ---------------------------------------------------------------- E1, E2

def to_keywords(queries: DataFrame) -> Column:
    """E1 over a query table."""
    return T.to_keywords("category", "olfactory_category", "capacity", "brand", "price")


def _esc(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def to_sparql(brand="brand", category="category", capacity="capacity", olfactory="olfactory_category",
              price="price") -> Column:
    """The query text as data (values escaped; Spark never parses it)."""
    b, c, k, o, p = (F.col(x) if isinstance(x, str) else x for x in (brand, category, capacity, olfactory, price))

    def present(x):
        return x.isNotNull() & (x != "")

    cap = F.trim(F.replace(p, F.lit("<"), F.lit("")))
    parts = [
        F.lit("PREFIX schema: <http://schema.org/>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
              "SELECT ?product WHERE {\n  ?product a schema:Product ; schema:name ?name ."),
        F.when(present(p), F.lit("\n  ?product schema:offers ?offer .")),
        F.when(present(c), F.concat(F.lit('\n  ?product schema:category ?category . FILTER(CONTAINS(?category, "'),
                                    _esc(c), F.lit('"))'))),
        F.when(present(k), F.concat(F.lit('\n  ?product schema:additionalProperty [ a schema:PropertyValue ; '
                                          'schema:name "Capacita" ; schema:value "'), _esc(k), F.lit('" ] .'))),
        F.when(present(b), F.concat(F.lit('\n  ?product schema:brand [ a schema:Brand ; schema:name "'),
                                    _esc(b), F.lit('" ] .'))),
        F.when(present(o), F.concat(F.lit('\n  ?product schema:additionalProperty [ a schema:PropertyValue ; '
                                          'schema:name "Gruppo Olfattivo" ; schema:value ?olfattivo ] . '
                                          'FILTER(CONTAINS(?olfattivo, "'), _esc(o), F.lit('"))'))),
        F.when(present(p), F.concat(F.lit("\n  ?offer schema:price ?price ; schema:priceCurrency ?currency . "
                                          "FILTER(xsd:decimal(?price) < "), cap, F.lit(")"))),
        F.lit("\n}"),
    ]
    return F.concat_ws("", *parts)


# ---------------------------------------------------------------- facts

@dataclass
class GraphIndex:
    """Written graph facts, keyed by a 96-bit hash of the node id (``u1``
    xxhash64, ``u2`` murmur3), so retrieval shuffles fixed-width keys instead
    of IRIs: nodes(u1, u2, link, n_names) of named products, facts(u1, u2,
    feature, value, price, cnt)."""

    nodes: DataFrame
    facts: DataFrame


def graph_index(products: DataFrame) -> GraphIndex:
    """E3-E8 facts of typed, enriched product rows.

    One projection builds every fact of a row, one explode and one partial
    aggregation count them: the product input is scanned once. Literal facts
    (name, category) collapse per node id (cnt = 1); blank-node facts (brand,
    properties, offers) keep their multiplicity. The link travels with the
    name facts. Both tables are written once to the shared checkpoint folder;
    retrieval reads them several times and systems share them.
    """
    nul_s, nul_d = F.lit(None).cast("string"), F.lit(None).cast(T.DECIMAL)

    def fact(feature, value, price, literal):
        return F.struct(F.lit(feature).alias("feature"), value.alias("value"), price.alias("price"),
                        F.lit(literal).alias("lit"))

    name = F.when(F.col("name").isNotNull(), F.array(fact("name", F.col("name"), nul_d, True)))
    cat = F.when(F.col("category").isNotNull(), F.array(fact("category", F.col("category"), nul_d, True)))
    brand = F.when((F.col("brand_type") == "Brand") & F.col("brand").isNotNull(),
                   F.array(fact("brand", F.col("brand"), nul_d, False)))
    props = F.transform(
        F.filter(F.coalesce(F.col("properties"), F.array()),
                 lambda pv: (pv["@type"] == "PropertyValue") & pv["value"].isNotNull()
                 & pv["name"].isin(V.PROP_CAPACITY, V.PROP_SCENT)),
        lambda pv: F.struct(
            F.when(pv["name"] == V.PROP_CAPACITY, F.lit("capacity")).otherwise(F.lit("olfactory_category"))
             .alias("feature"),
            pv["value"].alias("value"), nul_d.alias("price"), F.lit(False).alias("lit")))
    offers = F.transform(
        F.filter(F.coalesce(F.col("offers"), F.array()),
                 lambda o: o["priceCurrency"].isNotNull() & T.decimal_or_null(o["price"]).isNotNull()),
        lambda o: fact("price", nul_s, T.decimal_or_null(o["price"]), False))
    empty = F.array().cast(f"array<struct<feature:string,value:string,price:{T.DECIMAL},lit:boolean>>")
    all_facts = F.concat(*[F.coalesce(x, empty) for x in (name, cat, brand, props, offers)])
    keyed = (products.where(F.col("uri").isNotNull())
             .select(F.xxhash64("uri").alias("u1"), F.hash("uri").alias("u2"),
                     T.strip_all(F.col("uri")).alias("link"), all_facts.alias("fs")))
    counted = (keyed.select("u1", "u2", "link", F.explode("fs").alias("f"))
               .groupBy("u1", "u2", "f.feature", "f.value", "f.price",
                        F.when(F.col("f.feature") == "name", F.col("link")).alias("link"))
               .agg(F.count(F.lit(1)).alias("n"), F.max("f.lit").alias("lit"))
               .select("u1", "u2", "feature", "value", "price", "link",
                       F.when(F.col("lit"), F.lit(1)).otherwise(F.col("n")).cast("bigint").alias("cnt")))
    facts = cut_lineage(counted, "facts")
    nodes = cut_lineage(facts.where(F.col("feature") == "name").groupBy("u1", "u2")
                        .agg(F.first("link").alias("link"), F.count(F.lit(1)).alias("n_names")), "nodes")
    return GraphIndex(nodes, facts.where(F.col("feature") != "name").drop("link"))


def query_features(queries: DataFrame, keyed: bool = False) -> DataFrame:
    """(query_id, k, feature, value, cap): one row per present feature.

    ``keyed``: also a dense query key ``q`` (assigned before the explode, so
    once per query) and one row with a NULL feature for a query without any
    (k = 0)."""
    cols = []
    for f in FACT_FEATURES:
        v = F.col(f)
        present = v.isNotNull() & (F.trim(v) != "")
        cap = T.parse_cap(v) if f == "price" else F.lit(None).cast(T.DECIMAL)
        cols.append(F.when(present, F.struct(F.lit(f).alias("feature"),
                                             (F.lit(None).cast("string") if f == "price" else v).alias("value"),
                                             cap.alias("cap"))))
    arr = F.filter(F.array(*cols), lambda x: x.isNotNull())
    key = [F.monotonically_increasing_id().alias("q")] if keyed else []
    explode = F.explode_outer if keyed else F.explode
    return (queries.select("query_id", *key, arr.alias("fs"))
                   .select("query_id", *(["q"] if keyed else []), F.size("fs").alias("k"), explode("fs").alias("f"))
                   .select("query_id", *(["q"] if keyed else []), "k", "f.feature", "f.value", "f.cap"))


def substrings(s: Column, lengths: Sequence[int]) -> Column:
    """The substrings of s of the given lengths (for an exact CONTAINS
    equi-join): O(len(s)) of each length."""
    n = F.length(s)
    empty = F.array().cast("array<string>")

    def of(size):
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(s, i, F.lit(size)))).otherwise(empty)

    return F.concat(empty, *[of(x) for x in lengths])


U = ["u1", "u2"]


def _resolve(values: DataFrame, facts: DataFrame, nbytes: int) -> DataFrame:
    """(feature, value, vid): the fact values that each query value matches,
    for ``values(vid, feature, value)`` of ``nbytes`` at most, without a cross
    join.

    CONTAINS goes over a q-gram index of the distinct fact values: their grams
    of 1 to ``GRAM`` characters, only those that query values ask for. A query
    value of ``GRAM`` characters or more asks for its grams of that length, a
    shorter one for itself. It meets the holders of the gram that fewest
    values hold, and each pair is verified; a gram that no value holds leaves
    no pair. Rows of the index grow with the fact values' length, whatever
    lengths the query values have.
    """
    equal = values.where(~F.col("feature").isin(*CONTAINS)).select("feature", "value", "vid")
    parts = values.where(F.col("feature").isin(*CONTAINS)).select("feature", F.col("value").alias("part"), "vid")
    own = F.when(F.length("part") >= GRAM, substrings(F.col("part"), [GRAM])).otherwise(F.array("part"))
    wanted = parts.select("feature", "part", "vid", F.explode(F.array_distinct(own)).alias("gram"))
    held = facts.where(F.col("feature").isin(*CONTAINS)).select("feature", "value").distinct()
    index = held.select("feature", "value", F.explode(F.array_distinct(substrings(F.col("value"), range(1, GRAM + 1)))).alias("gram"))
    # A value of n characters asks for n grams of GRAM characters at most.
    grams = bounded_broadcast(wanted.select("feature", "gram").distinct(), (GRAM + 2) * nbytes)
    index = index.join(grams, ["feature", "gram"], "left_semi")
    holders = index.groupBy("feature", "gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (wanted.join(holders, ["feature", "gram"], "left").groupBy("feature", "part", "vid")
                    .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"))
                    .where(F.col("key.n") > 0).select("feature", "part", "vid", F.col("key.gram").alias("gram")))
    found = index.join(bounded_broadcast(rarest, 2 * nbytes), ["feature", "gram"]).where(F.col("value").contains(F.col("part")))
    return equal.unionByName(found.select("feature", "value", "vid"))


def _running(rows: DataFrame, place: str, n: Column, by: Column | None = None) -> DataFrame:
    """``rows`` with ``upto``: the sum of ``n`` over all rows whose ``place``
    (distinct) is not beyond their own. Each group of ``by``, consecutive places,
    adds up its own rows; one sum a group is carried over. Without ``by`` the
    places are gapless integers from 0, in groups of ``BLOCK``."""
    rows = rows.withColumn("_n", n).withColumn("_by", F.floor(F.col(place) / BLOCK) if by is None else by)
    before = (rows.groupBy("_by").agg(F.sum("_n").alias("_s"))
                  .select("_by", F.coalesce(F.sum("_s").over(Window.orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b")))
    inside = F.sum("_n").over(Window.partitionBy("_by").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_i", inside).join(before, "_by").withColumn("upto", F.col("_i") + F.col("_b")).drop("_n", "_by", "_i", "_b")


def _cap_places(facts: DataFrame, caps: DataFrame) -> DataFrame:
    """(value, asked, place, above): the distinct prices and caps of ``caps(cap)``;
    for caps (``asked``) their place from 0 in rising order (else null), and for
    each value the place of the tightest cap above it (the number of caps, where none is)."""
    points = (facts.where(F.col("feature") == "price").select(F.col("price").alias("value"), F.lit(False).alias("priced"))
              .unionByName(caps.select(F.col("cap").alias("value"), F.lit(True).alias("priced")))
              .groupBy("value").agg(F.max("priced").alias("asked")))
    # Written, so that a point's part of the order is the same each time it is read.
    parts = cut_lineage(points.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "points")
    run = _running(parts, "value", F.col("asked").cast("int"), F.col("part"))
    place = F.when(F.col("asked"), F.col("upto") - 1).cast("int")
    return run.select("value", "asked", place.alias("place"), F.col("upto").cast("int").alias("above"))


def _price_rows(facts: DataFrame, points: DataFrame, n_caps: int) -> DataFrame:
    """(u1, u2, rank, cnt): offers by the place of the tightest cap above
    their price."""
    ranks = points.where(F.col("above") < n_caps).select(F.col("value").alias("price"), F.col("above").alias("rank"))
    return (facts.where(F.col("feature") == "price").select(*U, "price", "cnt")
                 .join(ranks, "price")  # a written table: the planner knows its size
                 .groupBy(*U, "rank").agg(F.sum("cnt").alias("cnt")))


def match_queries(queries: DataFrame, products: DataFrame | GraphIndex, mapping: DataFrame | None = None,
                  bag: bool = True) -> DataFrame:
    """Answers (query_id, id, solutions) of every query of the log.

    ``products``: typed enriched product rows, or their ``graph_index`` (to
    share it between systems); ``mapping``: (permalink, id), already
    deduplicated (C13). Without a mapping the suffix-stripped uri (E11) is
    returned as ``id``. ``bag=False`` gives set answers (solutions = 1). Equal
    queries of one id are answered once; different ones add up.

    Small tables are written while the plan is built (the log's features, its
    values' hits); ``session.drop_intermediates`` removes them. Driver-side
    values are counts and sizes only, and the plan is the same for any number
    of values and caps.
    """
    idx = products if isinstance(products, GraphIndex) else graph_index(products)
    features = cut_lineage(query_features(queries.select("query_id", *FACT_FEATURES).distinct(), keyed=True), "query-features")
    # One pass over the written log: its size bounds every query-side table below.
    log_bytes, n_caps, unasked = features.agg(
        F.sum(row_bytes(features)), F.count_distinct("cap"), F.count(F.when(F.col("k") == 0, 1))).first()
    log_bytes = log_bytes or 0

    # The log's distinct values, and the facts that match them.
    plain = features.where(F.col("feature").isNotNull() & (F.col("feature") != "price"))
    values = cut_lineage(plain.select("feature", "value").distinct().withColumn("vid", F.monotonically_increasing_id()), "values")
    resolved = cut_lineage(_resolve(values, idx.facts, log_bytes), "resolved")  # the planner knows its size
    hits = cut_lineage(idx.facts.where(F.col("feature") != "price").join(resolved, ["feature", "value"])
                       .groupBy(*U, "vid").agg(F.sum("cnt").alias("cnt")), "hits")
    capped = features.where((F.col("feature") == "price") & F.col("cap").isNotNull())
    prices = edges = None
    if n_caps:
        points = cut_lineage(_cap_places(idx.facts, capped.select("cap").distinct()), "places")
        prices = cut_lineage(_price_rows(idx.facts, points, n_caps), "prices")
        # Each cap with its place and the price rows that it or a lower one is the tightest for.
        at = prices.groupBy("rank").agg(F.count(F.lit(1)).alias("rows"))
        edges = (points.where("asked").select(F.col("value").alias("cap"), F.col("place").alias("rank"))
                       .join(at, "rank", "left"))
        edges = cut_lineage(_running(edges, "rank", F.coalesce("rows", F.lit(0))).withColumnRenamed("upto", "n"), "caps")

    # Each query's values, rarest first; one that no node has leaves no answer.
    n_vid = hits.groupBy("vid").agg(F.count(F.lit(1)).alias("n"))
    each = (plain.join(bounded_broadcast(values, log_bytes), ["feature", "value"]).join(n_vid, "vid")
                 .select("q", F.struct("n", "vid").alias("of"), F.lit(None).cast("int").alias("cap_rank")))
    if n_caps:
        each = each.unionByName(capped.join(bounded_broadcast(edges, log_bytes), "cap")
                                .select("q", F.lit(None).cast("struct<n:bigint,vid:bigint>").alias("of"), F.col("rank").alias("cap_rank")))
    asked = features.where(F.col("feature").isNotNull()).groupBy("q").agg(F.first("query_id").alias("query_id"), F.first("k").alias("k"))
    # Answers of all queries of one id add up under the least of their keys.
    names = asked.groupBy("query_id").agg(F.min("q").alias("key"))
    plan = (each.groupBy("q").agg(F.transform(F.array_sort(F.collect_list("of")), lambda o: o["vid"]).alias("need"),
                                  F.max("cap_rank").alias("cap_rank"), F.count(F.lit(1)).alias("n_given"))
                .join(asked, "q").where(F.col("n_given") == F.col("k"))  # a price that is no number matches nothing
                .join(names, "query_id").select("key", "need", "cap_rank"))
    plan = cut_lineage(plan, "plan")

    # Named products with all they have, as one row each, where their answers add up.
    nodes = idx.nodes
    if mapping is None:
        nodes = nodes.withColumnRenamed("link", "id")
    else:
        nodes = nodes.join(mapping.select(F.col("permalink").alias("link"), "id"), "link")
    nodes = nodes.select(*U, "id", "n_names")
    have = (hits.join(bounded_broadcast(n_vid, log_bytes), "vid").groupBy(*U)
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "vid", "cnt"))), lambda h: F.struct(h["vid"].alias("item"), h["cnt"].alias("cnt"))).alias("hits")))
    rows = have.join(nodes, U)
    none = F.array().cast("array<struct<rank:int,cnt:bigint>>")
    if n_caps:
        offers = prices.groupBy(*U).agg(F.collect_list(F.struct("rank", "cnt")).alias("prices"))
        rows = rows.join(offers, U, "left").withColumn("prices", F.coalesce("prices", none))
    else:
        rows = rows.withColumn("prices", none)
    best = F.array_min(F.transform("prices", lambda p: p["rank"]))  # null: no offer below any cap
    rows = rows.select("id", "n_names", "prices", best.alias("best"), "hits").repartition(_parts(idx), "id")
    sets = plan.where(F.size("need") > 0).select("need", F.struct("cap_rank", "key").alias("ask"))
    good = (contained(rows, sets, log_bytes)
            .select("id", "n_names", "prices", "best", "mult", F.explode("asks").alias("ask"))
            .where(F.col("ask.cap_rank").isNull() | (F.col("ask.cap_rank") >= F.col("best"))))
    below = F.aggregate(F.filter("prices", lambda p: p["rank"] <= F.col("ask.cap_rank")), F.lit(0).cast("bigint"), lambda acc, p: acc + p["cnt"])
    # The prices of one place are all below, as the cap is one at or above it.
    times = (F.when(F.col("ask.cap_rank").isNull(), F.lit(1).cast("bigint"))
              .when(F.size("prices") == 1, F.col("prices")[0]["cnt"]).otherwise(below))
    sol = good.select(F.col("ask.key").alias("key"), "id", (F.col("mult") * times * F.col("n_names")).alias("solutions"))
    if n_caps:  # queries of a price only
        driving = plan.where(F.size("need") == 0).select("key", F.col("cap_rank").alias("rank"))
        drives = driving.select("rank").distinct().withColumn("drives", F.lit(1))
        # The driving caps have places of their own; a price goes to the first of them at or above its cap.
        own = _running(edges.select("rank").join(drives, "rank", "left"), "rank", F.coalesce("drives", F.lit(0)))
        own = own.select("rank", "drives", (F.col("upto") - F.coalesce("drives", F.lit(0))).cast("int").alias("place"))
        own = cut_lineage(own, "driving-caps")
        n_drives = own.where(F.col("drives") == 1).count()
        if n_drives:
            small = bounded_broadcast(own, 2 * log_bytes)
            reach = (prices.join(small.select("rank", "place"), "rank").where(F.col("place") < n_drives)
                           .groupBy(*U, "place").agg(F.sum("cnt").alias("cnt"))
                           .select(*U, "cnt", F.explode(F.sequence("place", F.lit(n_drives - 1))).alias("place")))
            reach = reach.groupBy(*U, "place").agg(F.sum("cnt").alias("cnt"))
            by_place = driving.join(small.where(F.col("drives") == 1), "rank").select("key", "place")
            sol = sol.unionByName(reach.join(bounded_broadcast(by_place, log_bytes), "place").join(nodes, U)
                                       .select("key", "id", (F.col("cnt") * F.col("n_names")).alias("solutions")))
    sol = sol.groupBy("key", "id").agg(F.sum("solutions").cast("bigint").alias("solutions"))
    out = sol.join(bounded_broadcast(names, log_bytes), "key").select("query_id", "id", "solutions")
    if unasked:  # every named product, for each such query
        # Beyond a broadcast's size each part of the products meets its own copy of these queries.
        salts = 1 if log_bytes <= BROADCAST_MAX_BYTES else SALTS
        empty = (features.where(F.col("k") == 0)
                         .select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")))
        every = nodes.withColumn("salt", F.pmod(F.xxhash64(*U), F.lit(salts))).join(bounded_broadcast(empty, log_bytes), "salt")
        out = (out.unionByName(every.select("query_id", "id", F.col("n_names").alias("solutions")))
                  .groupBy("query_id", "id").agg(F.sum("solutions").cast("bigint").alias("solutions")))
    return out if bag else out.select("query_id", "id", F.lit(1).cast("bigint").alias("solutions"))


def _parts(idx: GraphIndex) -> int:
    """Partitions of the products: the session's number, more where each would
    have more than ``PART_ROWS``."""
    session = int(idx.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(session, -(-idx.nodes.count() // PART_ROWS))


def answers_to_lists(answers: DataFrame, queries: DataFrame, system: str) -> DataFrame:
    """(query_id, part, ids ARRAY<BIGINT> sorted, duplicates kept by
    multiplicity); queries with no answer keep an empty list. A list of up to
    ``LIST_IDS`` ids is part 0 alone. A longer one is cut, else the products of
    a common value would all go through one group: its parts, of about as many
    ids at most, make it up in rising order of ``part`` (not gapless).

    The answers are written while the plan is built; the driver sees their
    number only."""
    # Written, as the range partitioning reads its rows twice.
    got = cut_lineage(answers.where(F.col("id").isNotNull()).select("query_id", "id", "solutions"), "answers")
    sizes = cut_lineage(got.groupBy("query_id").agg(F.sum("solutions").alias("n")), "list-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # Copies of one id are cut too, so no array has more than ``COPIES`` of them.
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("solutions") - 1) / COPIES))).alias("at")
    some = F.least(F.col("solutions") - F.col("at") * COPIES, F.lit(COPIES)).cast("int")
    each = (got.join(bounded_broadcast(sizes), "query_id").select("query_id", "id", "solutions", "n", cut)
               .select("query_id", "n", "at", F.explode(F.array_repeat("id", some)).alias("id")))
    dealt = each.repartitionByRange(max(1, -(-total // LIST_IDS)), "query_id", "id", "at")
    part = F.when(F.col("n") > LIST_IDS, F.spark_partition_id()).otherwise(0).alias("part")
    lists = dealt.select("query_id", part, "id").groupBy("query_id", "part").agg(F.sort_array(F.collect_list("id")).alias(system))
    return (queries.select("query_id").join(lists, "query_id", "left")
                   .select("query_id", F.coalesce("part", F.lit(0)).alias("part"),
                           F.coalesce(F.col(system), F.array().cast("array<bigint>")).alias(system)))
