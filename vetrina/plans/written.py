"""Queries that write with the library's sinks into the shared folder and read
back with its sources, and operators over what they read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..operators import enrich as E
from ..operators import evaluate as EV
from ..operators import extract as X
from ..operators import labels as L
from ..operators import mine as M
from ..operators import retrieve as R
from ..operators import search as S
from ..operators import slots as SL
from ..operators import triples as TR
from ..session import cut_lineage, scratch_path
from ..sources import io as IO
from . import catalogue as C
from . import graph as G
from . import registry as REG
from .registry import register

_EXT = C.sql_with(C.PAGES_SQL)


# ---------------------------------------------------------------- A1, A2, A5 - A7, A9

@register("seed_table", "SELECT '" + C.SHOP + "/p/' || CAST(p_partkey AS VARCHAR) AS permalink FROM part")
def q_seed_table(spark, sf):
    path = scratch_path(spark, "seed")
    IO.write_table(C.catalogue(spark, sf).select("permalink", "title"), path, fmt="csv")
    return IO.read_seed(spark, path).select("permalink")


def _csv_by_key(spark, sf):
    """``part`` as CSV files that hold its rows in the order of p_partkey."""
    path = scratch_path(spark, "ordered")
    part = C.part(spark, sf).select("p_partkey", "p_size", "p_name")
    IO.write_table(part.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), path, fmt="csv")
    return spark.read.option("header", True).schema("p_partkey bigint, p_size int, p_name string").csv(path)


@register("csv_last_row", "SELECT p_size, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) = 1")
def q_csv_last_row(spark, sf):
    """C13 by file order: of each size the last row of a CSV table."""
    rows = E.with_position(_csv_by_key(spark, sf))
    return E.latest_by_key(rows, "p_size", order=["_pos"], columns=["p_partkey", "p_name"])


@register("csv_line_numbers", "SELECT p_partkey, p_partkey AS by_line FROM part")
def q_csv_line_numbers(spark, sf):
    """A1 by file order: a line's number in its file, and the key that it must have there."""
    rows = E.with_line_number(_csv_by_key(spark, sf).withColumn("file", F.col("_metadata.file_path")))
    least = rows.groupBy("file").agg(F.min("p_partkey").alias("first"))
    return rows.join(least, "file").select("p_partkey", (F.col("first") + F.col("line")).alias("by_line"))


@register("added_columns", C.sql_with() + "SELECT id, title, upper(brand) AS shout, length(title) AS width FROM cat")
def q_added_columns(spark, sf):
    """Derived columns next to the row that they come from."""
    cat = C.catalogue(spark, sf).select("id", "title", "brand")
    return X.add_columns(cat, F.upper("brand").alias("shout"), F.length("title").cast("bigint").alias("width")).drop("brand")


@register("moved_column", C.sql_with() + """
SELECT id, 'id,capacity,title,brand' AS columns, title, brand, capacity FROM cat""")
def q_moved_column(spark, sf):
    """``capacity`` at the second place; ``columns`` has the order."""
    moved = X.move_column(C.catalogue(spark, sf).select("id", "title", "brand", "capacity"), "capacity", 1)
    return moved.withColumn("columns", F.lit(",".join(moved.columns)))


@register("graph_round_trip", _EXT + """
SELECT type, id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'Product' AS type, permalink || '/#richSnippet' AS id FROM ext
  UNION ALL SELECT 'Organization', 'SHOP/#organization' UNION ALL SELECT 'WebSite', 'SHOP/#website')
GROUP BY ALL""".replace("SHOP", C.SHOP))
def q_graph_round_trip(spark, sf):
    path = scratch_path(spark, "graph")
    IO.write_graph(G.enriched_graph(spark, sf), path)
    nodes = IO.read_graph(spark, path, lines=True)
    return nodes.dropDuplicates(["src", "block", "pos"]).groupBy("type", "id").agg(F.count(F.lit(1)).alias("n"))


@register("table_round_trip", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS scent_group,
       CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS category FROM part""")
def q_table_round_trip(spark, sf):
    path = scratch_path(spark, "table")
    table = C.attributes(spark, sf).select(F.element_at(F.split("permalink", "/"), -1).alias("id"), "scent_group", "category")
    IO.write_table(table, path, fmt="csv")
    return IO.read_table(spark, path, fmt="csv").select(F.col("id").cast("bigint").alias("id"), "scent_group", "category")


@register("id_csv", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS total, min(id) AS least, max(id) AS most
FROM (SELECT unnest([l_orderkey, l_partkey]) AS id FROM lineitem)""")
def q_id_csv(spark, sf):
    path = scratch_path(spark, "ids")
    li = C.table(spark, sf, "lineitem")
    li.select(F.concat_ws(",", "l_orderkey", F.lit("x"), "l_partkey", F.lit("")).alias("value")).write.text(path)
    ids = IO.read_id_csv(spark, path)
    return ids.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"), F.min("id").alias("least"), F.max("id").alias("most"))


@register("triple_lines", _EXT + """
SELECT '<' || permalink || '/#richSnippet> <http://schema.org/name> "' || title || '" .' AS line FROM ext GROUP BY ALL""")
def q_triple_lines(spark, sf):
    path = scratch_path(spark, "triples")
    IO.write_triples(TR.to_triples(G.products(spark, sf)), path)
    back = spark.read.text(path).where("p = 'http_schema_org_name'")
    return back.where(~F.col("value").startswith("_:")).select(F.col("value").alias("line"))


# ---------------------------------------------------------------- B7, C14, E15 - E17

@register("html_faults", """
SELECT p_partkey AS id, p_name || ' \u00e0 \u20ac\u2019\u2019 &lt; &bogus; \u00a92020 \u2019 \u00acit;  z' AS text FROM part""")
def q_html_faults(spark, sf):
    """Pages with thousands of adjacent tags, character references of all
    kinds, tags' ends and comments in quoted values, and blocks left open."""
    k = F.col("p_partkey")
    html = F.concat(F.repeat(F.lit("<p>"), F.when(k % 100 == 0, 20000).otherwise(1)), "p_name",
                    F.lit(" &agrave; &euro;&#8217;&#x2019; &amp;lt; &bogus; &copy2020 &#146; &notit; <a title=\"x>y\" data-a='<!--' it's>z</a>"),
                    F.when(k % 3 == 0, F.lit("<script>if (a<b) x")).otherwise(F.lit("</p><!-- end -->")))
    return C.part(spark, sf).select(k.alias("id"), T.html_to_text(html).alias("text"))


@register("enrich_last_wins", C.sql_with(C.PAGES_SQL) + """
SELECT permalink, CASE WHEN id % 4 = 0 THEN 'Last' ELSE gcategory END AS category,
       CAST(CASE WHEN id % 4 = 0 THEN 0 ELSE CAST(gcapacity IS NOT NULL AS INT) + CAST(gscent IS NOT NULL AS INT) END AS INT) AS n_props
FROM gp, range(m)""")
def q_enrich_last_wins(spark, sf):
    """Attribute rows repeat for every fourth product; the last row counts."""
    attrs = C.attributes(spark, sf).withColumn("pos", F.lit(1))
    k = F.element_at(F.split("permalink", "/"), -1).cast("bigint")
    late = attrs.where(k % 4 == 0).select("permalink", F.lit(None).cast("string").alias("capacity"), F.lit("").alias("scent_group"),
                                          F.lit("Last").alias("category"), F.lit(2).alias("pos"))
    nodes = E.enrich_nodes(G.products(spark, sf), attrs.unionByName(late), order=["pos"])
    props = F.try_variant_get("node", "$.additionalProperty", "array<variant>")
    return nodes.select(T.strip_suffix("id").alias("permalink"), F.try_variant_get("node", "$.category", "string").alias("category"),
                        F.coalesce(F.size(props), F.lit(0)).alias("n_props"))


_LONG = "p_name || ' casa ' || lower(p_brand) || ' del nord'"


@register("long_phrases", f"SELECT p_partkey AS query_id, {_LONG} AS brand, '50 ml' AS capacity, '< 30' AS price FROM part")
def q_long_phrases(spark, sf):
    """Brands of six words fill their slot."""
    part = C.part(spark, sf)
    brand = F.concat("p_name", F.lit(" casa "), F.lower("p_brand"), F.lit(" del nord"))
    vocab = SL.vocabulary(part.select(brand.alias("b")), "brand", "b")
    texts = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("profumo "), brand, F.lit(" 50ml minori di 30 euro")).alias("text_query"))
    return SL.fill_slots(texts, vocab).select("query_id", "brand", "capacity", "price")


@register("resolve_replies", C.sql_with(REG._REPLY_SQL) + f"""
SELECT id AS query_id, NOT bad AS from_reply, CASE WHEN bad THEN brand ELSE
       {REG._sql_cap_words("CASE WHEN id % 17 = 0 THEN upper(brand) ELSE brand END")} END AS brand FROM rp""")
def q_resolve_replies(spark, sf):
    """Valid replies are parsed and respelt, the others quarantined and their texts tagged."""
    replies = REG._replies(spark, sf).withColumnRenamed("id", "query_id")
    cat = C.catalogue(spark, sf)
    texts = cat.select(F.col("id").alias("query_id"), F.concat(F.lower("brand"), F.lit(" 50 ml")).alias("text_query"))
    slots, bad = SL.resolve_replies(replies, texts, SL.vocabulary(cat, "brand", "brand"))
    return (slots.join(bad.select("query_id", F.lit(True).alias("bad")), "query_id", "left")
                 .select("query_id", F.col("bad").isNull().alias("from_reply"), "brand"))


@register("slot_replies", C.sql_with() + "SELECT id, TRUE AS valid, brand || ' \"x\"' AS brand, category FROM cat")
def q_slot_replies(spark, sf):
    """Slots written as a reply and read back, with quotes and backslashes in them."""
    cat = C.catalogue(spark, sf).select("id", F.concat("brand", F.lit(' "x"')).alias("brand"), "category",
                                        F.lit("").alias("capacity"), F.lit("").alias("olfactory_category"), F.lit("< 30").alias("price"))
    replies = cat.select("id", SL.to_reply().alias("reply"))
    read = replies.select("id", SL.valid_slots("reply").alias("valid"), SL.reply_pairs("reply").alias("pairs"))
    return read.select("id", "valid", *SL.pairs_to_query("pairs")).select("id", "valid", "brand", "category")


# ---------------------------------------------------------------- A3, A8, E12, E13, F1 - F10 over saved logs

SIZES = ((2, 20), (3, 20), (4, 5))
_SAVED = {"graph": "sparql_results", "text": "text_results", "slots": "llm_results"}


def _saved_logs(spark, sf) -> str:
    """The logs of all query sizes with the truth and three systems' answers,
    and next to them a log of another suffix and one that is cut off."""
    path = scratch_path(spark, "logs")
    cat = C.catalogue(spark, sf)
    index = R.graph_index(G.enriched_products(spark, sf))
    mapping, docs, vocab = cut_lineage(G.id_mapping(spark, sf), "mapping"), REG._docs(spark, sf), cut_lineage(REG._vocab(spark, sf), "vocabulary")
    for n, support in SIZES:
        queries, truth = M.mine_queries(cat, n, categories=C.TEST_CATEGORIES, caps=C.TEST_CAPS, min_support=support, labels=C.TEST_LABELS)
        words = queries.select("query_id", R.to_keywords(queries).alias("text_query"))
        answers = {"results": truth, "sparql_results": R.match_queries(queries, index, mapping),
                   "text_results": S.keyword_search(words, docs, prices=cat.select("id", "price")),
                   "llm_results": R.match_queries(SL.fill_slots(words, vocab), index, mapping)}
        IO.write_query_log(queries, answers, f"{path}/{n}_LLM.json", lists=True)
    _other_logs(spark, sf, path)
    return path


def _other_logs(spark, sf, path) -> None:
    entry = F.concat(F.lit('{"query": {"brand": "'), "p_brand", F.lit('"}, "results": ['), "p_partkey", F.lit("]}"))
    part = C.part(spark, sf)
    part.select(entry).write.text(f"{path}/2_SPARQL.json")
    part.where("p_partkey % 10 = 0").select(F.left(entry, F.lit(25))).write.text(f"{path}/cut_LLM.json")


def _read_logs(spark, path):
    schema = Ty.StructType([*IO.LOG_SCHEMA.fields, Ty.StructField("query_id", Ty.StringType())])
    log, _ = IO.valid_entries(IO.read_logs(spark, path, schema=schema))
    return log


@register("log_errors", "SELECT 'cut_LLM.json' AS file, CAST(count(*) AS BIGINT) AS n, max(length(p_brand)) * 0 + 25 AS width FROM part WHERE p_partkey % 10 = 0")
def q_log_errors(spark, sf):
    """Entries that can't be parsed, by the log that has them; a log of another suffix isn't read."""
    path = scratch_path(spark, "logs")
    _other_logs(spark, sf, path)
    _, errors = IO.valid_entries(IO.read_logs(spark, path))
    return errors.groupBy("file").agg(F.count("*").alias("n"), F.max(F.length("error")).alias("width"))


def _log_sql(n: int, support: int) -> str:
    return (C.sql_with(REG._mined_queries_sql(n, support), C.PAGES_SQL) + REG._KW_SQL.join([",", ""]) + REG._text_sql()
            + REG._slots_sql() + REG._match_sql("mq", "ga") + REG._match_sql("fs", "sa"))


@register("saved_answers", " UNION ALL ".join(f"""
SELECT '{n}_LLM.json' AS file, query_id, system, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS total FROM (
  {_log_sql(n, s)} SELECT query_id, 'graph' AS system, id FROM (SELECT query_id, id, unnest(range(solutions)) FROM ga)
  UNION ALL SELECT query_id, 'text', id FROM ta
  UNION ALL SELECT query_id, 'slots', id FROM (SELECT query_id, id, unnest(range(solutions)) FROM sa)) GROUP BY ALL""" for n, s in SIZES))
def q_saved_answers(spark, sf):
    log = _read_logs(spark, _saved_logs(spark, sf))
    answers = EV.log_answers(log, _SAVED)
    return answers.groupBy("file", "query_id", "system").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


def _file_metrics_sql(n: int, support: int) -> str:
    return _log_sql(n, support) + """,
truth AS (SELECT DISTINCT query_id, id FROM mq0),
ans AS (SELECT DISTINCT query_id, 'graph' AS system, id FROM ga UNION SELECT DISTINCT query_id, 'text', id FROM ta
        UNION SELECT DISTINCT query_id, 'slots', id FROM sa),
nt AS (SELECT query_id, count(*) AS n FROM truth GROUP BY ALL),
na AS (SELECT query_id, system, count(*) AS n FROM ans GROUP BY ALL),
np AS (SELECT query_id, system, count(*) AS n FROM ans JOIN truth USING (query_id, id) GROUP BY ALL),
pr AS (SELECT q.query_id, q.price, s.system, COALESCE(np.n / na.n, 0.0) AS precision, COALESCE(np.n / nt.n, 0.0) AS recall
       FROM mq q JOIN (VALUES ('graph'), ('text'), ('slots')) s(system) ON TRUE LEFT JOIN nt USING (query_id)
       LEFT JOIN na ON na.query_id = q.query_id AND na.system = s.system
       LEFT JOIN np ON np.query_id = q.query_id AND np.system = s.system),
pf AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
sliced AS (SELECT *, unnest(['all', CASE WHEN price IS NULL THEN 'without' ELSE 'with' END]) AS slice FROM pf),
grid AS (SELECT DISTINCT system, unnest(['all', 'with', 'without']) AS slice FROM pf)
SELECT system, slice, COALESCE(avg(precision), 0.0) AS precision, COALESCE(avg(recall), 0.0) AS recall,
       COALESCE(avg(f1), 0.0) AS f1, CAST(count(query_id) AS BIGINT) AS query_count
FROM grid LEFT JOIN sliced USING (system, slice) GROUP BY ALL"""


@register("metrics_by_file", " UNION ALL ".join(f"""
SELECT '{n}_LLM.json' AS file, slice, system, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, query_count
FROM ({_file_metrics_sql(n, s)})""" for n, s in SIZES))
def q_metrics_by_file(spark, sf):
    """Logs of all sizes saved, read back and scored per file."""
    log = cut_lineage(_read_logs(spark, _saved_logs(spark, sf)), "log")
    keys = ["file", "query_id"]
    truth = log.select(*keys, F.explode("results").alias("id"))
    ids = log.agg(*[F.sum(F.greatest(F.size(c), F.lit(0))) for c in ("results", *_SAVED.values())]).first()
    scores = EV.per_query(log, truth, EV.log_answers(log, _SAVED), list(_SAVED), keys, rows=sum(n or 0 for n in ids))
    # Written, as the slices read it twice: a row per query and system.
    scored = cut_lineage(scores.join(log.select(*keys, F.col("query.price").alias("price")), keys), "scores")
    return EV.report(EV.slices(scored, F.col("price").isNotNull(), group=("file", "system")), digits=6)


@register("answer_lists", C.sql_with(REG._mined_queries_sql(2, 20), C.PAGES_SQL) + REG._match_sql("mq", "ga") + """
SELECT q.query_id, CAST(COALESCE(sum(solutions), 0) AS BIGINT) AS n, COALESCE(CAST(min(id) AS BIGINT), -1) AS least
FROM mq q LEFT JOIN ga USING (query_id) GROUP BY q.query_id""")
def q_answer_lists(spark, sf):
    """The ID list of each query, empty where it has no answer."""
    queries = cut_lineage(REG._mined(spark, sf), "queries")
    lists = R.answers_to_lists(REG._graph_answers(spark, sf, queries), queries, "ids")
    return lists.groupBy("query_id").agg(F.sum(F.size("ids")).alias("n"), F.coalesce(F.min(F.try_element_at("ids", F.lit(1))), F.lit(-1)).alias("least"))
