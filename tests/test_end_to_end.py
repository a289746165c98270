"""On clean data the graph system answers every mined query without a label
exactly as the truth does (F1 = 1), and F scores it so."""

from pyspark.sql import functions as F

from vetrina.operators import evaluate as EV
from vetrina.operators import mine as M
from vetrina.operators import retrieve as R

from .test_mine import fixture_rows

PROD = ("src string, block int, pos int, uri string, name string, category string, brand_type string, "
        "brand string, offers array<struct<price:string,priceCurrency:string>>, "
        "properties array<struct<`@type`:string,name:string,value:string>>")


def test_graph_equals_truth_on_clean_data(spark):
    rows = fixture_rows(n=80, seed=5)
    cat = spark.createDataFrame(
        [(r["id"], r["brand"], r["category"], r["capacity"], None if r["price"] is None else str(r["price"]),
          r["labels"]) for r in rows],
        "id long, brand string, category string, capacity string, price string, labels array<string>",
    ).selectExpr("id", "brand", "category", "capacity", "cast(price as decimal(18,4)) as price", "labels")
    prods = spark.createDataFrame([
        ("s", 0, r["id"], f"p/{r['id']}/#richSnippet", f"n{r['id']}", r["category"],
         "Brand" if r["brand"] else None, r["brand"],
         [] if r["price"] is None else [(str(r["price"]), "EUR")],
         ([("PropertyValue", "Capacita", r["capacity"])] if r["capacity"] else [])
         + [("PropertyValue", "Gruppo Olfattivo", " ".join(r["labels"]))])
        for r in rows], PROD)
    mapping = spark.createDataFrame([(f"p/{r['id']}", r["id"]) for r in rows], "permalink string, id long")
    queries, truth = M.mine_queries(cat, 2, categories=["Fragranze Donna", "Fragranze Uomo"], caps=[30, 50, 100],
                                    min_support=3, min_values=5, top_capacities=2, pairs=[])
    plain = queries.where(F.col("olfactory_category").isNull())
    assert plain.count() > 10
    graph = R.match_queries(plain, prods, mapping)
    t = {(r["query_id"], r["id"]) for r in truth.join(plain, "query_id", "left_semi").collect()}
    g = {(r["query_id"], r["id"]) for r in graph.collect()}
    assert g == t
    ans = graph.select("query_id", F.lit("graph").alias("system"), "id")
    m = EV.macro(EV.per_query(plain, truth, ans, ["graph"])).first()
    assert (m["precision"], m["recall"], m["f1"]) == (1.0, 1.0, 1.0)
