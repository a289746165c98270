"""C13, C14 edge rows; readers and writers round trips; A10 restart."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vetrina.operators import enrich as E
from vetrina.operators import extract as X
from vetrina.sources import io as IO
from vetrina.streaming import ingest as ST


def test_latest_by_key_keeps_null(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("j", 1, "x")], "key string, pos int, v string")
    got = {r["key"]: r["v"] for r in E.latest_by_key(df, "key", order=["pos"]).collect()}
    assert got == {"k": None, "j": "x"}


def _nodes(spark, docs):
    pages = spark.createDataFrame(
        [(f"u{i}", 200, '<script type="application/ld+json">' + json.dumps(d) + "</script>")
         for i, d in enumerate(docs)], "url string, status int, html string")
    nodes, _ = X.extract_nodes(pages)
    return nodes


def test_enrich_nodes_c14(spark):
    docs = [{"@graph": [
        {"@type": "Product", "@id": "p1/#richSnippet", "category": "old", "extra": {"k": 1}},
        {"@type": "Product", "@id": "p2", "category": "old2",
         "additionalProperty": {"@type": "PropertyValue", "name": "x", "value": "y"}},
        {"@type": "Product", "@id": "p3", "category": "keep"},
        {"@type": "Organization", "@id": "p1"},
    ]}]
    attrs = spark.createDataFrame([("p1", "50 ml", "Floreale", "New"), ("p2", None, "", None),
                                   ("p3", None, None, None)],
                                  "permalink string, capacity string, scent_group string, category string")
    out = E.enrich_nodes(_nodes(spark, docs), attrs)
    rows = {r["id"]: json.loads(r["j"]) for r in out.select("id", F.to_json("node").alias("j")).collect()}
    p1 = rows["p1/#richSnippet"]
    assert p1["category"] == "New" and p1["extra"] == {"k": 1}
    assert [(p["name"], p["value"]) for p in p1["additionalProperty"]] == [("Capacita", "50 ml"),
                                                                            ("Gruppo Olfattivo", "Floreale")]
    assert rows["p2"]["category"] == "old2" and "additionalProperty" in rows["p2"]
    assert rows["p3"] == {"@type": "Product", "@id": "p3", "category": "keep"}
    assert rows["p1"] == {"@type": "Organization", "@id": "p1"}
    assert out.count() == 4


def test_graph_round_trip(spark, tmp):
    nodes = _nodes(spark, [{"@graph": [{"@type": "Product", "@id": "à", "name": "Café"}]}])
    IO.write_graph(nodes, f"{tmp}/g")
    back = IO.read_graph(spark, f"{tmp}/g", lines=True).collect()
    assert [(r["id"], r["type"]) for r in back] == [("à", "Product")]
    with open(f"{tmp}/doc.json", "w") as f:
        json.dump({"@context": "https://schema.org", "@graph": [{"@type": "WebSite"}, {"@type": "Product"}]}, f)
    with open(f"{tmp}/empty.json", "w") as f:
        json.dump({"@context": "https://schema.org"}, f)
    docs = IO.read_graph(spark, f"{tmp}/*.json").collect()
    assert sorted(r["type"] for r in docs) == ["Product", "WebSite"]


def test_query_log_and_id_csv(spark, tmp):
    os.makedirs(f"{tmp}/log")
    with open(f"{tmp}/log/a_LLM.json", "w") as f:
        json.dump([{"query": {"brand": "A", "olfactory category": "Dolce"}, "results": [1, 2]},
                   {"results": [3]}], f)
    with open(f"{tmp}/log/b_SPARQL.json", "w") as f:
        f.write("[{ broken")
    log = IO.read_query_log(spark, f"{tmp}/log", glob="*_LLM.json", multi_line=True)
    ok, bad = IO.valid_entries(log)
    assert [r["query"]["olfactory_category"] for r in ok.collect()] == ["Dolce"]
    assert bad.count() == 1
    with open(f"{tmp}/ids.csv", "w") as f:
        f.write("5,3\n9,x,1\n")
    r = IO.id_lists(IO.read_id_csv(spark, f"{tmp}/ids.csv")).first()
    assert r["ids"] == [1, 3, 5, 9]


def test_stream_restart_equals_batch(spark, tmp):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Product","@id":"p%d"}]}</script>'
    rows = [(f"u{i}", 200, html % i) for i in range(12)]
    spark.createDataFrame(rows, "url string, status int, html string").repartition(12).write.parquet(f"{tmp}/src")
    n_files = len([f for f in os.listdir(f"{tmp}/src") if f.endswith(".parquet")])
    assert n_files > 5  # several micro-batches of at most 5 files
    ST.ingest_pages(spark, f"{tmp}/src", f"{tmp}/sink", f"{tmp}/ckpt", max_files=5).awaitTermination()
    first = sorted(r["id"] for r in spark.read.parquet(f"{tmp}/sink").collect())
    # Restart from the checkpoint: nothing new, nothing duplicated.
    ST.ingest_pages(spark, f"{tmp}/src", f"{tmp}/sink", f"{tmp}/ckpt", max_files=5).awaitTermination()
    again = sorted(r["id"] for r in spark.read.parquet(f"{tmp}/sink").collect())
    batch, _ = X.extract_products(spark.read.parquet(f"{tmp}/src"))
    assert first == again == sorted(r["id"] for r in batch.collect())
    assert len(first) == 12


def test_recrawled_page_replaces_its_products(spark, tmp):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Product","@id":"%s"},{"@type":"Other"}]}</script>'

    def crawl(rows):
        spark.createDataFrame(rows, "url string, status int, html string").coalesce(1).write.mode("append").parquet(f"{tmp}/src")
        ST.ingest_crawl(spark, f"{tmp}/src", f"{tmp}/sink", f"{tmp}/ckpt", max_files=1).awaitTermination()
        products, rejects = ST.current(spark, f"{tmp}/sink")
        return (sorted((str(r["src"]), r["id"]) for r in products.collect()),
                sorted((r["url"], r["reason"], r["detail"]) for r in rejects.collect()))

    first = [("a", 200, html % "a1"), ("b", 200, html % "b1"), ("c", 404, None), ("d", 200, html % "d1" + html % "d2"),
             ("e", 200, html % "e1"), ("e", 200, html % "e2"), (None, 200, html % "n1"), (None, 200, html % "n2"), ("f", None, None)]
    kept = [("None", "n1"), ("None", "n2")]
    assert crawl(first) == (kept + [("a", "a1"), ("b", "b1"), ("d", "d1"), ("d", "d2"), ("e", "e2")], [("c", "status", "404"), ("f", "status", None)])
    # b is gone, c came back, d has one product and a broken block, a has no block any more
    second = [("b", 410, None), ("c", 200, html % "c1"), ("d", 200, html % "d3" + '<script type="application/ld+json">{</script>'), ("a", 200, "x")]
    want = (kept + [("c", "c1"), ("d", "d3"), ("e", "e2")], [("b", "status", "410"), ("d", "json", "1"), ("f", "status", None)])
    assert crawl(second) == want
    # Nothing new: the same table.
    ST.ingest_crawl(spark, f"{tmp}/src", f"{tmp}/sink", f"{tmp}/ckpt").awaitTermination()
    assert ST.current(spark, f"{tmp}/sink")[0].count() == len(want[0])
    # A start after the first file, and one past the end.
    ST.ingest_crawl(spark, f"{tmp}/src", f"{tmp}/sink2", f"{tmp}/ckpt2", start=1).awaitTermination()
    assert sorted(r["id"] for r in ST.current(spark, f"{tmp}/sink2")[0].collect()) == ["c1", "d3"]
    with pytest.raises(ValueError):
        ST.ingest_crawl(spark, f"{tmp}/src", f"{tmp}/sink3", f"{tmp}/ckpt3", start=3)


def test_seed_table_and_log_writers(spark, tmp):
    with open(f"{tmp}/seed.csv", "w") as f:
        f.write("permalink,other\nhttp://a,1\nhttp://b,2\n")
    assert [r["permalink"] for r in IO.read_seed(spark, f"{tmp}/seed.csv").orderBy("pos").collect()] == \
        ["http://a", "http://b"]
    df = spark.createDataFrame([("x", " "), ("", "y")], "a string, b string")
    IO.write_table(df, f"{tmp}/t.csv", fmt="csv")
    back = {tuple(r) for r in IO.read_table(spark, f"{tmp}/t.csv", fmt="csv").collect()}
    assert back == {(None, "y"), ("x", None)}
    queries = spark.createDataFrame([("q1", 2, "A", None, None, None, "<30"), ("q2", 2, "B", "C", None, None, None)],
                                    "query_id string, n_features int, brand string, category string, "
                                    "capacity string, olfactory_category string, price string")
    truth = spark.createDataFrame([("q1", 3, 1), ("q1", 1, 2)], "query_id string, id long, solutions long")
    IO.write_query_log(queries, {"results": truth}, f"{tmp}/log", lists=True)
    IO.write_query_log(queries, {"results": truth}, f"{tmp}/long")
    assert spark.read.json(f"{tmp}/long/queries").count() == 2
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp}/long/results").collect()) == [1, 3]
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(IO.LOG_SCHEMA.fields + [StructField("query_id", StringType())])
    log = IO.read_query_log(spark, f"{tmp}/log", multi_line=False, schema=schema)
    got = {r["query_id"]: r["results"] for r in log.collect()}
    assert got == {"q1": [1, 1, 3], "q2": []}


def test_write_triples(spark, tmp):
    t = spark.createDataFrame([("http://s", "http://schema.org/name", 'a "b"', "literal"),
                               ("http://s", "http://schema.org/brand", "_:b1", "bnode")],
                              "s string, p string, o string, o_kind string")
    IO.write_triples(t, f"{tmp}/nt")
    parts = sorted(os.listdir(f"{tmp}/nt"))
    assert "p=http_schema_org_name" in parts and "p=http_schema_org_brand" in parts
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp}/nt").collect())
    assert lines == ['<http://s> <http://schema.org/brand> _:b1 .', '<http://s> <http://schema.org/name> "a \\"b\\"" .']


def test_attach_facts_equals_left_join(spark):
    cat = spark.createDataFrame([(i, f"p{i}") for i in range(6)] + [(9, None)], "id long, permalink string")
    facts = spark.createDataFrame([("p1", "x")] * 50 + [("p2", "y"), ("p2", "z"), ("q", "w"), (None, "n")],
                                  "link string, brand string")
    plain = sorted(map(str, cat.join(facts, cat.permalink == facts.link, "left").collect()))
    assert sorted(map(str, E.attach_facts(cat, facts).collect())) == plain and len(plain) == 57


def test_duplicate_attributes_keep_one_node(spark, tmp):
    docs = [{"@graph": [{"@type": "Product", "@id": "p1", "category": "old"}]}]
    rows = [("p1", "50 ml", "A", "First"), ("p1", "30 ml", None, "Last"), (None, "1 ml", None, None)]
    attrs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "permalink string, capacity string, scent_group string, category string, pos int")
    out = E.enrich_nodes(_nodes(spark, docs), attrs, order=["pos"]).select(F.to_json("node")).collect()
    assert len(out) == 1 and json.loads(out[0][0])["category"] == "Last" and len(json.loads(out[0][0])["additionalProperty"]) == 1
    attrs.drop("pos").coalesce(1).write.parquet(f"{tmp}/a")  # by file position
    filed = E.with_position(spark.read.parquet(f"{tmp}/a"))
    out = E.enrich_typed(X.typed_products(_nodes(spark, docs)), filed).collect()
    assert [(r["category"], r["properties"][0]["value"]) for r in out] == [("Last", "30 ml")]
    assert E.enrich_nodes(_nodes(spark, docs), attrs.drop("pos")).count() == 1


def test_graph_of_two_folders_keeps_blank_nodes_apart(spark, tmp):
    from vetrina.operators import triples as TR
    for name, price in (("a", 1), ("b", 2.5)):
        os.makedirs(f"{tmp}/{name}")
        with open(f"{tmp}/{name}/all_products.json", "w") as f:
            json.dump({"@graph": [{"@type": ["Product", "Thing"], "@id": "http://p 1", "sku": 7, "new": True, "none": None,
                                   "offers": [{"@type": "Offer", "price": price, "seller": {"@id": "http://s"}}]}]}, f)
    nodes = IO.read_graph(spark, f"{tmp}/*/all_products.json")
    t = {tuple(r) for r in TR.to_triples(nodes).collect()}
    offers = {o for s, p, o, k, d in t if p == "http://schema.org/offers"}
    assert len(offers) == 2
    assert {(o, d.rpartition("#")[2]) for s, p, o, k, d in t if p == "http://schema.org/price"} == {("1", "integer"), ("2.5", "decimal")}
    assert {o for s, p, o, k, d in t if s == "http://p 1" and p == TR.RDF_TYPE} == {"http://schema.org/Product", "http://schema.org/Thing"}
    assert {(o, k) for s, p, o, k, d in t if p == "http://schema.org/seller"} == {("http://s", "iri")}
    assert ("http://p 1", "http://schema.org/new", "true", "literal", TR.XSD + "boolean") in t
    assert not any(p.endswith("none") for _, p, *_ in t)
    lines = {r["value"] for r in TR.to_ntriples(TR.to_triples(nodes)).collect()}
    assert '<http://p\\u00201> <http://schema.org/sku> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .' in lines


def test_equal_lines_stay_apart(spark, tmp):
    with open(f"{tmp}/g.jsonl", "w") as f:
        f.write('{"@type":"Product"}\n{"@type":"Product"}\nbroken\n')
    assert IO.read_graph(spark, f"{tmp}/g.jsonl", lines=True).select("src", "pos").distinct().count() == 2


def test_stream_rejects(spark, tmp):
    rows = [("u1", 404, None), ("u2", 200, '<script type="application/ld+json">[1]</script>'), ("u3", 200, "x")]
    spark.createDataFrame(rows, "url string, status int, html string").write.parquet(f"{tmp}/src")
    ST.ingest_rejects(spark, f"{tmp}/src", f"{tmp}/bad", f"{tmp}/ckpt").awaitTermination()
    assert sorted((r["url"], r["reason"]) for r in spark.read.parquet(f"{tmp}/bad").collect()) == [("u1", "status"), ("u2", "json")]


def test_triples_at_any_depth(spark):
    from vetrina.operators import triples as TR
    doc = {"@graph": [{"@id": "http://n", "a": {"b": [{"c": {"d": {"e": {"f": {"@id": "http://x", "g": {"h": 1}}}}}}, 2]}}, {"@id": "http://m", "a": 1}]}
    t = {tuple(r) for r in TR.to_triples(_nodes(spark, [doc])).collect()}
    by = {p.rpartition("/")[2]: (s, o, k) for s, p, o, k, _ in t if p != TR.SCHEMA + "a" and p != TR.SCHEMA + "b"}
    assert set(by) == set("cdefgh") and by["g"][0] == "http://x" and by["h"][1:] == ("1", "literal") and by["f"][1:] == ("http://x", "iri")
    for upper, lower in ("cd", "de", "ef", "gh"):  # each blank node is the next triple's subject
        assert by[upper][1] == by[lower][0]
    assert len(t) == 2 + 2 + 6
    assert TR.to_triples(_nodes(spark, [{"@graph": []}])).collect() == []


def test_lines_of_split_files(spark, tmp):
    """A file of many splits keeps its order and its line numbers."""
    os.makedirs(f"{tmp}/c")
    for name, n in (("a", 5000), ("b", 3), ("c", 0)):
        with open(f"{tmp}/c/{name}.csv", "w") as f:
            f.write("".join(f"{i % 7},{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.schema("k int, v string").csv(f"{tmp}/c")
        assert df.rdd.getNumPartitions() > 5
        last = E.latest_by_key(E.with_position(df), "k", order=["_pos"], columns=["v"]).collect()
        assert {r["k"]: r["v"] for r in last} == {0: "b0", 1: "b1", 2: "b2", **{k: f"a{max(i for i in range(5000) if i % 7 == k)}" for k in (3, 4, 5, 6)}}
        assert all(int(r["v"][1:]) == r["line"] for r in E.with_line_number(df).collect())
        assert E.with_line_number(df).count() == 5003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labels_of_two_words(spark):
    from vetrina.operators import labels as L
    docs = spark.createDataFrame([(1, "uno Speziato, leggero!"), (2, "leggero speziato"), (3, "speziato"), (4, None), (5, ""), (6, "molto speziato leggero fresco dolce")], "id int, text string")
    lex = spark.createDataFrame([("speziato leggero", "S"), ("Fresco", "F"), ("fresco dolce amaro", "A"), ("", "E"), ("!", "E")], "term string, label string")
    got = {(r["id"], r["label"]): r["score"] for r in L.tag_labels(docs, lex, ["S", "F", "A", "E"]).collect()}
    assert {k for k, v in got.items() if v} == {(1, "S"), (6, "S"), (6, "F")} and len(got) == 24


def test_logs_by_suffix(spark, tmp):
    """Files and folders, lines and arrays; a broken log is reported and the others are read."""
    entry = {"query": {"brand": "b", "olfactory category": "x"}, "results": [1, 2]}
    os.makedirs(f"{tmp}/l/3_LLM.json")
    for name, text in (("2_LLM.json", json.dumps([entry, {"results": [3]}], indent=1)), ("2_SPARQL.json", json.dumps([entry])), ("bad_LLM.json", '[{"query": {'),
                       ("3_LLM.json/part-0.json", json.dumps([entry]))):
        with open(f"{tmp}/l/{name}", "w") as f:
            f.write(text)
    good, bad = IO.valid_entries(IO.read_logs(spark, f"{tmp}/l", multi_line=True))
    assert sorted((r["file"], r["query"]["olfactory_category"], r["results"]) for r in good.collect()) == [("2_LLM.json", "x", [1, 2]), ("3_LLM.json", "x", [1, 2])]
    assert sorted(r["file"] for r in bad.collect()) == ["2_LLM.json", "bad_LLM.json"]


def test_ranked_answers(spark):
    from vetrina.operators import search as S
    docs = spark.createDataFrame([(1, "rose rose oil"), (2, "rose oil and many other words that make it long"), (3, "oil"), (4, None), (5, "rose oil"), (6, "rose oil")], "id long, text string")
    q = spark.createDataFrame([("q", "rose oil"), ("e", ""), ("o", "oil")], "query_id string, text_query string")
    answers = S.keyword_search(q, docs)
    got = [(r["query_id"], r["id"], r["rank"]) for r in S.ranked(q, docs, answers, k=3).orderBy("query_id", "rank").collect()]
    assert got == [("o", 3, 1), ("o", 5, 2), ("o", 6, 3), *got[3:]] and got[3:] == [("q", 1, 1), ("q", 5, 2), ("q", 6, 3)]
    assert S.ranked(q, docs, answers.limit(0)).collect() == []


def test_json_arrays_in_many_splits(spark, tmp):
    """Arrays on one line and indented ones, with brackets, quotes and backslashes in strings, cut anywhere."""
    import random

    rnd = random.Random(5)
    odd = ["}", "{", "]", "[", '"', "\\", "\\\\", ",", "\n", "é", "}{", "a b", '\\"']
    word = lambda: "".join(rnd.choices(odd, k=rnd.randrange(9)))
    files = {}
    for i, indent in enumerate((None, 1, None, None, None)):
        n = (150, 100, 0, 1, 3)[i]
        files[f"{i}_LLM.json"] = [{"query": {"brand": word(), "price": word()}, "results": [k, i], "sparql": word(), "more": [{word(): [{}]}]} for k in range(n)]
        os.makedirs(f"{tmp}/a", exist_ok=True)
        with open(f"{tmp}/a/{i}_LLM.json", "w") as f:
            json.dump(files[f"{i}_LLM.json"], f, indent=indent, ensure_ascii=i == 1)
    for name, text in (("cut_LLM.json", '[{"query": {"brand": "x"}}, {"query": {"brand": "y'), ("none_LLM.json", ""), ("a_TEXT.json", "[{}]")):
        with open(f"{tmp}/a/{name}", "w") as f:
            f.write(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        log = IO.read_log_arrays(spark, f"{tmp}/a", glob="*_LLM.json")
        rows = log.select("file", "_pos", "query.brand", "query.price", "results", "sparql", "_corrupt_record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    got = {(r["file"], r["_pos"]): (r["brand"], r["price"], r["results"], r["sparql"]) for r in rows if not r["_corrupt_record"]}
    want = {(f, k): (e["query"]["brand"], e["query"]["price"], e["results"], e["sparql"]) for f, es in files.items() for k, e in enumerate(es)}
    assert got == want | {("cut_LLM.json", 0): ("x", None, None, None)}
    assert [(r["file"], r["_pos"]) for r in rows if r["_corrupt_record"]] == [("cut_LLM.json", 1)]
