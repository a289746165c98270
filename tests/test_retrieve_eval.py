"""E8-E13 and F1-F8 edge rows."""

import random

from pyspark.sql import functions as F

from vetrina.operators import evaluate as EV
from vetrina.operators import retrieve as R

PROD = ("src string, block int, pos int, uri string, name string, category string, brand_type string, "
        "brand string, offers array<struct<price:string,priceCurrency:string>>, "
        "properties array<struct<`@type`:string,name:string,value:string>>")
Q = "query_id string, brand string, category string, capacity string, olfactory_category string, price string"


def products(spark):
    rows = [
        ("s", 0, 0, "u1/#richSnippet", "One", "Fragranze Donna", "Brand", "A",
         [("12.5", "EUR"), ("20", "EUR")], [("PropertyValue", "Capacita", "50 ml"),
                                            ("PropertyValue", "Gruppo Olfattivo", "Floreale Fruttato")]),
        ("s", 0, 1, "u2", "Two", "Fragranze Uomo", "Brand", "B",
         [("12,5", "EUR"), ("1e1", "EUR"), ("5", None)], []),
        ("s", 0, 2, "u3", None, "Fragranze Donna", "Brand", "A", [], []),  # no name: never answered
    ]
    return spark.createDataFrame(rows, PROD)


def answers(spark, queries, bag=True):
    q = spark.createDataFrame(queries, Q)
    return sorted((r["query_id"], r["id"], r["solutions"])
                  for r in R.match_queries(q, products(spark), bag=bag).collect())


def test_match_features(spark):
    got = answers(spark, [
        ("b", "A", None, None, None, None),
        ("c", None, "Donna", None, None, None),
        ("k", None, None, "50 ml", None, None),
        ("l", None, None, None, "Fruttato", None),
        ("p", None, None, None, None, "<30"),
        ("bp", "A", None, None, None, "< 30"),
        ("none", "C", None, None, None, None),
    ])
    assert got == [("b", "u1", 1), ("bp", "u1", 2), ("c", "u1", 1), ("k", "u1", 1), ("l", "u1", 1),
                   ("p", "u1", 2)]


def test_no_features_every_named_product(spark):
    got = answers(spark, [("all", "", None, None, "", None)])
    assert got == [("all", "u1", 1), ("all", "u2", 1)]


def test_bag_and_set(spark):
    assert answers(spark, [("p", None, None, None, None, "<30")], bag=False) == [("p", "u1", 1)]


def test_prices_by_cap(spark):
    """Caps, prices on and beside them, many offers of one product; alone and with other features."""
    rnd = random.Random(3)
    prices = ["0", "7.99", "8", "8.000001", "29.99999", "30", "1000.25", "99999999999999.5", "-5"]
    rows = [("s", 0, i, f"u{i % 7}", "N", "c", "Brand", "AB"[i % 2], [(rnd.choice(prices), "EUR")], []) for i in range(60)]
    prods = spark.createDataFrame(rows, PROD)
    caps = ["8", "30", "30.0", "1000", "100000000000000", "-6", "x"]
    asked = [(f"{b}|{c}", b, None, None, None, f"< {c}") for b in (None, "A") for c in caps] + [("A|", "A", None, None, None, None)]
    want = {}
    for q, b, *_, cap in asked:
        for u in {r[3] for r in rows}:
            mine = [r for r in rows if r[3] == u]
            brands = sum(r[7] == b for r in mine) if b else 1
            try:
                n = sum(float(r[8][0][0]) < float(cap[2:]) for r in mine) if cap else 1
            except ValueError:
                n = 0
            if brands * n:
                want[q, u] = brands * n
    got = R.match_queries(spark.createDataFrame(asked, Q), prods)
    assert {(r["query_id"], r["id"]): r["solutions"] for r in got.collect()} == want and len(want) > 20


def test_many_caps(spark, monkeypatch):
    """More caps than a block holds, alone and with a brand; the plan holds none of them."""
    monkeypatch.setattr(R, "BLOCK", 16)
    rnd = random.Random(5)
    rows = [("s", 0, i, f"u{i % 20}", "N", "c", "Brand", "AB"[i % 2], [(str(rnd.randint(0, 3000)), "EUR")], []) for i in range(40)]
    asked = [(f"p{c}", None, None, None, None, f"< {c}") for c in range(0, 3000, 7)]
    asked += [(f"b{c}", "A", None, None, None, f"< {c}.5") for c in range(0, 3000, 11)]
    want = {}
    for q, b, *_, cap in asked:
        for u in {r[3] for r in rows}:
            mine = [r for r in rows if r[3] == u]
            n = sum(float(r[8][0][0]) < float(cap[2:]) for r in mine) * (sum(r[7] == b for r in mine) if b else 1)
            if n:
                want[q, u] = n
    prods = R.graph_index(spark.createDataFrame(rows, PROD))
    got = R.match_queries(spark.createDataFrame(asked, Q), prods)
    assert {(r["query_id"], r["id"]): r["solutions"] for r in got.collect()} == want
    size = [len(R.match_queries(spark.createDataFrame(asked[:n], Q), prods)._jdf.queryExecution().optimizedPlan().toString())
            for n in (200, len(asked))]
    assert size[1] < 1.2 * size[0]


def test_contains_by_grams(spark):
    """Query values of any length, with repeated grams, characters of several bytes, or longer than any value."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("aàb€ ") for _ in range(n))
    facts = [(f, word(rnd.randint(0, 12))) for f in ("category", "olfactory_category") for _ in range(60)]
    asked = sorted({(f, w) for f in ("category", "olfactory_category") for w in
                    [word(rnd.randint(1, 6)) for _ in range(80)] + ["aaaaaaaaaaaaaaaaaaaa", "zzz", "z"]}) + [("brand", "a")]
    values = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "vid long, feature string, value string")
    got = R._resolve(values, spark.createDataFrame(facts, "feature string, value string"), 1 << 20).collect()
    want = {(f, v, i) for i, (f, w) in enumerate(asked) for g, v in facts if f == g and w in v} | {("brand", "a", len(asked) - 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300


def test_queries_without_features_by_parts(spark, monkeypatch):
    """Too many such queries to broadcast: the products are taken in parts."""
    monkeypatch.setattr(R, "BROADCAST_MAX_BYTES", 0)
    assert answers(spark, [("all", "", None, None, "", None), ("any", None, None, None, None, None)]) == [
        (q, u, 1) for q in ("all", "any") for u in ("u1", "u2")]


def test_matching_against_brute_force(spark):
    rnd = random.Random(8)
    pick = lambda *x: rnd.choice(x)
    rows = []
    for i in range(80):
        props = [("PropertyValue", "Capacita", pick("30 ml", "50 ml")) for _ in range(rnd.randint(0, 2))]
        props += [("PropertyValue", "Gruppo Olfattivo", pick("Dolce", "Floreale Dolce", "Legnoso", "olce")) for _ in range(rnd.randint(0, 2))]
        rows.append(("s", 0, i, f"u{rnd.randint(0, 30)}", pick("N", "M", None), pick("Donna", "Uomo Donna", None), "Brand", pick("A", "B"),
                     [(pick("5", "15", "25"), "EUR") for _ in range(rnd.randint(0, 2))], props))
    asked = [(f"q{i}", pick("A", "B", "C", None), pick("Donna", "omo", None, ""), pick("30 ml", None, None), pick("Dolce", "ol", None, None),
              pick("<10", "< 20", "<30", None)) for i in range(60)]
    want = {}
    for q, b, c, k, o, p in asked:
        for u in {r[3] for r in rows}:
            mine = [r for r in rows if r[3] == u]
            n = len({r[4] for r in mine if r[4]})
            n *= sum(r[7] == b for r in mine) if b else 1
            n *= len({r[5] for r in mine if r[5] and c in r[5]}) if c else 1
            n *= sum(v[1] == "Capacita" and v[2] == k for r in mine for v in r[9]) if k else 1
            n *= sum(v[1] == "Gruppo Olfattivo" and o in v[2] for r in mine for v in r[9]) if o else 1
            n *= sum(float(v[0]) < float(p.strip("< ")) for r in mine for v in r[8]) if p else 1
            if n:
                want[q, u] = n
    got = R.match_queries(spark.createDataFrame(asked, Q), spark.createDataFrame(rows, PROD))
    assert {(r["query_id"], r["id"]): r["solutions"] for r in got.collect()} == want and len(want) > 100


def test_answer_lists_in_parts(spark, monkeypatch):
    """A long list is cut, also within the copies of one id; short ones are one part, empty ones too."""
    monkeypatch.setattr(R, "LIST_IDS", 10)
    monkeypatch.setattr(R, "COPIES", 4)
    rnd = random.Random(9)
    rows = [("long", i, rnd.choice((1, 1, 2))) for i in range(-20, 60)] + [("copies", 3, 50), ("copies", 4, 1)]
    rows += [(f"s{q}", i, 1 + i % 2) for q in range(20) for i in range(q % 7)] + [("void", None, 2)]
    rnd.shuffle(rows)
    want = {q: sorted(i for r, i, n in rows if r == q and i is not None for _ in range(n)) for q in {r[0] for r in rows} | {"none", "s0", "s7", "s14"}}
    queries = spark.createDataFrame([(q,) for q in want], "query_id string")
    got = R.answers_to_lists(spark.createDataFrame(rows, "query_id string, id long, solutions long"), queries, "ids").collect()
    parts = {}
    for r in sorted(got, key=lambda r: r["part"]):
        parts.setdefault(r["query_id"], []).append(r["ids"])
    assert {q: sum(p, []) for q, p in parts.items()} == want
    assert max(len(p) for ps in parts.values() for p in ps) <= 2 * 10 and len(parts["long"]) > 5 and len(parts["copies"]) > 2
    assert all(len(ps) == 1 for q, ps in parts.items() if len(want[q]) <= 10) and want["none"] == want["void"] == []


def test_metrics_edges(spark):
    queries = spark.createDataFrame([("q1", None), ("q2", "<30"), ("q3", None), ("q4", None)],
                                    "query_id string, price string")
    truth = spark.createDataFrame([("q1", 1), ("q1", 2), ("q2", 1), ("q3", 5), ("q4", 9)], "query_id string, id long")
    ans = spark.createDataFrame(
        [("q1", "s", 1), ("q1", "s", 1), ("q1", "s", 2), ("q2", "s", 7), ("q4", "s", 9)],
        "query_id string, system string, id long")
    scores = EV.per_query(queries, truth, ans, ["s"])
    per = {r["query_id"]: (r["precision"], r["recall"], r["f1"]) for r in scores.collect()}
    assert per == {"q1": (1.0, 1.0, 1.0), "q2": (0.0, 0.0, 0.0), "q3": (0.0, 0.0, 0.0), "q4": (1.0, 1.0, 1.0)}
    scored = scores.join(queries, "query_id")
    sl = {r["slice"]: (r["query_count"], round(r["f1"], 6))
          for r in EV.slices(scored, F.col("price").isNotNull()).collect()}
    assert sl == {"all": (4, 0.5), "with": (1, 0.0), "without": (3, round(2 / 3, 6))}


def test_empty_truth_counted_not_averaged(spark):
    queries = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    truth = spark.createDataFrame([("q1", 1)], "query_id string, id long")
    ans = spark.createDataFrame([("q1", "s", 1), ("q2", "s", 3)], "query_id string, system string, id long")
    m = EV.macro(EV.per_query(queries, truth, ans, ["s"])).first()
    assert m["query_count"] == 2 and m["precision"] == 1.0


def test_duplicate_page_doubles_bag_not_sets(spark):
    p = products(spark)
    twice = p.unionByName(p.where(F.col("uri") == "u1/#richSnippet").withColumn("block", F.lit(1)))
    q = spark.createDataFrame([("bp", "A", None, None, None, "<30"), ("c", None, "Donna", None, None, None)], Q)
    once = {(r["query_id"], r["id"]): r["solutions"] for r in R.match_queries(q, p).collect()}
    dup = {(r["query_id"], r["id"]): r["solutions"] for r in R.match_queries(q, twice).collect()}
    assert once.keys() == dup.keys()
    # brand and offers are blank nodes (x2 each), the category literal collapses.
    assert dup[("bp", "u1")] == 4 * once[("bp", "u1")] and dup[("c", "u1")] == once[("c", "u1")]


def test_slices_sum_to_all(spark):
    queries = spark.createDataFrame([(f"q{i}", "<30" if i % 3 else None) for i in range(9)],
                                    "query_id string, price string")
    truth = spark.createDataFrame([(f"q{i}", i) for i in range(9)], "query_id string, id long")
    ans = spark.createDataFrame([(f"q{i}", "s", i if i % 2 else 99) for i in range(9)],
                                "query_id string, system string, id long")
    scored = EV.per_query(queries, truth, ans, ["s"]).join(queries, "query_id")
    n = {r["slice"]: r["query_count"] for r in EV.slices(scored, F.col("price").isNotNull()).collect()}
    assert n["with"] + n["without"] == n["all"] == 9
    rep = EV.report(EV.macro(scored)).first()
    assert rep["precision"] == round(4 / 9, 3)


def test_resolve_replies_quarantine_and_fallback(spark):
    from vetrina.operators import slots as SL
    vocab = spark.createDataFrame([("brand#1", "brand", "Brand#1"), ("small", "category", "SMALL"),
                                   ("blue", "olfactory_category", "blue")], "phrase string, slot string, value string")
    texts = spark.createDataFrame([("a", "small blue brand#1 minori di 30 euro"), ("b", "blue 50 ml")],
                                  "query_id string, text_query string")
    replies = spark.createDataFrame([
        ("a", '[["brand", "x"], ["category", "y"], ["capacity", ""], ["olfactory category", "z"], ["price", "<30"]]'),
        ("b", "[['brand', 'd&g'], ['category', ''], ['capacity', '50 ml'], ['olfactory category', ' blue '], "
              "['price', '']]")], "query_id string, reply string")
    slots, bad = SL.resolve_replies(replies, texts, vocab)
    got = {r["query_id"]: tuple(r[c] for c in SL.SLOTS) for r in slots.collect()}
    assert got == {"a": ("Brand#1", "SMALL", "", "blue", "< 30"), "b": ("D&g", "", "50 ml", "Blue", "")}
    assert [r["query_id"] for r in bad.collect()] == ["a"]


def test_slices_feature_absent_f8(spark):
    queries = spark.createDataFrame([("q1", None), ("q2", None)], "query_id string, price string")
    truth = spark.createDataFrame([("q1", 1), ("q2", 2)], "query_id string, id long")
    ans = spark.createDataFrame([("q1", "s", 1)], "query_id string, system string, id long")
    scored = EV.per_query(queries, truth, ans, ["s"]).join(queries, "query_id")
    sl = {r["slice"]: (r["query_count"], r["f1"]) for r in EV.slices(scored, F.col("price").isNotNull()).collect()}
    assert sl == {"all": (2, 0.5), "without": (2, 0.5), "with": (0, 0.0)}
