"""D6 against brute force (one filter per candidate, as the reference does)."""

import itertools
import random
from collections import Counter

import pytest

from vetrina.operators import mine as M

FEATURES = ["brand", "category", "capacity", "olfactory_category", "price"]


def fixture_rows(n=60, seed=7):
    rnd = random.Random(seed)
    labels = ["Agrumato", "Dolce", "Floreale", "Legnoso"]
    rows = []
    for i in range(n):
        labs = sorted(rnd.sample(labels, rnd.randint(0, 3)))
        rows.append(dict(
            id=i,
            brand=rnd.choice(["A", "B", "C", None]),
            category=rnd.choice(["Fragranze Donna", "Fragranze Uomo", "Fragranze Donna, Fragranze Uomo", None]),
            capacity=rnd.choice(["50 ml", "100 ml", "30 ml", None]),
            price=rnd.choice([None, 20, 29.99, 30, 45.5, 80, 150]),
            labels=labs))
    return rows


def brute(rows, n, cats, caps, pairs, min_values, top_k, min_support):
    bc = Counter(r["brand"] for r in rows if r["brand"] is not None)
    brands = [b for b, c in bc.items() if c >= min_values]
    cc = Counter(r["capacity"] for r in rows if r["capacity"] is not None)
    top = [v for v, _ in sorted(cc.items(), key=lambda kv: (-kv[1], kv[0]))[:top_k]]
    singles = sorted({l for r in rows for l in r["labels"]})
    domains = {"brand": brands, "category": cats, "capacity": top, "olfactory_category": singles + pairs,
               "price": [f"<{c}" for c in caps]}

    def match(r, f, v):
        if f == "brand":
            return r["brand"] == v
        if f == "category":
            return r["category"] is not None and v in r["category"]
        if f == "capacity":
            return r["capacity"] == v
        if f == "olfactory_category":
            return all(x in r["labels"] for x in v.split(" "))
        return r["price"] is not None and r["price"] < int(v[1:])

    out = set()
    for fs in itertools.combinations(FEATURES, n):
        for vs in itertools.product(*[domains[f] for f in fs]):
            hit = [r["id"] for r in rows if all(match(r, f, v) for f, v in zip(fs, vs))]
            if len(hit) >= min_support:
                qid = "&".join(f"{f}={v}" for f, v in zip(fs, vs))
                out |= {(qid, i) for i in hit}
    return out


@pytest.mark.parametrize("n", [2, 3, 4])
def test_mine_matches_brute_force(spark, n):
    rows = fixture_rows()
    rows[0]["labels"] = ["Dolce", "Dolce", "Agrumato", "Dolce"]  # counts once
    cats, caps, pairs = ["Fragranze Donna", "Fragranze Uomo"], [30, 50, 100], ["Agrumato Dolce", "Dolce Floreale"]
    df = spark.createDataFrame(
        [(r["id"], r["brand"], r["category"], r["capacity"], None if r["price"] is None else str(r["price"]),
          r["labels"]) for r in rows],
        "id long, brand string, category string, capacity string, price string, labels array<string>",
    ).selectExpr("id", "brand", "category", "capacity", "cast(price as decimal(18,4)) as price", "labels")
    queries, answers = M.mine_queries(df, n, categories=cats, caps=caps, min_support=3, min_values=5,
                                      top_capacities=2, pairs=pairs)
    got = {(r["query_id"], r["id"]) for r in answers.collect()}
    want = brute(rows, n, cats, caps, pairs, 5, 2, 3)
    assert got == want
    support = {r["query_id"]: r["support"] for r in queries.collect()}
    assert support == dict(Counter(q for q, _ in want))


def test_support_and_price_edges(spark):
    # 19 rows -> dropped, 20 -> kept; price equal to the cap is not below it.
    rows = [(i, "A" if i < 20 else "B", "Fragranze Donna", None, 30.0 if i % 2 else 10.0, []) for i in range(39)]
    df = spark.createDataFrame(rows, "id long, brand string, category string, capacity string, price double, "
                                     "labels array<string>").selectExpr(
        "id", "brand", "category", "capacity", "cast(price as decimal(18,4)) price", "labels")
    q, _ = M.mine_queries(df, 2, categories=["Fragranze Donna"], caps=[30], min_support=20, min_values=1, pairs=[])
    got = {r["query_id"]: r["support"] for r in q.collect()}
    assert got == {"brand=A&category=Fragranze Donna": 20, "category=Fragranze Donna&price=<30": 20}
