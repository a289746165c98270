"""The non-broadcast plans give the same answers: every size check forced to
fail, automatic broadcasts off, so joins are sort-merge (with AQE skew
splitting)."""

import pytest

from vetrina import session
from vetrina.operators import mine as M
from vetrina.operators import retrieve as R

from .test_mine import brute, fixture_rows
from .test_retrieve_eval import Q, products


@pytest.fixture()
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", -1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_mining_without_broadcast(spark, no_broadcast):
    rows = fixture_rows(seed=11)
    cats, caps, pairs = ["Fragranze Donna", "Fragranze Uomo"], [30, 50, 100], ["Agrumato Dolce"]
    df = spark.createDataFrame(
        [(r["id"], r["brand"], r["category"], r["capacity"], None if r["price"] is None else str(r["price"]),
          r["labels"]) for r in rows],
        "id long, brand string, category string, capacity string, price string, labels array<string>",
    ).selectExpr("id", "brand", "category", "capacity", "cast(price as decimal(18,4)) as price", "labels")
    _, answers = M.mine_queries(df, 2, categories=cats, caps=caps, min_support=3, min_values=5,
                                top_capacities=2, pairs=pairs)
    assert {(r["query_id"], r["id"]) for r in answers.collect()} == brute(rows, 2, cats, caps, pairs, 5, 2, 3)


def test_matching_without_broadcast(spark, no_broadcast):
    q = spark.createDataFrame([("p", None, None, None, None, "<30"), ("bp", "A", None, None, None, "< 30"),
                               ("l", None, None, None, "Fruttato", None)], Q)
    got = sorted((r["query_id"], r["id"], r["solutions"]) for r in R.match_queries(q, products(spark)).collect())
    assert got == [("bp", "u1", 2), ("l", "u1", 1), ("p", "u1", 2)]


def test_only_a_local_master_gets_a_scratch_folder(spark, monkeypatch):
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    class Session:
        sparkContext = None

        def __init__(self, master):
            self.conf = Conf(master)

    assert session.checkpoint_dir(Session("local[4]"))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(Session(master))


def test_intermediates_are_removed(spark):
    session.drop_intermediates(spark)
    q = spark.createDataFrame([("b", "A", None, None, None, None)], Q)
    assert R.match_queries(q, products(spark)).count() == 1
    assert session.drop_intermediates(spark) > 3
    assert session.drop_intermediates(spark) == 0


def test_cluster_conf_is_bounded():
    assert int(session.cluster_conf(100 << 40)["spark.sql.shuffle.partitions"]) == session.MAX_SHUFFLE_PARTITIONS
