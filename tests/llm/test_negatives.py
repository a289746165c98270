import math

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import SMALL
from vetrina.llm import negatives
from vetrina.llm.negatives import ORACLE

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows):
    v = []
    for vec_id, e, label in rows:
        if vec_id is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for a, la, qa in v:
        if a % 100:
            continue
        s = [(-sum(x * y for x, y in zip(qa, qb, strict=True)), b, lb) for b, lb, qb in v if len(qb) == len(qa)]
        for ps, p, _ in sorted((x, b, lb) for x, b, lb in s if lb == la and b != a)[:5]:
            far = sorted((x, b) for x, b, lb in s if lb != la and 80 * -ps <= 100 * -x <= 100 * -ps)[:5]
            out += [(a, p, i + 1, b, -ps, -x) for i, (x, b) in enumerate(far)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, q string, norm double, row int, need int")


def run(spark, rows, tmp):
    folder = f"{tmp}/t"
    table(spark, rows).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.query(spark, folder).collect())


def cloud(rng, n, dim=6, ids=20, labels=3):
    """Many anchors: ids are multiples of 20, so a fifth of them of 100."""
    base = rng.normal(size=(8, dim))
    return [(i * ids, (base[rng.integers(8)] * rng.choice([0.2, 1, 1, 3]) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.4])).tolist(), int(rng.integers(labels)))
            for i in range(n)]


def test_edges(spark, tmp):
    a, b = [1.0, 0.5, 0.0], [0.9, 0.5, 0.0]
    rows = [(0, a, 1), (1, b, 1), (2, b, 1), (3, b, 2), (4, [0.95, 0.5, 0.0], 3), (5, None, 1), (6, [], 1), (8, [1.0, None, 0.0], 1), (9, [float("nan")] * 3, 1),
            (10, [float("inf"), 0.0, 0.0], 2), (11, a, None), (None, a, 1), (100, [0.0, 0.0, 0.0], 1), (200, [-1.0, 0.0, 0.0], 4), (201, a, 4), (300, [1.0, 2.0], 5),
            (301, [1.0, 2.1], 5), (302, [1.0, 1.9], 6), (400, a, 7), (400, a, 7), (402, b, 7), (14, a, 9), (700, b, 8), (13, a, 9), (12, [0.8, 0.5, 0.0], 2)]
    want = expected(rows)
    assert len(want) > 15 and run(spark, rows, tmp) == want
    assert run(spark, [], tmp) == [] and run(spark, [(1, a, 1)], tmp) == [] and run(spark, [(0, a, 1)], tmp) == []


@pytest.mark.parametrize("members, first, block, step", [(64, 1 << 14, 4096, 512), (6, 20, 16, 4), (2, 1, 1000, 1)])
def test_rounds_and_blocks_lose_nothing(spark, tmp, monkeypatch, members, first, block, step):
    for name, value in (("MEMBERS", members), ("FIRST", first), ("BLOCK", block), ("STEP", step), ("GROWTH", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = cloud(np.random.default_rng(members), 240)
    want = expected(rows)
    assert len(want) > 300
    assert run(spark, rows, tmp) == want


def test_many_copies_and_ties(spark, tmp, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST", 50)
    rows = cloud(np.random.default_rng(4), 60) + [(i, [1.0, 2.0, 0.5, 0.0, 0.25, 1.0], i % 3) for i in range(2001, 2300)] + [(2300, [1.0, 2.0, 0.5, 0.0, 0.25, 1.0], 1)]
    want = expected(rows)
    assert run(spark, rows, tmp) == want and sum(x[0] == 2300 for x in want) == 25


def test_large_values_stay_exact(spark, tmp):
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [3e5, 1.5], 2), (3, [2.5e5, 7.0], 3), (4, [3e30, 1.0], 1)]
    assert run(spark, rows, tmp) == expected(rows[:-1])


def test_bounds_hold(spark):
    """No score is over its cluster's bound, and clusters are narrow where anchors are."""
    rng = np.random.default_rng(2)
    near = [(i * 100, [50.0, *rng.normal(size=3).tolist()], i % 2) for i in range(30)]
    far = [(i * 100 + 1, [-50.0, *rng.normal(size=3).tolist()], i % 2) for i in range(400)]
    rows = negatives.prepared(table(spark, near + far))
    all_, anchors = negatives.cluster_anchors(rows.where("vec_id % 100 = 0"), rows)
    x = all_[4]
    assert (x.width < 0.2).all()
    for row in rows.collect():
        ub = x.bounds(np.array([row.q]), np.array([row.norm]))[0]
        for a in anchors.collect():
            assert np.dot(row.q, a.q) <= a.norm * ub[a.cluster - x.first] * (1 + 1e-9) + 1e-6


def test_against_sql(spark):
    for d in (SMALL, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
        want = sorted(con.execute(ORACLE).fetchall())
        assert want == sorted(tuple(r[c] for c in COLUMNS) for r in negatives.query(spark, d).collect()) and want
