import math

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import SMALL
from vetrina.llm import embeddings
from vetrina.llm.embeddings import ORACLE


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, cls int, good string, near double")


def expected(rows, cosine=0.93):
    def good(e, label):
        return label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    vec = [np.array(e, np.float32).astype(float) if good(e, label) else None for _, e, label in rows]
    n = len(rows)
    link = [[i != j and vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j])
             and vec[i] @ vec[j] / math.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= cosine for j in range(n)] for i in range(n)]
    least = [r[0] for r in rows]
    for _ in range(n):
        least = [min([x for j, x in enumerate(least) if (link[i][j] or i == j) and x is not None], default=None) for i in range(n)]
    return sorted(((r[0], sum(link[i]), c, r[0] == c) for i, (r, c) in enumerate(zip(rows, least, strict=True))), key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in embeddings.near_duplicates(table(spark, rows), **options).collect()), key=str)


def cluster(rng, n, dim=8, labels=3):
    base = rng.normal(size=(max(n // 8, 1), dim))
    return [(i, (base[rng.integers(len(base))] * rng.uniform(0.5, 4) + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3])).tolist(), int(rng.integers(labels)))
            for i in range(n)]


def test_edges(spark):
    one = [1.0, 0.0, 0.0]
    run_ = [(5, one, 1), (3, one, 1), (9, [2.0, 0.0, 0.0], 1), (4, one, 2), (6, one, None), (7, None, 1), (8, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 0.0], 1),
            (11, [float("nan"), 1.0, 0.0], 1), (12, [float("inf"), 0.0, 0.0], 1), (13, [], 1), (14, [1.0, 0.0], 1), (3, one, 1), (15, [-0.0, 1.0, 0.0], 1),
            (16, [0.0, 1.0, 0.0], 1), (17, [3e38, 3e38, 0.0], 1), (18, [1e-38, 1e-38, 0.0], 1)]
    assert run(spark, run_) == expected(run_)
    assert run(spark, []) == []


def test_null_ids(spark):
    assert run(spark, [(None, [1.0, 0.0], 1), (4, [1.0, 0.1], 1), (None, [0.0, 0.0], 1)]) == sorted(
        [(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("cell, block", [(2048, 2048), (20, 7), (5, 3), (40, 1000)])
def test_cells_and_blocks_lose_nothing(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = cluster(np.random.default_rng(cell), 220)
    want = expected(rows)
    assert sum(x[1] for x in want) > 200
    assert run(spark, rows) == want


def test_few_pivots(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 4)
    monkeypatch.setattr(embeddings, "MAX_PIVOTS", 6)
    rows = cluster(np.random.default_rng(5), 150, labels=1)
    assert run(spark, rows, cosine=0.8) == expected(rows, 0.8)


def test_cells_that_hold_their_pivot_alone(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 1)
    rows = [(i, [float(i % 7 == k) + 0.01 * (i > 6 and k == (i + 1) % 7) for k in range(7)], 1) for i in range(14)]
    want = expected(rows)
    assert sum(x[1] for x in want) == 14
    assert run(spark, rows) == want


def test_large_group_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(50, 2050)] + [(1, [1.0, 2.0, 3.1], 1)]
    got = embeddings.near_duplicates(table(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2000, 1)} and sum(r.kept for r in got) == 1


def test_oracle_on_copies(spark, tmp):
    rows = cluster(np.random.default_rng(9), 120)
    table(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(tmp + "/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE).fetchall(), key=str) == run(spark, rows)


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert sorted(con.execute(ORACLE).fetchall(), key=str) == sorted((tuple(r) for r in embeddings.query(spark, SMALL).collect()), key=str)
    assert len(rows) > 0


def test_one_id_at_different_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 1), (4, [0.02, 1.0], 1), (5, [0.0, 1.0], 1), (5, [1.0, 1.0], 1),
            (None, [0.0, 1.0], 2), (None, [0.01, 1.0], 2), (7, [-1.0, 0.0], 0), (7, [-1.0, 0.0], 0), (6, [-1.0, 0.01], 0)]
    got = run(spark, rows)
    assert got == expected(rows)
    assert {r[1] for r in got if r[0] == 1} == {1, 3}
