import itertools
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SMALL, documents
from vetrina.llm import quality


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string") if rows else spark.createDataFrame(
        [], "doc_id long, quality int, toxic int, text string")


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(np.zeros((quality.N_STATS, quality.BINS - 1)))
    m.w, m.v, m.bias[0] = rng.normal(size=m.size), rng.normal(size=m.v.shape), 0.3
    first, feature, x = np.array([0, 4]), np.array([3, 9, 11, 40, 2, 8]), rng.normal(size=6)
    got, _ = m.margin(first, feature, x)
    for k, at in enumerate((range(4), range(4, 6))):
        want = 0.3 + sum(m.w[feature[i]] * x[i] for i in at)
        want += sum(m.v[feature[i]] @ m.v[feature[j]] * x[i] * x[j] for i, j in itertools.combinations(at, 2))
        assert got[k] == pytest.approx(want)


def test_word_features_count_whole_words():
    from vetrina.llm.text import SPACED, Words

    data = b"a B\ta  c" + b"" + b"b"
    w = Words(np.frombuffer(data, np.uint8), np.array([0, 8, 8, 9]), SPACED)
    n, bucket, value = quality.word_features(w)
    assert n.tolist() == [3, 0, 1]
    assert sorted(value[:3].tolist()) == pytest.approx([1 / 6 ** 0.5, 1 / 6 ** 0.5, 2 / 6 ** 0.5])
    assert bucket[3] in bucket[:3]  # b and B are one word


def test_edges(spark):
    rows = [(i, ("good words in a row, " * 5).strip() if i % 3 else "JUNK!! JUNK!! " * 8) for i in range(60)]
    marks = [(i, int(i % 3 > 0), 0, "x") for i in range(60)] + [(3, None, 0, None), (None, 1, 1, None), (4, 7, 0, None), (5, 1, 0, None)]
    more = [(100, None), (101, ""), (102, "w " * 60_000), (None, "JUNK!! JUNK!! JUNK!!"), (103, "é|é ñ\n\n"), (1, "good words"), (1, "good words")]
    docs = documents(spark, rows + more)
    machine = quality.learn(docs, labels(spark, marks), steps=60)
    got = quality.score(docs, machine).collect()
    assert len(got) == len(rows + more)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 1}
    assert all(by[i].predicted == int(i % 3 > 0) for i in by)


def test_empty_tables(spark):
    docs = documents(spark, [(1, "text"), (2, None)])
    machine = quality.learn(docs, labels(spark, []))
    assert [r.score for r in quality.score(docs, machine).collect()] == [0.5, 0.5]
    assert quality.score(documents(spark, []), machine).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    marks = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = marks.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality.learn(docs, marks, steps=5), quality.learn(docs, flipped, steps=5)
    assert (a.w == b.w).all() and (a.v == b.v).all()


def test_held_out_accuracy(spark):
    docs, marks = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, quality.learn(docs, marks)).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95


def test_stage_drops_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.stage(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    want = {r.doc_id for r in quality.score(docs, quality.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))).where("predicted = 1").collect()}
    assert kept == want
