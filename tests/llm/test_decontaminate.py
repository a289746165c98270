import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SMALL, documents
from vetrina.llm import decontaminate


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def expected(docs, items, span=10):
    window = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - span + 1, 1)) if w else ():
            window.setdefault(tuple(w[s:s + span]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in window}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s:s + n])) in window:
                    hit |= set(range(s, s + n))
                    found |= window[k]
        ids = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items):
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, fp int, span string")
    got = decontaminate.decontaminate(documents(spark, docs), bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(docs, items)


PASSAGE = "One two three four five six seven eight nine ten eleven twelve"


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "... !!"), (4, PASSAGE), (4, PASSAGE), (5, "x " + PASSAGE.upper() + " y"), (6, PASSAGE.replace(" ", "-\n")),
            (7, "two three four five six seven eight nine ten"), (8, "prefix short item suffix, Short ITEM"), (9, "word"), (None, PASSAGE),
            (10, "a a a a a a a a a a a a a a"), (11, "é" * 3 + " ünï"), (12, " ".join(f"w{i}" for i in range(30_000)) + " " + PASSAGE),
            (13, "five words item sits here and five words item sits"), (14, PASSAGE[:40] + " " + PASSAGE[40:])]
    items = [(1, PASSAGE), (2, PASSAGE), (3, None), (4, "!!"), (5, "short item"), (6, "WORD"), (7, "a a a a a a a a a a a"), (8, "ééé ünï"),
             (9, "five words item sits here"), (9, "five words item sits here"), (10, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 q")]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, PASSAGE)])
    check(spark, [(1, PASSAGE)], [])


def test_small_table(spark, texts):
    import pyarrow.parquet as pq

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    assert any(r[5] for r in expected(texts, items))
    check(spark, texts, items)


@settings(deadline=None, max_examples=6)
@given(st.lists(st.lists(st.sampled_from("a b c".split()), max_size=40), min_size=1, max_size=8), st.data())
def test_random_runs(spark, texts, data):
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    items = []
    for i in range(3):
        source = data.draw(st.sampled_from(texts))
        at = data.draw(st.integers(0, max(len(source) - 1, 0)))
        items.append((i, " ".join(source[at:at + data.draw(st.integers(1, 14))])))
    check(spark, docs, items)


@pytest.mark.parametrize("extra", ["bad_id long", "hits string"])
def test_stage_drops_contaminated(spark, extra):
    docs = documents(spark, [(1, "clean"), (2, None), (None, "clean too")], extra)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leaked = bench.selectExpr("item_id + 100 as doc_id", "text").limit(3).collect()
    out = decontaminate.stage(spark, docs.unionByName(documents(spark, [tuple(r) for r in leaked], extra)), SMALL)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
