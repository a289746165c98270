import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SMALL, documents
from vetrina.llm import simhash
from vetrina.llm.components import components


def fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, prints, bits):
    """Smallest id of each row's component, by brute force."""
    least = list(range(len(ids)))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    rank = {i: k for k, i in enumerate(order)}
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= bits and rank[least[j]] < rank[least[i]]:
                    least[i], changed = least[j], True
    return [ids[i] for i in least]


def check(spark, rows, bits=3):
    got = simhash.near_duplicates(documents(spark, rows), bits=bits).collect()
    prints = [fingerprint(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, reach([i for i, _ in rows], prints, bits), strict=True)]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    check(spark, [(7, None), (3, ""), (5, " \t\n"), (9, "One"), (2, "one"), (1, "two words"), (4, "a b c d"), (4, "a b c d"), (None, "A b c D"),
                  (None, "lonely text here"), (8, long), (6, long + " end"), (10, "É a\x0bb"), (11, "é a b"), (12, "x y x y x y")])


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_are_written_before_they_are_joined(spark, monkeypatch, texts):
    """No stage has two Python steps, each with a worker of its own."""
    given_ = []
    monkeypatch.setattr(simhash, "components", lambda edges: given_.append(edges) or components(edges))
    check(spark, texts[:50])
    plan = given_[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and not re.search("Pandas|Python|Arrow", plan)


def test_small_table(spark, texts):
    check(spark, texts)


def test_chains_across_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 4)
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist()
    for i in range(300):  # chains of near fingerprints, differing in any bits
        prints.append(prints[int(rng.integers(len(prints)))] ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    root = {r.node: r.root for r in simhash.link_fingerprints(df, 3).collect()}
    ids = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = reach(ids, prints, 3)
    assert [root.get(i, i) for i in ids] == want


@pytest.mark.parametrize("split", [50, 7])
def test_large_groups_are_dealt_in_blocks(spark, split):
    """A family of like fingerprints and some others, in a single group that many pairs of blocks share."""
    rng = np.random.default_rng(11)
    family = int(rng.integers(1 << 62))
    prints = {family ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(250)}
    prints = sorted(prints | {0} | set(rng.integers(0, 1 << 63, 30, dtype=np.uint64).tolist()))
    ids = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in ids], "fp long")
    dealt = df.mapInPandas(simhash._groups(0, 1), "grp long, fp long, visitor boolean")
    tasks = simhash._tasks(dealt, split).groupBy("grp", "i", "j").count().collect()
    assert len(tasks) > 2 and all(t["i"] < t["j"] for t in tasks) and max(t["count"] for t in tasks) < 4 * split
    root = {r.node: r.root for r in simhash.link_fingerprints(df, 3, split).collect()}
    assert [root.get(i, i) for i in ids] == reach(ids, prints, 3)


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=40), st.integers(0, 6), st.randoms())
def test_index_finds_exactly_the_close_pairs(codes, bits, rnd):
    codes += [c ^ sum(1 << rnd.randrange(64) for _ in range(2)) & ((1 << 64) - 1) for c in codes]
    a = simhash.Index(np.array(codes, dtype=np.uint64))
    got = set()
    for i, j in a.close(a, bits, 64):
        got |= {frozenset((int(a.codes[x]), int(a.codes[y]))) for x, y in zip(i, j, strict=True)}
    want = {frozenset((x, y)) for x in set(codes) for y in set(codes) if (x ^ y).bit_count() <= bits}
    assert got == want


def test_gray_rank():
    codes = np.arange(256, dtype=np.uint64)
    by_rank = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(int(x ^ y).bit_count() == 1 for x, y in zip(by_rank, by_rank[1:], strict=False))


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1500)] + [(5, 5), (2000, 2001), (2001, 2000), (-9, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1500)} | dict.fromkeys([-9, 2000, 2001], -9)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("extra", ["fp long", "gone_id int"])
def test_stage_keeps_the_smallest(spark, extra):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "something else entirely here"), (None, "a b c d e f"), (5, None), (4, "")]
    docs = documents(spark, rows, extra)
    out = simhash.stage(spark, docs, SMALL)
    assert out.columns == docs.columns
    # a row without doc_id is a copy like any other: one document of each group stays
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 2), (False, 4)]
