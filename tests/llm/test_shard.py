import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import documents
from vetrina.llm import shard


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 3000), st.integers(0, 1 << 60))
def test_permutation_and_its_inverse(n, seed):
    x = np.arange(n)
    p = shard.permute(x, n, seed)
    assert sorted(p.tolist()) == x.tolist()
    assert (shard.permute(p, n, seed, back=True) == x).all()


def test_large_domains_stay_inside():
    n = (1 << 40) + 12345
    x = np.arange(0, n, n // 1000)
    p = shard.permute(x, n, 1)
    assert (p >= 0).all() and (p < n).all() and (shard.permute(p, n, 1, back=True) == x).all()


def test_shuffle_looks_even():
    p = shard.permute(np.arange(24_000), 24_000, 5)
    assert abs(np.corrcoef(np.arange(24_000), p)[0, 1]) < 0.03


def check(rows, got, shards):
    assert len(got) == len(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()))
    order = sorted(rows, key=key)
    for r in got:
        i, text = order[r.row_number]
        assert (r.doc_id, r.size, r.text_crc32) == (i, len((text or "").encode()) + 8, zlib.crc32((text or "").encode()))
        assert (r.shard, r.slot) == shard.place_of(r.row_number, len(rows), shards)
        assert shard.row_at(r.shard, r.slot, len(rows), shards) == r.row_number
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    slots = [sorted(r.slot for r in got if r.shard == s) for s in range(shards)]
    assert all(s == list(range(len(s))) for s in slots)
    assert max(map(len, slots)) - min(map(len, slots)) <= 1


ROWS = [(i, f"text {i}") for i in range(100)] + [(5, "other"), (7, "text 7"), (7, "text 7"), (None, "null id"), (None, None), (200, None), (201, ""), (202, "é" * 99_999)]


@pytest.mark.parametrize("shards", [1, 3, 24, 200])
def test_edges(spark, shards):
    check(ROWS, shard.shard(documents(spark, ROWS), shards).collect(), shards)


def test_layout_changes_nothing(spark):
    docs = documents(spark, ROWS)
    a, b = (sorted(map(str, shard.shard(d).collect())) for d in (docs.coalesce(1), docs.repartition(13)))
    assert a == b


def test_empty_and_single(spark):
    assert shard.shard(documents(spark, [])).count() == 0
    check([(1, "x")], shard.shard(documents(spark, [(1, "x")])).collect(), 24)


def test_small_table(spark, texts):
    check(texts, shard.shard(documents(spark, texts)).collect(), 24)
