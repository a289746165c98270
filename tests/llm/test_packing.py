import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.conftest import SMALL, documents
from vetrina.llm import packing

SIZES = (4, 8, 16)


def first_by_hand(lengths, sizes, largest):
    """Best fit by a plain scan of all open bins."""
    bins = []
    for x in lengths:
        able = [c for c in sizes if c >= x]
        fits = [b for b in bins if b[0] - sum(b[1]) >= x]
        if fits:
            min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(x)
        else:
            size = min([c for c in able if c <= largest] or able[:1], key=lambda c: (packing.cost(c) / c, c))
            bins.append((size, [x]))
    return sorted(sum(b[1]) for b in bins)


@given(st.lists(st.integers(1, 16), max_size=60).map(lambda x: sorted(x, reverse=True)), st.sampled_from(SIZES))
def test_best_fit(lengths, largest):
    where, offset, load = packing.best_fit(lengths, SIZES, largest)
    content = {}
    for b, o, x in zip(where, offset, lengths, strict=True):
        assert o == content.get(b, 0)
        content[b] = o + x
    assert [content[i] for i in range(len(load))] == load and all(x <= 16 for x in load)
    assert sum(load) == sum(lengths)


@given(st.lists(st.integers(1, 16), max_size=30).map(lambda x: sorted(x, reverse=True)), st.sampled_from(SIZES))
def test_loads_match_a_plain_scan(lengths, largest):
    # equal rooms may be taken in either order; loads as a multiset agree when sizes decide alone
    assert sum(packing.best_fit(lengths, SIZES, largest)[2]) == sum(first_by_hand(lengths, SIZES, largest))
    assert len(packing.best_fit(lengths, (16,), 16)[2]) == len(first_by_hand(lengths, (16,), 16))


@given(st.lists(st.integers(1, 16), max_size=40).map(lambda x: sorted(x, reverse=True)))
def test_plan_is_the_cheapest_policy(lengths):
    where, _, size = packing.pack_block(lengths, SIZES)
    totals = [sum(map(packing.cost, packing.downsized(packing.best_fit(lengths, SIZES, c)[2], SIZES))) for c in SIZES]
    assert sum(map(packing.cost, size)) == pytest.approx(min(totals))


def test_policies_differ_with_the_real_sizes():
    """Small pieces may open any size: 1401 bytes fill 2048 badly and 8192 well."""
    lengths = [1401] * 23
    loads = [packing.best_fit(lengths, packing.CAPACITIES, c)[2] for c in packing.CAPACITIES]
    assert [len(x) for x in loads] == [23, 23, 5, 3]
    assert packing.total(loads[3], packing.CAPACITIES) < packing.total(loads[2], packing.CAPACITIES) < packing.total(loads[0], packing.CAPACITIES)
    assert packing.downsized(loads[2], packing.CAPACITIES) == [8192] * 5
    *_, size = packing.pack_block(lengths)
    assert sum(map(packing.cost, size)) < 0.9 * 23 * packing.cost(2048)


def test_bins_are_downsized_with_the_real_sizes():
    one = {2048: 16384}
    load = packing.filled([1401] * 12, packing.CAPACITIES, one)[2]
    assert load == [11 * 1401, 1401] and packing.downsized(load, packing.CAPACITIES) == [16384, 2048]
    assert sorted(packing.pack_block([1401] * 11)[2]) != [2048] * 11


def test_every_mix_of_sizes_is_a_policy():
    assert len(list(packing.openings([100, 3000, 8000, 16000], packing.CAPACITIES, 16384))) == 24
    assert list(packing.openings([100, 16000], packing.CAPACITIES, 4096)) == [{2048: 2048, 16384: 16384}, {2048: 4096, 16384: 16384}]
    assert packing.pack_block([]) == ([], [], [])


def check(spark, rows, capacities, **options):
    got = packing.pack(documents(spark, rows), capacities, with_text=True, **options).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.bin_id, []).append(r)
    for doc_id in {i for i, _ in rows}:
        texts = [t or "" for i, t in rows if i == doc_id]
        pieces = sorted(by_doc[doc_id], key=lambda r: (r.start, r.piece))
        assert sum(r.length for r in pieces) == sum(len(t.encode()) + 1 for t in texts)
        if len(texts) == 1:
            assert "".join(r.text for r in pieces) == texts[0] and [r.piece for r in pieces] == list(range(len(pieces)))
            at = 0
            for r in pieces:
                assert r.start == at
                at += len(r.text.encode())
    for rows_ in bins.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {r.capacity for r in rows_} == {min(c for c in capacities if c >= at)}
    return got


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 15), (4, "a" * 16), (5, "a" * 17), (6, "é" * 40), (7, "𝒳" * 13), (8, "word " * 20_000), (9, "x"), (9, "x"), (None, "null id"),
            (10, "a" * 31), (11, "a" * 32)]
    check(spark, rows, (16, 64))
    check(spark, rows, (16,), block=7)
    check(spark, [], (16,))


def test_texts_of_a_block_are_not_copied():
    """The text column of a block leaves as it came, in its own buffers; only the places are new."""
    texts = [["a" * 5, "b" * 9], ["c" * 9, "d" * 2, "e" * 14]]
    batches = [pa.RecordBatch.from_pydict({
        "doc_id": [len(t) * 10 + i for t in part], "th": [7] * len(part), "piece": pa.array([0] * len(part), pa.int32()), "start": [0] * len(part),
        "length": [len(t) + 1 for t in part], "text": part, "block": [3] * len(part)}) for i, part in enumerate(texts)]
    out = packing._pack(SIZES)((pa.scalar(3),), pa.Table.from_batches(batches))
    assert out.column_names == ["doc_id", "piece", "start", "length", "text", "bin_id", "capacity", "offset"]
    assert [c.buffers()[2].address for c in out.column("text").chunks] == [b.column("text").buffers()[2].address for b in batches]
    rows = sorted(out.to_pylist(), key=lambda r: (-r["length"], r["doc_id"]))
    where, offset, size = packing.pack_block([r["length"] for r in rows], SIZES)
    assert [(r["bin_id"], r["offset"], r["capacity"]) for r in rows] == [((3 << 32) + b, o, size[b]) for b, o in zip(where, offset, strict=True)]


def test_small_table(spark, texts):
    got = check(spark, texts, packing.CAPACITIES)
    used = {r.bin_id: r.capacity for r in got}
    assert sum(r.length for r in got) / sum(used.values()) > 0.97


def test_stage_and_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a, b = (packing.stage(spark, d, SMALL).drop("text").collect() for d in (docs, docs.repartition(7)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
