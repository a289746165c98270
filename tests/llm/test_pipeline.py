import corpus_pipeline
from tests.llm.conftest import SMALL
from tests.llm.test_decontaminate import expected as leaks
from tests.llm.test_simhash import fingerprint, reach
from vetrina.llm import packing, pii, quality


def test_each_stage_does_its_part(spark):
    """Every stage against its brute-force version, on what the one before kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], SMALL).cache()
        assert name == "packing" or out.columns == docs.columns
        steps.append(out)
    rows = [sorted(map(tuple, s.select("doc_id", "text").collect())) for s in steps[:-1]]
    machine = quality.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, machine).where("predicted = 1").collect()}
    assert rows[1] == [r for r in rows[0] if r[0] in good]
    prints = [fingerprint(t) for _, t in rows[1]]
    assert rows[2] == [r for r, c in zip(rows[1], reach([i for i, _ in rows[1]], prints, 3), strict=True) if r[0] == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in leaks(rows[2], items) if r[5]}
    assert rows[3] == [r for r in rows[2] if r[0] not in bad]
    assert [i for i, _ in rows[4]] == [i for i, _ in rows[3]]
    for (_, old), (_, new) in zip(rows[3], rows[4], strict=True):
        spans = pii.base_spans(old)
        assert all(old[s:e] not in new for _, s, e in spans) and (spans or pii._MARK.search(old) or old == new)
    pieces = steps[-1].orderBy("doc_id", "piece").collect()
    assert {i: "".join(r.text for r in pieces if r.doc_id == i) for i, _ in rows[4]} == dict(rows[4])
    assert all(r.capacity in packing.CAPACITIES for r in pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "piece", "start", "length", "text", "bin_id", "capacity", "offset"]


def test_stages_judge_rows_not_ids(spark, tmp):
    """Null and repeated ids: each row goes or stays by its own text."""
    from tests.llm.conftest import documents
    from vetrina.llm import decontaminate, simhash

    bad = "the quick brown fox jumps over the lazy dog again and again today"
    spark.createDataFrame([("b1", bad)], "item_id string, text string").write.parquet(f"{tmp}/benchmark.parquet")
    rows = [(None, bad), (None, "clean words"), (7, "well " + bad), (7, "clean as well"), (8, "clean")]
    kept = decontaminate.stage(spark, documents(spark, rows, "th long, bad_th long, bad_id int"), tmp)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "clean words"), (7, "clean as well"), (8, "clean")], key=str)
    assert kept.columns == [*"doc_id text lang source n_chars".split(), "th", "bad_th", "bad_id"]

    one, two, odd = "some words that are copied here many times over", "another text which stands alone in this small table", "and a third one that has no copy anywhere at all"
    rows = [(None, one), (None, one), (1, one), (1, one), (2, one), (2, two), (3, odd), (None, ""), (None, None), (9, "   "), (None, two + " x" * 40), (None, two + " x" * 40)]
    kept = simhash.stage(spark, documents(spark, rows, "th long, root long, of_th long, n int"), tmp)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, one), (2, two), (3, odd), (9, "   "), (None, two + " x" * 40)], key=str)
    assert kept.columns == [*"doc_id text lang source n_chars".split(), "th", "root", "of_th", "n"]
    assert simhash.stage(spark, documents(spark, [], "th long"), tmp).collect() == []
