"""How the work of the queries is dealt out: tasks, filters and rows between them."""

import pytest
from pyspark.sql import functions as F

from vetrina.functions import text as T
from vetrina.operators import extract as X
from vetrina.plans import catalogue as C


@pytest.fixture
def one_group(spark, tmp_path):
    """``part`` in one row group that Spark cuts into many splits."""
    spark.range(3000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("red ring "), F.col("id")).alias("p_name")).coalesce(1) \
        .write.parquet(f"{tmp_path}/part.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "1000")
    yield str(tmp_path)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_row_group_in_many_splits_is_spread(spark, one_group):
    assert spark.read.parquet(f"{one_group}/part.parquet").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    rows = [r["count"] for r in C.table(spark, one_group, "part").groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= spark.sparkContext.defaultParallelism and sum(rows) == 3000 and max(rows) < 3000
    assert C.table(spark, one_group, "part").distinct().count() == 3000


def test_more_tasks_for_more_rows(spark, one_group):
    assert C.table(spark, one_group, "part", 100).rdd.getNumPartitions() == max(30, spark.sparkContext.defaultParallelism)


def test_filters_stay_above_the_spread(spark, one_group, capsys):
    C.table(spark, one_group, "part").where(F.col("p_name").rlike("r.d")).explain()
    plan = capsys.readouterr().out
    assert plan.index("RLIKE") < plan.index("Exchange") and "RLIKE" not in plan[plan.index("Exchange"):]


def test_blocks_are_found_once(spark, capsys):
    X.ld_json_blocks(spark.createDataFrame([("u", "<p>")], "url string, html string")).explain()
    assert capsys.readouterr().out.count("regexp_extract_all(html") <= 1


def test_once_keeps_one_copy_of_its_value(spark, capsys):
    df = spark.range(3).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    same = T.once(F.col("h"), lambda h: (h == "x") | h.startswith("a") | h.endswith("b"))
    df.where(same).explain()
    plan = capsys.readouterr().out
    assert [line.count("sha2(") for line in plan.splitlines() if "Filter" in line] == [1]
    null = spark.createDataFrame([(None,), ("a",)], "h string").select(T.once(F.col("h"), lambda h: F.coalesce(h, F.lit("-"))).alias("x"))
    assert [r["x"] for r in null.collect()] == ["-", "a"]


def test_contained_sets_of_mixed_sizes(spark):
    from vetrina.operators.subsets import contained

    rows = spark.createDataFrame([(1, [("a", 2), ("b", 3), ("c", 1)]), (2, [("b", 5)]), (3, [(x, 1) for x in "abcdefg"])], "id int, hits array<struct<item:string,cnt:bigint>>")
    need = [("x", ["a"]), ("y", ["a", "b"]), ("z", ["a", "b"]), ("w", ["b", "c"]), ("v", list("abcdef")), ("u", list("abcdeh"))]
    sets = spark.createDataFrame([(n, q) for q, n in need], "need array<string>, ask string")
    got = {(r["id"], a, r["mult"]) for r in contained(rows, sets, 1000).collect() for a in r["asks"]}
    assert got == {(1, "x", 2), (1, "y", 6), (1, "z", 6), (1, "w", 3), (3, "x", 1), (3, "y", 1), (3, "z", 1), (3, "w", 1), (3, "v", 1)}
    assert contained(rows, sets.limit(0), 1000).count() == 0


def test_answers_are_not_shuffled(spark, capsys):
    from vetrina.operators.subsets import contained

    rows = spark.createDataFrame([(1, [("a", 1)])], "id int, hits array<struct<item:string,cnt:bigint>>").repartition(3, "id")
    contained(rows, spark.createDataFrame([(["a"], 1)], "need array<string>, ask int"), 100).groupBy("id", "mult").count().explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(id") == 1 and "hashpartitioning(id, mult" not in plan and "hashpartitioning(id#" in plan


def test_scores_read_each_table_once(spark, tmp_path, capsys):
    from vetrina.operators import evaluate as EV

    ids = [("f", "a", "s", 1), ("f", "b", "s", 2)]
    for name, cols in (("queries", 2), ("truth", 4), ("answers", 4)):
        spark.createDataFrame([r[:cols] for r in ids], ["file", "q", "system", "id"][:cols]).write.parquet(f"{tmp_path}/{name}")
    queries, truth, answers = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("queries", "truth", "answers"))
    EV.per_query(queries, truth.drop("system"), answers, ["s", "t"], ["file", "q"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 3 and plan.count("hashpartitioning(_u1") == 2  # ids, then a row per query
    EV.per_query(queries, truth.drop("system"), answers, ["s", "t"], ["file", "q"], rows=100 * EV.PART_IDS).explain()
    assert ", 100), REPARTITION_BY_NUM" in capsys.readouterr().out


@pytest.mark.parametrize("bits", [62, 2])
def test_scores_of_odd_rows(spark, monkeypatch, bits):
    """Repeated and null ids, null and unknown keys, unknown systems, ids as numbers and as texts."""
    from vetrina.operators import evaluate as EV

    monkeypatch.setattr(EV, "BITS", bits, raising=False)
    queries = [("f", "a"), ("f", "a"), ("g", "a"), ("f", None), ("f", "none")]
    truth = [("f", "a", 1), ("f", "a", 1), ("f", "a", 2), ("f", "a", None), ("g", "a", 3), ("f", None, 1), ("x", "a", 1)]
    answers = [("f", "a", "s", 1), ("f", "a", "s", 1), ("f", "a", "s", None), ("f", "a", "t", 2), ("f", "a", "t", 7), ("g", "a", "v", 3),
               ("f", None, "s", 1), ("f", "a", None, 1), ("f", "a", "w", 1), ("x", "a", "s", 1)]
    want = {("f", "a", "s"): (3, 2, 1), ("f", "a", "t"): (3, 2, 1), ("f", "a", "v"): (3, 0, 0), ("g", "a", "s"): (1, 0, 0), ("g", "a", "t"): (1, 0, 0),
            ("g", "a", "v"): (1, 1, 1)} | {("f", q, s): (0, 0, 0) for q in (None, "none") for s in "stv"}
    for t in ("long", "string"):
        got = EV.per_query(spark.createDataFrame(queries, "file string, q string"),
                           spark.createDataFrame(truth, "file string, q string, id long"),
                           spark.createDataFrame(answers, "file string, q string, system string, id long").withColumn("id", F.col("id").cast(t)), ["s", "t", "v"], ["file", "q"]).collect()
        assert {(r["file"], r["q"], r["system"]): (r["n_truth"], r["n_answer"], r["tp"]) for r in got} == want and len(got) == len(want)


def test_steps_of_contained_are_compiled(spark, capsys):
    from vetrina.operators.subsets import contained

    rows = spark.createDataFrame([(1, [("a", 1), ("b", 1)])], "id int, hits array<struct<item:string,cnt:bigint>>").repartition(3, "id")
    contained(rows, spark.createDataFrame([(["a"], 1), (["a", "b"], 2)], "need array<string>, ask int"), 100).explain()
    plan = capsys.readouterr().out
    steps = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(steps) == 2 and not any("lambda" in line for line in steps)


def test_terms_are_dealt_once_by_rows(spark, capsys):
    """Texts that make many answers of few bytes don't end in few tasks."""
    from vetrina.operators import search as S

    docs = spark.createDataFrame([(i, f"red ring {i}") for i in range(40)], "id long, text string")
    got = S.keyword_search(spark.createDataFrame([("q", "red ring")], "query_id string, text_query string"), docs)
    got.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(id" in plan and "REPARTITION_BY_NUM" in plan and "hashpartitioning(term" not in plan.split("Union")[-1].split("BroadcastExchange")[0]
    assert sorted(r["id"] for r in got.collect()) == list(range(40))


def test_log_lists_of_all_systems(spark, tmp_path):
    from vetrina.sources import io as IO

    queries = spark.createDataFrame([(f"brand=B#{i}", 1, f"B#{i}", None, None, None, None) for i in range(300)],
                                    "query_id string, n_features int, brand string, category string, capacity string, olfactory_category string, price string")
    rows = [(f"brand=B#{i}", j) for i in range(300) for j in range(i % 4)] + [("unknown", 1), (None, 2)]
    one = spark.createDataFrame(rows, "query_id string, id long")
    IO.write_query_log(queries, {"results": one, "text_results": one.where("id > 0").withColumn("solutions", F.lit(2).cast("bigint"))}, f"{tmp_path}/log", lists=True)
    got = {r["query"]["brand"]: (r["results"], r["text_results"]) for r in IO.read_query_log(spark, f"{tmp_path}/log").collect()}
    assert got == {f"B#{i}": (list(range(i % 4)), [x for x in range(1, i % 4) for _ in "12"]) for i in range(300)}
    numbers = queries.where("query_id = 'brand=B#3'").withColumn("query_id", F.lit(3))
    IO.write_query_log(numbers, {"results": spark.range(2).select(F.lit(3).cast("bigint").alias("query_id"), "id")}, f"{tmp_path}/numbers", lists=True)
    assert [r["results"] for r in IO.read_query_log(spark, f"{tmp_path}/numbers").collect()] == [[0, 1]]
