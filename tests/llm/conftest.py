import glob

import pytest

from vetrina.llm.registry import importable

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def workers_import_the_package(spark):
    importable(lambda s, d: None)(spark, "")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the smallest documents table, in plain Python."""
    import pyarrow.parquet as pq

    rows = pq.read_table(glob.glob(f"{SMALL}/documents.parquet")[0]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]


def documents(spark, rows, extra="fp long, th long, hits string, held_out string, score string, block int, cls int, gone_id int, bad_id int, y int"):
    """A documents table of (doc_id, text[, lang]) rows, with columns whose
    names clash with those that operators use inside."""
    full = [(*r, *[None] * (3 - len(r)), "s", None if r[1] is None else len(r[1]), *[None] * len(extra.split(","))) for r in rows]
    return spark.createDataFrame(full, f"{DOCS}, {extra}")
