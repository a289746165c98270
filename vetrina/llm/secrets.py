"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The
ledger, a folder of Parquet tables, knows which (blob, rule, rule version) was
scanned before and what was found. A scan takes the pairs that the ledger
doesn't have, reads one text for each unseen blob, applies only the rules that
the blob lacks and appends. Findings are then joined back to all paths and
revisions that hold the blob, so a copy costs a join and no scan, and a new
version of one rule rescans with that rule alone.

The ledger grows by batches. A batch's findings are written before its list of
scanned pairs, and count only where that list is there: a scan that dies half
way leaves nothing behind that is read, and its pairs are scanned again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.text import chunks, small_batches
from vetrina.session import bounded_broadcast, cut_lineage, scratch_path

BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and which of its matches count. Change
    ``version`` with either, so that seen blobs are scanned anew."""

    kind: str
    version: int
    pattern: str
    holds: Callable[[re.Match], bool] | None = None

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Leftmost matches that don't overlap; those that don't hold are dropped, and nothing in them is tried again."""
        for m in re.compile(self.pattern, re.ASCII).finditer(text):
            if self.holds is None or self.holds(m):
                yield m.span()


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


#: The base kinds first. Their patterns are fixed values of the contract; a
#: minimum length inside a pattern is the same as dropping shorter matches
#: where the class repeats up to the match's end and starts it.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+"),
    Rule("hex", 1, r"[0-9a-f]{32,}+"),
    # added kinds: formats that their issuers publish
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", 1, r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+"),
    Rule("url", 1, r"(?<=://)[A-Za-z0-9._~%-]{1,64}:[^\s:/@?#'\"<>]{6,128}(?=@[A-Za-z0-9])"),
)

_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
_SCANNED = "blob binary, rule string, version int"
_FINDINGS = "blob binary, rule string, version int, start long, stop long"


def _apply(rules: Sequence[Rule]):
    """mapInArrow function: (blob, found) of texts with the kinds they lack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = {r.kind: r for r in rules}
        for batch in chunks(batches, "text"):
            found = []
            for text, kinds in zip(batch.column("text").to_pylist(), batch.column("lacks").to_pylist(), strict=True):
                found.append([(k, by_kind[k].version, s, e) for k in kinds for s, e in by_kind[k].spans(text or "")])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(
                [[dict(zip(("rule", "version", "start", "stop"), x, strict=True)) for x in row] for row in found], _FOUND)], names=["blob", "found"])
    return run


class Ledger:
    """The scanned pairs and findings of a folder in shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        if not there:
            return self.spark.createDataFrame([], f"{schema}, batch string")
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        """(blob, rule, version) of all complete batches."""
        done = self._table("batches", "n long").select("batch")
        return self._table("scanned", _SCANNED).join(done, "batch", "left_semi").drop("batch")

    def findings(self) -> DataFrame:
        """(blob, rule, version, start, stop) of all complete batches, each once."""
        done = self._table("batches", "n long").select("batch")
        return self._table("findings", _FINDINGS).join(done, "batch", "left_semi").drop("batch").distinct()

    def lacking(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """(blob, lacks): the kinds that blobs of ``blobs(blob)``, each once
        there, weren't scanned for in these versions; those with any only."""
        now = self.spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
        seen = self.scanned().join(F.broadcast(now), ["rule", "version"], "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("has"))
        all_kinds = F.array(*(F.lit(r.kind) for r in rules))
        has = F.coalesce("has", F.array().cast("array<string>"))
        return blobs.join(seen, "blob", "left").select("blob", F.array_except(all_kinds, has).alias("lacks")).where(F.size("lacks") > 0)

    def add(self, versions: DataFrame, rules: Sequence[Rule] = RULES, places: DataFrame | None = None) -> int:
        """Scan what ``versions(path, revision, blob, text)`` has and the ledger
        lacks; the number of pairs of blob and rule version that were scanned.
        ``places(path, revision, blob)``: the same rows without texts, where they are at hand.

        One row stands for each unseen blob, that with the smallest path and
        revision. Only rows that share all three are read more than once, and
        their findings count once.
        """
        small_batches(self.spark)
        keys = (versions if places is None else places).groupBy("blob").agg(F.min(F.struct("path", "revision")).alias("one"))
        todo = cut_lineage(self.lacking(keys.select("blob"), rules).join(keys, "blob").select(
            F.col("blob").alias("of"), "lacks", F.col("one.path").alias("at"), F.col("one.revision").alias("since")), "unseen")
        n = todo.agg(F.sum(F.size("lacks"))).first()[0] or 0
        if not n:
            return 0
        texts = versions.join(bounded_broadcast(todo), F.expr("blob = of AND path <=> at AND revision <=> since")).select("blob", "text", "lacks")
        found = texts.mapInArrow(_apply(rules), "blob binary, found array<struct<rule: string, version: int, start: long, stop: long>>")
        batch = uuid.uuid4().hex
        found.select("blob", F.inline("found")).write.parquet(f"{self.path}/findings/batch={batch}")
        version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
        todo.select(F.col("of").alias("blob"), F.explode("lacks").alias("rule")).withColumn("version", version[F.col("rule")].cast("int")).write.parquet(
            f"{self.path}/scanned/batch={batch}")
        self.spark.createDataFrame([(n,)], "n long").coalesce(1).write.parquet(f"{self.path}/batches/batch={batch}")
        return n


def addressed(versions: DataFrame) -> DataFrame:
    """``versions(path, revision, text)`` with ``blob``, the SHA-256 of the text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return versions.select("path", "revision", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))


def _digest(spans):
    written = F.transform(spans, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["stop"].cast("string")))
    return F.array_join(written, ",")


def scan(versions: DataFrame, ledger: Ledger, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row of ``versions(path, revision, text)``: path, revision, blob
    (hex), and found: its findings of these rules' versions as an array of
    (start, place of the rule, rule, stop), sorted.

    Null and empty texts share the blob of the empty text and have none.
    Offsets are code points. Repeated rows each get their row; a null path or
    revision is a value of its own. Other columns are ignored.
    """
    rows = addressed(versions)
    places = cut_lineage(rows.select("path", "revision", "blob"), "places")
    ledger.add(rows, rules, places)
    now = ledger.spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "rule string, version int, place int")
    found = ledger.findings().join(F.broadcast(now), ["rule", "version"])
    found = found.groupBy(F.col("blob").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "place", "rule", "stop"))).alias("found"))
    none = F.array().cast("array<struct<start: bigint, place: int, rule: string, stop: bigint>>")
    found = cut_lineage(found, "found")  # a row a blob; a blob that a third of all paths hold is on the side that AQE may split
    return places.join(bounded_broadcast(found), F.col("blob") == F.col("of"), "left").select(
        "path", "revision", F.lower(F.hex("blob")).alias("blob"), F.coalesce("found", none).alias("found"))


def report(found: DataFrame, base: Sequence[str] = BASE) -> DataFrame:
    """``scan``'s rows with n_<kind> of the base kinds, base_sha256 (of the
    base findings as kind:start:end, comma-joined) and spans (all, written likewise)."""
    def number(kind: str):
        return F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.filter("found", lambda x: x["rule"].isin(*base))
    return found.select("path", "revision", "blob", *map(number, base),
                        F.sha2(_digest(of_base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as paths with one revision, against a ledger of this run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("revision"), "text")
    found = report(scan(versions, Ledger(spark, scratch_path(spark, "ledger"))))
    return found.select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")

