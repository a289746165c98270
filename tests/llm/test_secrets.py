import hashlib
import re

import pytest

from tests.llm.conftest import documents
from vetrina import session
from vetrina.llm import secrets
from vetrina.llm.secrets import RULES, Ledger, Rule
from vetrina.session import scratch_path

KEY = "AKIA" + "Z9" * 8
BLOCK = "-----BEGIN RSA PRIVATE KEY-----\nDEK-Info: x\nabc+/=\n-----END RSA PRIVATE KEY-----"


def base(text):
    """The contract's patterns, character by character where a pattern is a run."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def expected(rows):
    out = []
    for doc_id, text in rows:
        found = base(text or "")
        written = ",".join(f"{secrets.BASE[k]}:{s}:{e}" for s, k, e in found)
        out.append((doc_id, *(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(written.encode()).hexdigest(), written))
    return sorted(out, key=str)


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, revision int, text string").selectExpr("*", "'x' AS rule", "1 AS place", "'y' AS found", "7 AS of", "8 AS at", "path AS batch")


def scan(spark, rows, ledger, rules=RULES):
    return sorted(((r.path, r.revision, [(x.rule, x.start, x.stop) for x in r.found]) for r in secrets.scan(versions(spark, rows), ledger, rules).collect()), key=str)


EDGES = ["", "password=short", "token=token:abcdefgh1", "API_KEY: 'abcdefgh'", "apikey   =   \"a.b/c+d_e=\"", "\u017fecret=abcdefgh1 to\u212aen=abcdefgh1", KEY, "AKIA" + "A" * 11, "xAKIA" + "B" * 12,
         "AKIAAKIA" + "C" * 9, "f" * 31, "f" * 32 + "g" + "0" * 40, "F" * 40, f"password={KEY}", "\U0001f600" * 3 + "secret=12345678", "passwd=" + "a" * 33, "token:" + " " * 5000 + "x" * 9,
         "Password\" : \"hunter2hunter2", "secret=\n12345678", "tokentoken=aaaaaaaa", "password = = 12345678", "deadbeef" * 20000]


def test_base_spans_match_the_patterns(spark):
    rows = [*enumerate(EDGES), (None, KEY), (None, KEY), (3, "f" * 32), (40, None)]
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    found = secrets.report(secrets.scan(documents(spark, rows).selectExpr("doc_id AS path", "1 AS revision", "text"), ledger))
    assert sorted((tuple(r[c] for c in ("path", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in found.collect()), key=str) == expected(rows)


def test_table(spark):
    docs = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{docs}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r)[:5] for r in secrets.query(spark, docs).collect()), key=str)
    want = [r[:5] for r in expected(rows)]
    assert got == want and sum(sum(r[1:4]) for r in want) > 3


def test_added_kinds(spark):
    text = f"{BLOCK} ghp_{'a1B2' * 9} xoxb-123456789012-abc eyJ{'a' * 10}.eyJ{'b' * 10}.{'c' * 20} https://user:pa55word@host.org/ https://host.org:80/a@b"
    got = scan(spark, [("a", 1, text), ("b", 1, "an ordinary text, see http://host.org/x?y=z and mail me@host.org. -----BEGIN RSA PRIVATE KEY----- is a heading")],
               Ledger(spark, scratch_path(spark, "ledger")))
    assert [x[0] for x in got[0][2]] == ["pem", "github", "slack", "jwt", "url"] and got[1][2] == []
    s = {k: text[a:b] for k, a, b in got[0][2]}
    assert s["pem"] == BLOCK and s["url"] == "user:pa55word"


def test_only_unseen_pairs_are_scanned(spark):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    first = [("a", 1, KEY), ("b", 1, KEY), ("b", 1, KEY), ("c", 1, "clean"), (None, None, None), ("d", 2, "")]
    rules = [Rule("access", 1, r"AKIA[A-Z0-9]{12,}+"), Rule("word", 1, "clean")]

    def add(rows, rules):
        return ledger.add(secrets.addressed(versions(spark, rows)), rules)

    assert add(first, rules) == 3 * 2  # three texts, two rules
    assert add(first, rules) == 0
    more = [*first, ("a", 2, "clean"), ("a", 3, "new clean text"), ("e", 1, KEY)]
    assert add(more, rules) == 2  # one new text
    assert scan(spark, more, ledger, rules) == sorted(
        [("a", 1, [("access", 0, 20)]), ("b", 1, [("access", 0, 20)]), ("b", 1, [("access", 0, 20)]), ("c", 1, [("word", 0, 5)]), (None, None, []), ("d", 2, []),
         ("a", 2, [("word", 0, 5)]), ("a", 3, [("word", 4, 9)]), ("e", 1, [("access", 0, 20)])], key=str)
    newer = [rules[0], Rule("word", 2, "text")]
    assert add(more, newer) == 4  # every text, with the new version alone
    assert [x for x in scan(spark, more, ledger, newer) if x[0] in ("a", "c") and x[1] in (1, 3)] == [
        ("a", 1, [("access", 0, 20)]), ("a", 3, [("word", 10, 14)]), ("c", 1, [])]
    assert [x for x in scan(spark, more, ledger, rules) if x[0] == "c"] == [("c", 1, [("word", 0, 5)])]  # the old version's findings stay


def test_a_scan_that_died_leaves_nothing(spark):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    spark.createDataFrame([(b"x", "access", 1, 5, 9)], "blob binary, rule string, version int, start long, stop long").write.parquet(f"{ledger.path}/findings/batch=dead")
    spark.createDataFrame([(b"x", "access", 1)], "blob binary, rule string, version int").write.parquet(f"{ledger.path}/scanned/batch=dead")
    assert ledger.findings().count() == 0 and ledger.scanned().count() == 0
    assert scan(spark, [("a", 1, KEY)], ledger)[0][2] == [("access", 0, 20)]
    assert ledger.findings().count() == 1


def test_empty_and_without_broadcast(spark, monkeypatch):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    assert scan(spark, [], ledger) == []
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", -1)
    assert [len(x[2]) for x in scan(spark, [(str(i), 1, KEY if i % 3 else f"token={i:09}") for i in range(60)], ledger)] == [1] * 60


@pytest.mark.parametrize("text", ["password" + " " * 200_000, "token=" * 40_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "://" + "a" * 300_000, "eyJ" * 100_000, "AKIA" * 70_000])
def test_linear_in_long_texts(text):
    import time

    start = time.time()
    for rule in RULES:
        list(rule.spans(text))
    assert time.time() - start < 5
