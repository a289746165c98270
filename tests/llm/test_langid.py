import zlib
from collections import Counter

import pytest

from tests.llm.conftest import SMALL, documents
from vetrina.llm import langid


def grams(text):
    """Counts of n-grams, by plain Python."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        for n in (2, 3):
            out.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    return out


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ranked(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def expected(rows, size):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not held(i):
            counts.setdefault(lang, Counter()).update(grams(text))
    profiles = {k: {g: r for r, g in enumerate(ranked(c, size))} for k, c in counts.items() if c}
    out = []
    for i, text, _ in rows:
        own = ranked(grams(text or ""), size)
        if not own or not profiles:
            out.append((i, held(i), "und", 0.0))
            continue
        apart = {k: sum(min(abs(p[g] - r), size) if g in p else size for r, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        out.append((i, held(i), best, 1 - apart[best] / (size * len(own))))
    return out


def check(spark, rows, size=langid.PROFILE):
    got = sorted((tuple(r) for r in langid.identify(documents(spark, rows), size).collect()), key=str)
    want = sorted(expected(rows, size), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_edges(spark):
    check(spark, [(0, "the cat sat on the mat", "en"), (1, "le chat est sur la table", "fr"), (2, "the dog", None), (3, None, "en"), (4, "", "fr"),
                  (5, "123 !!", "en"), (6, "die Katze ist ÜBERALL", "de"), (6, "die Katze ist ÜBERALL", "de"), (None, "the the", "en"), (7, "q", "fr"),
                  (8, "日本語 テキスト 𝒳𝒴 𐐀", "ja"), (9, "İstanbul ß ŉ", "tr"), (10, "a퟿b" + "x" * 5000, "en"), (11, "the cat " * 30_000, "en")])


def test_few_grams_and_ties(spark):
    check(spark, [(0, "ab ab ba", "x"), (1, "ab ab ba", "y"), (3, "ba", None), (4, "ab", None)], size=3)


def test_empty_table_and_nothing_to_learn(spark):
    check(spark, [])
    check(spark, [(1, "some text", None)])


def test_pieces_of_long_texts_count_alike(monkeypatch):
    points = langid._points("the quick brown fox jumps over the lazy dog " * 20)
    whole = langid.counted(points)
    monkeypatch.setattr(langid, "PIECE", 50)
    pieces = langid.counted(points)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.97
