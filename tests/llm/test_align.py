import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.conftest import documents
from vetrina import session
from vetrina.llm import align

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encoders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=align.B_PATH)


def _bytes_a(token):
    """Through the public byte table: a vocabulary's character to its byte."""
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    table, extra = {}, 0
    for b in range(256):
        if b in shown:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return bytes(table[c] for c in token)


def expected(rows, encoders):
    a, b = encoders
    done = []
    for _, text in rows:
        want = b" " + (text or "").encode()
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta = [_bytes_a(a.id_to_token(i)) for i in ia]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]]
        if not text or b"".join(ta) != want or b"".join(tb) != want:
            done.append(None)
            continue
        spans = []
        for tokens in (ta, tb):
            at, out = 0, []
            for t in tokens:
                out.append((at, at + len(t)))
                at += len(t)
            spans.append(out)
        links = [(ia[i], ib[j]) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e]
        groups, ga, gb, i, j = [], [], [], 0, 0
        for end in sorted({e for side in spans for _, e in side}):
            if i < len(ia) and spans[0][i][1] == end:
                ga.append(ia[i])
                i += 1
            if j < len(ib) and spans[1][j][1] == end:
                gb.append(ib[j])
                j += 1
            if spans[0][i - 1][1] == end == spans[1][j - 1][1] and i and j:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        done.append((len(ia), len(ib), groups, links))
    count = Counter(pair for d in done if d for pair in set(d[3]))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), d in zip(rows, done, strict=True):
        out.append((doc_id, 0, 0, 0, 0, 0, 0, "") if d is None else (
            doc_id, d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]),
            hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in align.alignment(documents(spark, rows, "pair long, n long, row long, links string")).collect()), key=str)


EDGES = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "x ▁y"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"), (7, "naïve café 日本語 \U0001f600\U0001f468‍\U0001f469"),
         (8, "a\tb\r\n\n\nc\x00d"), (9, "don't I'LL 12345 3.14"), (None, "same text"), (None, "same text"), (12, "same text"), (13, "é ﬁ ①"), (13, "another of id 13"),
         (14, "a" * 3000), (15, "\n"), (16, "  x"), (17, "unbelievable internationalisation, unbelievable!")]


def test_edges(spark, encoders):
    assert run(spark, EDGES) == expected(EDGES, encoders)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == expected([(1, None), (2, "")], encoders)


def test_texts(spark, texts, encoders):
    rows = [(i, t) for i, t in texts if t and len(t) < 1500][:150]
    want = expected(rows, encoders)
    assert sum(r[4] for r in want) > 5000 and len({r[5] for r in want}) > 30
    assert run(spark, rows) == want


def test_same_without_broadcast(spark, encoders, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 0)
    assert run(spark, EDGES) == expected(EDGES, encoders)


def test_chunks_merge(spark, encoders, monkeypatch):
    """Partial counts of many chunks add up."""
    from vetrina.llm.text import chunks

    got = []
    files = open(align.A_PATH, "rb").read(), open(align.B_PATH, "rb").read()
    monkeypatch.setattr(align, "chunks", lambda batches, column, limit: chunks(batches, column, 30))
    rows = [(i, "the same words here " * (1 + i % 3)) for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    for out in align._scan(*files)(iter([batch])):
        got += out.to_pylist()
    parts = [r["counts"] for r in got if r["counts"] is not None]
    total = Counter()
    for part in parts:
        for x in part:
            total[x["pair"]] += x["n"]
    whole = Counter(x["pair"] for r in got if r["counts"] is None for x in r["links"])
    assert len(parts) == 20 and total == whole


def whole(encoders, text):
    return encoders[0].encode(" " + text, add_special_tokens=False).ids, encoders[1].encode(text)


def by_words(parts):
    a, b = (kind(open(path, "rb").read()) for kind, path in ((align.ByteBpe, align.A_PATH), (align.PieceBpe, align.B_PATH)))
    found = align.words(pa.array(parts, pa.string()).fill_null(""))
    strings = found[0].dictionary.to_pylist()
    return list(zip(*(align._encoded(found, strings, e).to_pylist() for e in (a, b)), strict=True))


def test_long_texts(encoders):
    """Very long runs of white space go through the whole encoder."""
    parts = [" " * 300_000, "x" + "\n" * 60_000 + "y", "a" * 200_000, "ab " * 60_000]
    assert by_words(parts) == [whole(encoders, t) for t in parts]


def test_words_encode_like_whole_texts(texts, encoders):
    odd = ["", " ", "a b", " a b ", "a  b", "é è", "e\u0301 x", "x \u00a0y", "a \x85b", "\x1c \x1c", "ab\n cd \tef", "日本 語", "à la carte", "don 't I 'll", "1 2 3", "\u3000 x", "Ã Â", "a"]
    parts = odd + [t for _, t in texts if t]
    assert by_words(parts) == [(([], []) if not t else whole(encoders, t)) for t in parts]
    assert len(align.words(pa.array(["one two", "", "three  four", " five"]))[0]) == 4


def test_quick_encoder_is_in_use():
    assert align.ByteBpe(open(align.A_PATH, "rb").read())._quick is not None
