import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SMALL, documents
from vetrina.llm import pii
from vetrina.llm.bilstm import Tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def only_digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(digits):
    doubled = [int(x) * (2 if i % 2 else 1) for i, x in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def expected(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(only_digits(m[0])) <= 19 and luhn(only_digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]


@settings(deadline=None, max_examples=400)
@given(st.one_of(*(st.text(alphabet=a, max_size=60) for a in ("0123456789.", "ab@.-1 é", "+0123 ()-.", "1234567890- ", "a1@.+- \n"))))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == expected(text)


def test_cards():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112 and 5500005555555559 but 4111 1111 1111 1111 1111 1"
    assert [text[s:e] for k, s, e in pii.base_spans(text) if k == 2] == ["4111 1111 1111 1111", "5500005555555559"] == [text[s:e] for k, s, e in expected(text) if k == 2]


@pytest.mark.parametrize("text", ["1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 100_000, "+1" * 50_000, "1 " * 100_000, "a@b" * 50_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


@pytest.fixture(scope="module")
def tagger(texts):
    marked = [t[max(m.start() - 60, 0):m.start() + 60] for _, t in texts if (m := pii._MARK.search(t))]
    return pii.train(marked * 5, steps=200)


def test_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    t = Tagger(6, 5, hidden=3)
    x = rng.integers(1, 6, (4, 7))
    x[1, 5:] = 0
    y = np.where(x > 0, rng.integers(0, 5, (4, 7)), 0)
    _, grad = t.gradient(x, y)
    for name, p in t.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        old, losses = p[at], []
        for step in (1e-5, -1e-5):
            p[at] = old + step
            losses.append(t.gradient(x, y)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-5 - grad[name][at]) < 1e-5, name


def test_tagger_learns_held_out_spans(tagger, texts):
    x, y = pii.training_rows([t[:4000] for _, t in texts], seed=99)
    got = [set(pii._spans_of(t)) for t in tagger.decode(x, pii._barred())]
    want = [set(pii._spans_of(t)) for t in y]
    both = sum(len(a & b) for a, b in zip(got, want, strict=True))
    assert both / sum(map(len, want)) > 0.7 and both / max(sum(map(len, got)), 1) > 0.8


def test_added_spans(tagger):
    """Variants that no base pattern has, and look-alikes that are none."""
    cases = [("call me at (415) 555-0199 today", (3, "(415) 555-0199")), ("mail john.doe (at) example.org now", (0, "john.doe (at) example.org")),
             ("card 4111.1111.1111.1111 ok", (2, "4111.1111.1111.1111")), ("the host 10[.]0[.]0[.]1 is up", (1, "10[.]0[.]0[.]1"))]
    found = 0
    for text, (kind, want) in cases:
        base, spans = pii.all_spans([text], tagger)[0]
        assert not base
        found += [(k, text[s:e]) for k, s, e in spans] == [(kind, want)]
    assert found >= 2
    assert pii.all_spans(["on 2024-01-05 at 12:30:44 we paid 1,234,567.89 for v1.2.3"], tagger) == [([], [])]


def test_windows_cover_every_mark(texts):
    for text in [t for _, t in texts] + ["x" * 300 + "1" + "y" * 500 + "@" + "2" * 1000, "1", ""]:
        spans = list(pii.windows(text))
        assert all(0 < e - s <= pii.WINDOW for s, e in spans)
        for m in pii._MARK.finditer(text):
            assert any(s <= max(m.start() - pii.CONTEXT, 0) and m.end() <= e or s <= m.start() < e for s, e in spans)


class Reader:
    """A perfect tagger of what a window shows: spans by the look of the classes."""
    LOOK = "\0" + "0aA \nx~" + pii._ALONE
    SHAPES = ((0, re.compile(r"[a-z._%+-]+(?: ?@ ?| ?[\[(]aa[\])] ?)[a-z-]+(?:\.[a-z-]+)*")), (3, re.compile(r"\+?[0-9](?:[ -]*[0-9])*")))

    def decode(self, x, barred):
        import numpy as np

        tags = np.zeros(x.shape, dtype=np.int64)
        for row, out in zip(x, tags, strict=True):
            shown = "".join(self.LOOK[c] for c in row)
            for kind, shape in self.SHAPES:
                for m in shape.finditer(shown):
                    out[m.start()], out[m.start() + 1:m.end()] = 1 + 2 * kind, 2 + 2 * kind
        return tags


LONG = [(0, "webmaster (at) mathematik.uni-heidelberg.de"), (0, "x @ department-of-physics.example.edu"), (0, "firstname.middlename.lastname (at) x.org"),
        (0, "a" * 70 + "." + "b" * 90 + " @ " + "c" * 300 + ".example.org"), (0, "some_one.with-a.long.name [at] " + "part-of.the." * 12 + "org"),
        (3, "+49" + "   -   62" * 6), (3, "49" + " " * 150 + "622154")]


@pytest.mark.parametrize("kind, span", LONG)
@pytest.mark.parametrize("before", [0, 1, 23, 24, 47, 48, 95, 400])
def test_no_span_is_lost_at_an_edge(kind, span, before):
    digits = "; " + "7; " * 40  # further marks, so that regions are longer than a window
    for text in (f"{'filler; ' * before}{span}; and so on; " + "filler; " * 30, f"{digits[:before]}; {span}{digits}"):
        at = text.index(span)
        assert (kind, at, at + len(span)) in pii.tagged_spans([text], Reader())[0]
        assert (kind, at, at + len(span)) in pii.all_spans(["", text, "1"], Reader())[1][1]


@pytest.mark.parametrize("text", ["1 " * 30_000, "a @ b.c " * 8_000, "a (at) b" * 8_000, "a@" * 20_000, ("1" + " " * 60) * 1_000, "1" + " " * 60_000 + "2", "@" * 40_000])
def test_wider_windows_end(text):
    windows = [*pii.windows(text), *pii.addresses(text)]
    assert sum(e - s for s, e in windows) < 12 * len(text)
    pii.tagged_spans([text], Reader())


def test_tagger_reads_long_addresses(tagger):
    found = 0
    for _, want in LONG[:3]:
        for frame in ("please write to {} for more about this", "Contact: {}.", "{}"):
            text = frame.format(want)
            found += (0, text.index(want), text.index(want) + len(want)) in pii.all_spans([text], tagger)[0][1]
    assert found >= 5


def test_reconcile():
    assert pii.reconcile({(0, 0, 5), (1, 3, 12), (2, 20, 25), (3, 24, 26)}, [(0, 25, 30)]) == [(1, 3, 12), (2, 20, 25)]


def test_find(spark, tagger, texts):
    rows = [*texts, (None, "x@y.zz"), (-1, None), (-2, ""), (-3, "é 1.2.3.4 é"), (-3, "é 1.2.3.4 é"), (-4, "w " * 50_000 + "a@b.cc")]
    got = {}
    for r in pii.find(documents(spark, rows), tagger).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text in rows:
        base = expected(text or "")
        for r in got[doc_id]:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in range(4)]
            written = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
            assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
            spans = [x for x in r.spans.split(",") if x]
            assert set(written) <= set(spans) and len(spans) == len(base) + r.n_added
            assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_fit_is_bounded_and_takes_empty_tables(spark):
    t = pii.fit(documents(spark, []), steps=2)
    assert pii.find(documents(spark, []), t).count() == 0


def test_stage_redacts(spark, monkeypatch):
    monkeypatch.setattr(pii, "FIT_STEPS", 2)
    docs = documents(spark, [(1, "mail a.b@c.org now"), (2, None), (3, "no data"), (None, "ip 10.0.0.1")], "score string")
    out = pii.stage(spark, docs, SMALL)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("mail [EMAIL] now", 16), 2: (None, None), 3: ("no data", 7), None: ("ip [IP]", 7)}


def test_redacted_merges_overlaps():
    assert pii.redacted("abcdefghij", [(0, 1, 5), (3, 4, 7), (2, 7, 8)]) == "a[EMAIL][CARD]ij"


def test_reconcile_like_pairwise_and_quick():
    import random
    import time

    from vetrina.llm.pii import reconcile

    def pairwise(found, base):
        kept = []
        for span in sorted(found, key=lambda x: (x[1] - x[2], x[1], x[0])):
            if not any(span[1] < e and s < span[2] for _, s, e in [*base, *kept]):
                kept.append(span)
        return kept

    rng = random.Random(3)
    for _ in range(300):
        spans = {(rng.randrange(4), s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(15)))}
        base = [(0, s, s + rng.randrange(1, 12)) for s in (rng.randrange(60) for _ in range(rng.randrange(5)))]
        assert reconcile(spans, base) == pairwise(spans, base)
    start = time.time()
    assert len(reconcile({(3, 12 * i, 12 * i + 10) for i in range(50_000)}, [(1, 12 * i, 12 * i + 3) for i in range(0, 50_000, 2)])) == 25_000
    assert time.time() - start < 5
