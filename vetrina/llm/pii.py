"""Personal data: base patterns, and a BiLSTM-CRF tagger that adds spans.

Base spans are exact: fixed patterns plus number checks, matched in time
linear in the text. The tagger reads characters in overlapping windows around
every mark of a whole text: digits, @ and a bracketed "at". A span of any kind
holds one of these, so text further than ``CONTEXT`` characters from all of
them and from the addresses they may belong to has none by rule and is not
decoded. An address that such a window may cut has a window of its own, as long
as the longest address that can be read there and ``CONTEXT`` on either side.
A span of digits that a window's edge cuts is left to the window that holds it
or, where none does, decoded again in wider windows centred on it. Of
overlapping spans the longest stays. The tagger's spans pass a check of their
kind and stay where they overlap no base span.

The tagger is trained in numpy on the driver, from labelled spans: base spans
of ``FIT_DOCS`` documents at most (those with the smallest hash of their id),
and written variants of the kinds (``_written``) in the same contexts.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.bilstm import Tagger
from vetrina.llm.text import chunks, small_batches

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 400
FIT_STEPS = 320
WINDOW = 96
STRIDE = 48
CONTEXT = 24
#: Windows of usual width that are decoded at once.
ROWS = 2048
#: Letters of each word of a written address, at most.
WORD = 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({] ?(?:at|AT) ?[\])}]")
_AT = re.compile(r"@|[\[({] ?(?:at|AT) ?[\])}]")
_HOST = re.compile(r" ?[\w-]++(?:(?: ?\. ?| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?)[\w-]++)++")
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}")
_ALNUM = re.compile(r"[^\W_]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ is tried once, with all local characters in front of it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def _small_parts(ip: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 if (x := p.lstrip("0")) else True for p in ip.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind, then start (code points)."""
    found = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if _small_parts(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


# ---- the tagger's view of text

_ALONE = "@.-+()_%/:,;=\"'#[]{}<>|&*!?\\"


def _class(c: str) -> int:
    if "0" <= c <= "9":
        return 1
    if "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    if c == " ":
        return 4
    if c.isspace():
        return 5
    return 8 + _ALONE.index(c) if c in _ALONE else 6 if c.isalpha() else 7


N_CLASSES = 8 + len(_ALONE)
N_TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2 k: first character of kind k; 2 + 2 k: a further one

_ASCII = np.array([_class(chr(i)) for i in range(128)], dtype=np.int8)


def _barred() -> np.ndarray:
    """A further character follows the first or a further one of its kind."""
    out = np.zeros((N_TAGS, N_TAGS), dtype=bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = True
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False
    return out


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(points, 127)]
    for i in np.flatnonzero(points > 127):
        out[i] = _class(text[i])
    return out


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Overlapping windows that cover every mark with CONTEXT around it."""
    start, end = 0, -CONTEXT - 1  # nothing yet
    for m in _MARK.finditer(text):
        if m.start() - CONTEXT > end:
            yield from _cut(start, end)
            start = max(m.start() - CONTEXT, 0)
        end = min(m.end() + CONTEXT, len(text))
    yield from _cut(start, end)


def _cut(start: int, end: int) -> Iterator[tuple[int, int]]:
    while start < end:
        yield start, min(start + WINDOW, end)
        if start + WINDOW >= end:
            return
        start += STRIDE


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Windows that hold the longest address around an at-sign, with CONTEXT,
    where other windows may cut it. No character is in more than a few."""
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        local = start = m.start() - (text[m.start() - 1:m.start()] == " ")
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if host and start < local:
            near = m.start() - CONTEXT < start and host.end() < m.end() + CONTEXT
            if not near or host.end() - start >= WINDOW - STRIDE - 1:
                yield max(start - CONTEXT, 0), min(host.end() + CONTEXT, len(text))


def _may_grow(kind: int, text: str) -> bool:
    """Whether a plausible span of digits can hold this part of it."""
    if kind == 0:
        return False  # ``addresses`` has a window for it
    if kind == 2 and re.search(r"[A-Za-z]", text) or kind == 3 and re.search(r"[^\d\s().+/-]", text):
        return False
    return len(_digits(text)) <= (12, 19, 15)[kind - 1]


def _to_edges(text: str, a: int, b: int, start: int, end: int) -> tuple[int, int]:
    """The part of a span in a window, up to an edge that cuts it: one that it
    touches, or reaches without a letter or digit between."""
    return (start if start > 0 and not _ALNUM.search(text, start, a) else a,
            end if end < len(text) and not _ALNUM.search(text, b, end) else b)


def _wider(texts: list[str], cut: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, window, part) for the parts of spans that edges cut;
    parts that overlap count as one span's."""
    runs: list[list[int]] = []
    for i, a, b in sorted(set(cut)):
        if runs and runs[-1][0] == i and a <= runs[-1][2] and len(_digits(texts[i][runs[-1][1]:b])) <= 19:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([i, a, b])
    for i, a, b in runs:
        pad = max(WINDOW // 2, 2 * (b - a))
        yield i, max(a - pad, 0), min(b + pad, len(texts[i])), a, b


def _plausible(kind: int, text: str) -> bool:
    d = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+(?: ?@ ?| ?[\[({] ?(?:at|AT) ?[\])}] ?)[\w-]+(?:(?: ?\. ?| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?)[\w-]+)+", text))
    if kind == 1:
        parts = [p for p in re.split(r"[^0-9]+", text) if p]
        return len(parts) == 4 and all(int(p) <= 255 for p in parts if len(p) <= 3) and max(map(len, parts)) <= 3
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", text)
    if _DATE.fullmatch(text):
        return False
    return 8 <= len(d) <= 15 and not re.search(r"[^\d\s().+/-]", text) and bool(re.search(r"[ ().+/-]", text))


def _spans_of(tags: np.ndarray) -> Iterator[Span]:
    start = None
    for i, tag in enumerate([*tags.tolist(), 0]):
        if start is not None and tag != 2 + 2 * start[0]:
            yield start[0], start[1], i
            start = None
        if tag and tag % 2:
            start = (tag // 2, i)


def reconcile(found: set[Span], base: list[Span]) -> list[Span]:
    """Of overlapping spans the longest, then the first; none over a base span."""
    kept: list[Span] = []
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(taken[-1][1], e)
        else:
            taken.append((s, e))
    for span in sorted(found, key=lambda x: (x[1] - x[2], x[1], x[0])):
        at = bisect.bisect_left(taken, (span[2], span[2]))  # the first that starts behind this span
        if at == 0 or taken[at - 1][1] <= span[1]:
            taken.insert(at, (span[1], span[2]))
            kept.append(span)
    return kept


def _decoded(texts: list[str], todo: list[tuple[int, int, int, int, int]], tagger: Tagger) -> Iterator[tuple[tuple[int, int, int, int, int], np.ndarray]]:
    """Each window with its tags; windows of like width are decoded together."""
    todo = sorted(todo, key=lambda w: (w[2] - w[1], w))
    k = 0
    while k < len(todo):
        stop = k + 1
        while stop < len(todo) and (stop + 1 - k) * (todo[stop][2] - todo[stop][1]) <= ROWS * WINDOW:
            stop += 1
        part = todo[k:stop]
        x = np.zeros((len(part), part[-1][2] - part[-1][1]), dtype=np.int8)
        for row, (i, s, e, *_) in zip(x, part, strict=True):
            row[:e - s] = classes(texts[i][s:e])
        for window, tags in zip(part, tagger.decode(x.astype(np.int64), _barred()), strict=True):
            yield window, tags[:window[2] - window[1]]
        k = stop


def tagged_spans(texts: list[str], tagger: Tagger) -> list[set[Span]]:
    """Spans that the tagger finds in each text, before reconciling."""
    found: list[set[Span]] = [set() for _ in texts]
    whole: list[set[Span]] = [set() for _ in texts]  # those that no edge may have cut
    todo = [(i, s, e, s, e) for i, text in enumerate(texts) for s, e in {*windows(text), *addresses(text)}]
    while todo:
        cut = []
        for (i, s, e, low, high), tags in _decoded(texts, todo, tagger):
            for kind, a, b in _spans_of(tags):
                a, b = s + a, s + b
                fits = _plausible(kind, texts[i][a:b])
                if fits and not (a == s > 0 or b == e < len(texts[i])):
                    found[i].add((kind, a, b))
                first, last = _to_edges(texts[i], a, b, s, e)
                if first == s > 0 or last == e < len(texts[i]):
                    if first < high and low < last and _may_grow(kind, texts[i][first:last]):
                        cut.append((i, first, last, a, b))
                elif fits:
                    whole[i].add((kind, a, b))
        starts: dict[int, tuple[list[int], list[int]]] = {}  # of each text: starts of whole spans, and the furthest end so far
        for i in {c[0] for c in cut}:
            spans = sorted((s, e) for _, s, e in whole[i])
            starts[i] = [s for s, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
        left = []
        for i, low, high, a, b in cut:
            at = bisect.bisect_right(starts[i][0], a)
            if not at or starts[i][1][at - 1] < b:  # no whole span holds it
                left.append((i, low, high))
        todo = list(_wider(texts, left))  # each part is over twice as long as the one before, so this ends
    return found


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text, by kind, then start."""
    base = [base_spans(t) for t in texts]
    more = tagged_spans(texts, tagger) if tagger else [set() for _ in texts]
    return [(b, sorted([*b, *reconcile(m, b)])) for b, m in zip(base, more, strict=True)]


# ---- training

def _written(rng: np.random.Generator, words: list[str]) -> tuple[int | None, str]:
    """A written variant of a kind, or a look-alike (None)."""
    def num(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return words[rng.integers(len(words))].lower()

    def card(n: int) -> str:
        d = num(n - 1)
        return next(d + str(x) for x in range(10) if luhn(d + str(x)))

    pick = rng.integers(16)
    if pick < 3:
        at = [" @ ", "(at)", " [at] ", "@", " (at) ", "[at]"][rng.integers(6)]
        dot = [".", "[.]", " [dot] ", "."][rng.integers(4)]
        local = [".", "_", "", "-"][rng.integers(4)].join(word()[:WORD] for _ in range([1, 1, 2, 3, 4][rng.integers(5)]))
        labels = ["-".join(word()[:WORD] for _ in range([1, 1, 2, 3][rng.integers(4)])) for _ in range([1, 1, 2, 3][rng.integers(4)])]
        labels.append(["com", "org", "net", "edu", "de", "ac.uk"][rng.integers(6)])
        return 0, f"{local}{['.', '_', ''][rng.integers(3)]}{num(rng.integers(0, 3))}{at}{dot.join(labels)}"
    if pick < 5:
        return 1, ["{}.{}.{}.{}", "{}[.]{}[.]{}[.]{}", "{} . {} . {} . {}"][rng.integers(3)].format(*rng.integers(1, 256, 4))
    if pick < 7:
        d, sep = card(16), [".", "  ", "/", " - "][rng.integers(4)]
        return 2, sep.join(d[i:i + 4] for i in range(0, 16, 4))
    if pick < 10:
        return 3, [f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(2)} {num(3)} {num(4)}",
                   f"0{num(2)}/{num(3)} {num(4)}", f"+ {num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(4)}"][rng.integers(6)]
    return None, [num(rng.integers(1, 7)), f"20{num(2)}-0{rng.integers(1, 9)}-1{num(1)}", f"{num(2)}:{num(2)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}",
                  f"{num(1)},{num(3)},{num(3)}.{num(2)}", hashlib.md5(num(8).encode()).hexdigest(), f"@{word()}", f"{num(2)}%", num(12),
                  f"{word()}={num(3)}{word()}{num(3)}", f"{num(4)}-{num(4)}", f"{word()}@{word()}"][rng.integers(12)]


def training_rows(texts: list[str], seed: int = 7, written: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts with tags of their base spans, each again with
    ``written`` variants put between its words."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, list[Span]]] = []
    words = [w for t in texts for w in t[:2000].split() if w.isalpha()] or ["word"]
    for text in texts:
        base = base_spans(text)
        for s, e in windows(text):
            rows.append((text[s:e], [(k, max(a, s) - s, min(b, e) - s) for k, a, b in base if a < e and s < b]))
    for _ in range(written * max(len(texts), 500)):
        kind, made = _written(rng, words)
        before = " ".join(words[i] for i in rng.integers(0, len(words), 4))[-30:] + " "
        after = [" ", ".", ", ", "\n", " "][rng.integers(5)] + " ".join(words[i] for i in rng.integers(0, len(words), 4))[:20]
        rows.append((before + made + after, [] if kind is None else [(kind, len(before), len(before) + len(made))]))
    wide = min(max(len(text) for text, _ in rows), 2 * WINDOW)
    x, y = np.zeros((len(rows), wide), dtype=np.int64), np.zeros((len(rows), wide), dtype=np.int64)
    for i, (text, spans) in enumerate(rows):
        x[i, :len(text[:wide])] = classes(text[:wide])
        for k, a, b in spans:
            y[i, a:a + 1], y[i, a + 1:b] = 1 + 2 * k, 2 + 2 * k
    return x, y


def train(texts: list[str], steps: int = FIT_STEPS, seed: int = 7) -> Tagger:
    tagger = Tagger(N_CLASSES, N_TAGS, seed=seed)
    tagger.fit(*training_rows(texts, seed), steps=steps, seed=seed)
    return tagger


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two windows' width around the first, middle and last mark of each text."""
    for batch in batches:
        out = []
        for text in batch["text"]:
            marks = [m.start() for m in _MARK.finditer(text)]
            for at in sorted({marks[0], marks[len(marks) // 2], marks[-1]}) if marks else []:
                out.append(text[max(at - WINDOW, 0):at + WINDOW])
        yield pd.DataFrame({"text": pd.Series(out, dtype=object)})


def fit(docs: DataFrame, limit: int = FIT_DOCS, steps: int = FIT_STEPS) -> Tagger:
    """A tagger for ``docs(doc_id, text)``; ``limit`` documents at most reach the driver, as short contexts."""
    small_batches(docs.sparkSession)
    ids = docs.where(F.col("text").rlike(_MARK.pattern)).select("doc_id").distinct().orderBy(
        F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit)
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").where(F.col("text").rlike(_MARK.pattern))
    rows = picked.mapInPandas(lambda batches: _contexts(batches), "text string").distinct().orderBy("text").limit(6 * limit)
    return train(rows.toPandas()["text"].tolist(), steps)


# ---- over tables

def _written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _detect(tagger: Tagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], tagger)
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            columns.append(pa.array([hashlib.sha256(_written_spans(base).encode()).hexdigest() for base, _ in found]))
            columns.append(pa.array([_written_spans(spans) for _, spans in found]))
            columns.append(pa.array([len(spans) - len(base) for base, spans in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    return run


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card and
    n_phone (base spans of each kind), base_sha256 (of the base spans as
    kind:start:end, comma-joined), spans (base and added ones, written
    likewise, by kind, then start), n_added.

    Null and empty texts have no spans. Offsets are code points. Repeated
    rows each get their row; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _detect(tagger), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by [KIND] of its first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redact(tagger: Tagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = all_spans([t or "" for t in texts], tagger)
            new = pa.array([t and redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", new)
    return run


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in
    brackets; all columns and rows stay, a null text stays null."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact(tagger), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data redacted; n_chars follows the text."""
    out = redact(docs, fit(docs))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
