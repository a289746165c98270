"""Cross-tokenizer alignment, native in Arrow.

Each text is encoded by a byte-level BPE (A, after a space) and by a piece BPE
(B, which puts the space itself). No token of either reaches over a single
space between two words, so the distinct words of a chunk are encoded and the
texts' token lists taken from theirs. In a worker everything between the two
encoders and the result is Arrow: token lists are flattened with their parent
indices, segmented cumulative sums of token bytes give every token's end in
its document, an Acero hash join on document-end keys finds the ends that both
share and those of one side only, and ``Table.group_by`` counts the linked id
pairs of each document and, over them, of each chunk. Spark merges these
partial counts to corpus-wide ones and joins them to the documents' pairs.

Every end that either side has closes exactly one link: between the tokens of
A and B that cover the byte before it. A group ends where both end.

The counts are as many as the id pairs that occur; they are broadcast under
``session.BROADCAST_MAX_BYTES`` only, else the join shuffles and AQE splits
frequent pairs. The vocabulary files (a few MB) travel with the tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetrina.llm.text import byte_set, chunks, small_batches, utf8
from vetrina.session import bounded_broadcast, cut_lineage

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"

#: How byte-level BPE splits a text before its merges (a fixed pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The quick encoder's patterns give up on longer runs of white space.
LONG_SPACE = re.compile(r"\s{50000}")

#: Bytes of text that are aligned at once (one text at least); larger ones share more words.
CHUNK = 4 << 20

_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
_OUT = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("groups_sha256", pa.string()), ("links", _PAIRS), ("counts", _PAIRS)])


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder of a byte-level BPE file; ``tokens`` has the bytes of each id."""

    def __init__(self, content: bytes):
        self._content, self._slow = content, None
        spec = json.loads(content)
        model, byte = spec["model"], _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        tokens = {i: t for t, i in ranks.items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.tokens = pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.binary())
        pre = spec["pre_tokenizer"] or {}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = (pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not spec["normalizer"]
                 and all(model["vocab"][m] == 256 + i for i, m in enumerate(merged)))
        self._quick = None
        if plain:  # ids in the order of the merges: the same vocabulary as ranks
            import tiktoken

            self._quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text after a space."""
        texts = [" " + t for t in texts]
        return [self._quick.encode_ordinary(t) if self._quick and not (len(t) > 50000 and LONG_SPACE.search(t)) else self._whole(t) for t in texts]

    def _whole(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._content.decode())
            self._slow.encode_special_tokens = True  # their strings in a text are ordinary text
        return self._slow.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """Encoder of a sentence-piece model; ``tokens`` has the bytes of each id."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = m = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.tokens = pa.array([bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                                for i in range(m.vocab_size())], pa.binary())
        if any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.vocab_size())):
            raise ValueError("a piece of this model reaches over a space; its words can't be encoded one by one")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


#: Bytes of printable ASCII, the neighbours that make a space a word's edge; as are letters from U+00C0 to U+00FF.
_PRINTED = ~byte_set((0x21, 0x7E))
_LATIN = 0xC3


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts (those without a word's edge are one word), and
    the n + 1 positions where each text's begin."""
    data, offsets = utf8(texts)
    space = np.flatnonzero(data[1:-1] == 0x20) + 1
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = data[space - 1], data[space + 1]
    before = _PRINTED[before] | ((data[space - 2] == _LATIN) & (before >= 0x80) & ~edge[space - 1] & (space > 1))
    space = space[before & (_PRINTED[after] | (after == _LATIN)) & ~edge[space] & ~edge[space + 1]]
    keep = np.ones(len(data), dtype=bool)
    keep[space] = False
    start = np.sort(np.concatenate((offsets[:-1][np.diff(offsets) > 0], space + 1)), kind="stable")
    kept = np.concatenate((start - np.searchsorted(space, start), [len(data) - len(space)])).astype(np.int64)
    each = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(kept), pa.py_buffer(data[keep])])
    return each.dictionary_encode(), np.searchsorted(start, offsets)


def _encoded(found: tuple[pa.DictionaryArray, np.ndarray], strings: list[str], encoder: ByteBpe | PieceBpe) -> pa.ListArray:
    """The texts' token lists, from those of their distinct words."""
    codes, first = found
    ids = pa.array(encoder.encode(strings), pa.list_(pa.int32())).take(codes.indices)
    sizes = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))))
    return _lists(pc.list_flatten(ids), sizes[first])


def _lists(flat: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _joined(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The bytes of each document's tokens."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), b"")


def _ends(ids: pa.ListArray, tokens: pa.Array, side: str) -> pa.Table:
    """(key, position) of each token of the documents: key has the document
    in the upper and the token's end in the lower 32 bits."""
    flat, parent = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.cast(pc.binary_length(tokens).take(flat), pa.int64()))
    first = pc.list_value_length(ids)
    before = pc.subtract(pc.cumulative_sum(pc.cast(first, pa.int64())), first)  # tokens in front of each document
    base = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(before)
    end = pc.subtract(total, base.take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent, 32), end), side: pa.array(np.arange(len(flat)))})


def align(texts: pa.Array, a: ByteBpe, b: PieceBpe) -> tuple[pa.RecordBatch, pa.Table]:
    """Per text a row of ``_OUT`` (``counts`` null), and (pair, n): in how many
    of these texts each id pair is linked."""
    plain = texts.fill_null("")
    found = words(plain)
    strings = found[0].dictionary.to_pylist()
    want = pc.binary_join_element_wise(pa.scalar(b" "), plain.cast(pa.binary()), pa.scalar(b""))
    ids = [_encoded(found, strings, e) for e in (a, b)]
    good = pc.and_(pc.greater(pc.binary_length(plain), 0), pc.and_(*(pc.equal(_joined(x, e.tokens), want) for x, e in zip(ids, (a, b), strict=True))))
    left, right = (pa.concat_arrays([x.filter(good)]) for x in ids)
    n_docs = len(left)
    flat_a, flat_b = pc.list_flatten(left), pc.list_flatten(right)

    met = _ends(left, a.tokens, "a").join(_ends(right, b.tokens, "b"), keys="key", join_type="full outer", use_threads=False).sort_by("key")
    met = met.combine_chunks()
    at_a, at_b = (met[c].combine_chunks() for c in ("a", "b"))
    doc = pc.shift_right(met["key"], 32).combine_chunks()
    both = pc.and_(pc.is_valid(at_a), pc.is_valid(at_b))
    # the next end of each side belongs to the token that covers the byte before this one
    link_a, link_b = flat_a.take(pc.fill_null_backward(at_a)), flat_b.take(pc.fill_null_backward(at_b))
    pair = pc.bit_wise_or(pc.shift_left(pc.cast(link_a, pa.int64()), 32), pc.cast(link_b, pa.int64()))

    sides = []
    for flat, at in ((flat_a, at_a), (flat_b, at_b)):
        cuts = np.concatenate(([0], at.filter(both).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
        sides.append(pc.binary_join(_lists(pc.cast(flat, pa.string()), cuts), ","))
    groups = np.bincount(doc.filter(both).to_numpy(), minlength=n_docs)
    spelled = pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), np.concatenate(([0], np.cumsum(groups)))), ";")

    per_doc = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    counts = pa.table({"pair": per_doc["pair"]}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
    kinds = np.bincount(per_doc["doc"].to_numpy(), minlength=n_docs)
    links = _lists(pa.StructArray.from_arrays([per_doc[c].combine_chunks() for c in ("pair", "count_all")], names=["pair", "n"]),
                   np.concatenate(([0], np.cumsum(kinds))))

    # back to all texts: those without tokens have zeros
    place = pa.array(np.where(good, np.cumsum(good) - 1, 0), pa.int64(), mask=~np.asarray(good))
    numbers = [pc.list_value_length(left), pc.list_value_length(right), pa.array(groups), pa.array(np.bincount(doc.to_numpy(), minlength=n_docs))]
    rows = [pc.fill_null(pc.cast(x, pa.int64()).take(place), 0) for x in numbers]
    sha = pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in spelled], pa.string()).take(place).fill_null("")
    out = pa.RecordBatch.from_arrays([*rows, sha, links.take(place).cast(_PAIRS), pa.nulls(len(texts), _PAIRS)], schema=_OUT)
    return out, counts


_encoders: dict[str, tuple[ByteBpe, PieceBpe]] = {}


def _scan(a_file: bytes, b_file: bytes):
    """mapInArrow function: a row of each document, and of each chunk one with its partial counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = hashlib.sha256(a_file + b_file).hexdigest()
        if name not in _encoders:
            _encoders[name] = ByteBpe(a_file), PieceBpe(b_file)
        for batch in chunks(batches, "text", CHUNK):
            rows, counts = align(batch.column("text"), *_encoders[name])
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *rows.columns], names=["doc_id", *_OUT.names])
            part = pa.StructArray.from_arrays([counts[c].combine_chunks() for c in ("pair", "n")], names=["pair", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ids.type), *(pa.nulls(1, f.type) for f in _OUT if f.name != "counts"), _lists(part, np.array([0, len(part)])).cast(_PAIRS)],
                names=["doc_id", *_OUT.names])
    return run


def scan(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """The written table of one pass over ``docs(doc_id, text)``: a row per
    document (row: a number of its own, doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, links: its id pairs with their occurrences) and a row per
    chunk (counts: pairs and documents). A pair is A's id * 2 ** 32 + B's."""
    small_batches(docs.sparkSession)
    with open(a_path, "rb") as x, open(b_path, "rb") as y:
        files = x.read(), y.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = "array<struct<pair: long, n: long>>"
    found = docs.select("doc_id", "text").mapInArrow(
        _scan(*files), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {pairs}, counts {pairs}")
    return cut_lineage(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(scanned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents the id pair is linked, and
    whether no other pair of its A id has more. An A id has as many pairs as B
    has ids at most."""
    counts = scanned.where("counts IS NOT NULL").select(F.inline("counts")).groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == most)


def alignment(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_a and n_b (tokens), n_groups
    (between byte offsets where tokens of both end), n_links (overlapping
    token pairs), n_best (links whose pair is in the most documents for its A
    id, ties included), count_sum (documents that hold the link's pair, over
    all links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and those that the tokens don't spell, have zeros
    and an empty ``groups_sha256``. Strings of special tokens are ordinary
    text. Repeated rows count, and get rows, each for itself. Other columns
    are ignored. ``a_path`` and ``b_path`` are read on the driver.
    """
    scanned = scan(docs, a_path, b_path)
    counts = cut_lineage(pair_counts(scanned), "pairs")
    rows = scanned.where("counts IS NULL")
    linked = rows.select("row", F.inline("links")).join(bounded_broadcast(counts), "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("links", "counts").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
