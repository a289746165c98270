"""RDF triples (B10) of graph nodes, and their N-Triples lines.

Every key of a node becomes a triple: scalars are literals with the data type
of their JSON value, ``@type`` gives ``rdf:type``, an object is the node that
its ``@id`` names or else a blank node with triples of its own, and a list
gives each of its items. Objects nest to any depth: one expression takes
``DEPTH`` levels at once, and objects below them are the next round's nodes,
until a round leaves none.

Blank node ids are a hash of source, block, position and path, so they are
stable under task retries (never ``monotonically_increasing_id``). ``distinct``
then gives RDF set semantics: equal literal triples of one IRI collapse, blank
nodes of different copies do not. A round is one projection and one explode;
one aggregation follows them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..session import cut_lineage

SCHEMA = "http://schema.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"
DEPTH = 3

_TRIPLE = ["s", "p", "o", "o_kind", "o_type"]
_T = "array<struct<s:string,p:string,o:string,o_kind:string,o_type:string,path:string,rest:variant>>"


def _bnode(*path: Column) -> Column:
    return F.concat(F.lit("_:b"), F.substring(F.sha2(F.concat_ws("|", *path), 256), 1, 32))


def _triple(s: Column, p: Column, o: Column, kind: str | Column, type_: Column | None = None, path: Column | None = None,
            rest: Column | None = None) -> Column:
    """A triple; with ``rest``, its object's fields are still to be read, from there."""
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), (F.lit(kind) if isinstance(kind, str) else kind).alias("o_kind"),
                    (F.lit(None).cast("string") if type_ is None else type_).alias("o_type"),
                    (F.lit(None).cast("string") if path is None else path).alias("path"),
                    (F.lit(None).cast("variant") if rest is None else rest).alias("rest"))


def _iri(name: Column) -> Column:
    """A name of the schema vocabulary; names that are IRIs already stay."""
    return F.when(name.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), name).otherwise(F.concat(F.lit(SCHEMA), name))


def _items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def _data_type(value: Column) -> Column:
    return once(F.schema_of_variant(value), _xsd_type)


def _xsd_type(kind: Column) -> Column:
    return (F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(XSD + "integer")).when(kind.startswith("DECIMAL"), F.lit(XSD + "decimal"))
             .when(kind.isin("DOUBLE", "FLOAT"), F.lit(XSD + "double")).when(kind == "BOOLEAN", F.lit(XSD + "boolean")))


def _of_value(s: Column, key: Column, value: Column, path: Column, depth: int) -> Column:
    """The triples of one value. What several of them use, such as the object's
    name and path, is evaluated once (``once``)."""
    def of_object(o):
        first = _triple(s, _iri(key), o["child"], o["kind"], **({} if depth else {"path": o["path"], "rest": value}))
        return F.concat(F.array(first), _of_fields(o["child"], o["fields"], o["path"], depth - 1)) if depth else F.array(first)

    def nested(fields):
        def named(o):
            return once(F.struct(fields.alias("fields"), o["path"].alias("path"), F.coalesce(o["ref"], _bnode(o["path"])).alias("child"),
                                 F.when(o["ref"].isNotNull(), F.lit("iri")).otherwise(F.lit("bnode")).alias("kind")), of_object)
        return once(F.struct(F.try_variant_get(value, '$["@id"]', "string").alias("ref"), path.alias("path")), named)

    def scalar(text):
        return F.when(text.isNotNull(), F.array(_triple(s, _iri(key), text, "literal", _data_type(value))))

    def type_(text):
        return F.when(text.isNotNull(), F.array(_triple(s, F.lit(RDF_TYPE), _iri(text), "iri")))

    text = F.try_variant_get(value, "$", "string")
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    of_key = once(fields, lambda f: F.when(f.isNotNull(), nested(f)).otherwise(once(text, scalar)))
    return F.coalesce(F.when(key == "@type", once(text, type_)).otherwise(of_key), F.array().cast(_T))


def _of_fields(s: Column, fields: Column, path: Column, depth: int) -> Column:
    entries = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin("@id", "@context"))
    return F.flatten(F.transform(entries, lambda e: F.flatten(F.transform(
        _items(e["value"]), lambda x, i: _of_value(s, e["key"], x, F.concat_ws("|", path, e["key"], i.cast("string")), depth)))))


def to_triples(nodes: DataFrame) -> DataFrame:
    """Node rows (src, block, pos, node VARIANT) -> distinct triples
    (s, p, o, o_kind, o_type); a node without ``@id`` is a blank node. Each
    round is written, as the next one reads the objects that it leaves."""
    path = F.concat_ws("|", F.col("src").cast("string"), F.col("block").cast("string"), F.col("pos").cast("string"))
    subject = F.coalesce(F.try_variant_get("node", '$["@id"]', "string"), _bnode(path, F.lit("")))
    level = nodes.select(subject.alias("s"), path.alias("path"), "node")
    fields = F.try_variant_get("node", "$", "map<string,variant>")
    done = None
    while True:
        rows = cut_lineage(level.select(F.inline_outer(_of_fields(F.col("s"), fields, F.col("path"), DEPTH - 1))).where(F.col("p").isNotNull()), "triples")
        done = rows.select(*_TRIPLE) if done is None else done.unionAll(rows.select(*_TRIPLE))
        level = rows.where("rest IS NOT NULL").select(F.col("o").alias("s"), "path", F.col("rest").alias("node"))
        if level.isEmpty():
            return done.distinct()


#: Characters that an N-Triples IRI may not hold, and a literal's escapes.
_IRI_ESCAPES = {c: f"\\u{ord(c):04X}" for c in "\\<>\"{}|^` \n\r\t"}
_TEXT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r"}


def _escaped(value: Column, escapes: dict[str, str]) -> Column:
    for char, escape in escapes.items():  # the backslash comes first
        value = F.replace(value, F.lit(char), F.lit(escape))
    return value


def _iri_term(value: Column) -> Column:
    return F.concat(F.lit("<"), _escaped(value, _IRI_ESCAPES), F.lit(">"))


def to_ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple (every N-Triples file is valid Turtle)."""
    s, o, kind = F.col("s"), F.col("o"), F.col("o_kind")
    text = F.concat(F.lit('"'), _escaped(o, _TEXT_ESCAPES), F.lit('"'))
    if "o_type" in triples.columns:
        text = F.concat(text, F.coalesce(F.concat(F.lit("^^"), _iri_term(F.col("o_type"))), F.lit("")))
    line = F.concat_ws(" ", F.when(s.startswith("_:"), s).otherwise(_iri_term(s)), _iri_term(F.col("p")),
                       F.when(kind == "iri", _iri_term(o)).when(kind == "bnode", o).otherwise(text), F.lit("."))
    return triples.select("p", line.alias("value"))
