"""RDF terms: small Python values for the driver and the readers, and their struct form in DataFrames.

In a DataFrame a term is struct<k,v,l,d,dt>: k is the kind, v the IRI, label or lexical form, l the language,
d the base direction, dt the datatype IRI. Absent parts are '', so that equal structs are equal terms. An
unbound variable is a null struct. A triple term is kept as its canonical text in v."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
STRING, INTEGER, DECIMAL, DOUBLE, FLOAT, BOOLEAN = (XSD + x for x in ("string", "integer", "decimal", "double", "float", "boolean"))
DATETIME, DATE, TIME, DURATION = (XSD + x for x in ("dateTime", "date", "time", "dayTimeDuration"))
LANG_STRING, DIR_LANG_STRING, TYPE, REIFIES = RDF + "langString", RDF + "dirLangString", RDF + "type", RDF + "reifies"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
#: Datatypes whose values are integers.
INTEGERS = tuple(XSD + x for x in "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split())

K_IRI, K_BNODE, K_LITERAL, K_TRIPLE = 1, 2, 3, 5

TERM = T.StructType([T.StructField("k", T.ByteType()), *[T.StructField(n, T.StringType()) for n in ("v", "l", "d", "dt")]])
QUADS = T.StructType([T.StructField("s", TERM, False), T.StructField("p", T.StringType(), False), T.StructField("o", TERM, False), T.StructField("g", TERM, True)])


class IRI(NamedTuple):
    value: str

    @property
    def struct(self) -> tuple:
        return (K_IRI, self.value, "", "", "")


class BNode(NamedTuple):
    label: str

    @property
    def struct(self) -> tuple:
        return (K_BNODE, self.label, "", "", "")


class Literal(NamedTuple):
    value: str
    lang: str = ""
    direction: str = ""
    datatype: str = STRING

    @property
    def struct(self) -> tuple:
        kind = (DIR_LANG_STRING if self.direction else LANG_STRING) if self.lang else self.datatype
        return (K_LITERAL, self.value, self.lang.lower(), self.direction.lower(), kind)


class TripleTerm(NamedTuple):
    s: object
    p: object
    o: object

    @property
    def struct(self) -> tuple:
        return (K_TRIPLE, n3(self), "", "", "")


class Quad(NamedTuple):
    s: object
    p: object
    o: object
    g: object = None

    def row(self) -> tuple:
        return (self.s.struct, self.p.value, self.o.struct, None if self.g is None else self.g.struct)


_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
_ODD = re.compile(r'[\x00-\x1f"\\\x7f\ufffe\uffff]')


def escaped(text: str) -> str:
    """A lexical form as it stands between the quotes of a canonical line."""
    return _ODD.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", text)


def n3(term: object) -> str:
    """The canonical N-Triples form of a term."""
    if isinstance(term, IRI):
        return f"<{term.value}>"
    if isinstance(term, BNode):
        return f"_:{term.label}"
    if isinstance(term, TripleTerm):
        return f"<<( {n3(term.s)} {n3(term.p)} {n3(term.o)} )>>"
    out = f'"{escaped(term.value)}"'
    if term.lang:
        return out + f"@{term.lang.lower()}" + (f"--{term.direction.lower()}" if term.direction else "")
    return out if term.datatype == STRING else f"{out}^^<{term.datatype}>"


def from_struct(row: tuple | None) -> object:
    """The Python value of a term struct; a triple term is parsed."""
    if row is None:
        return None
    k, v, lang, direction, kind = row
    if k == K_IRI:
        return IRI(v)
    if k == K_BNODE:
        return BNode(v)
    if k == K_TRIPLE:
        from .sources.turtle import parse_term

        return parse_term(v)
    return Literal(v, lang, direction, STRING if lang else kind)


def struct(k: int | Column, v: Column | str, lang: Column | str = "", direction: Column | str = "", datatype: Column | str = "") -> Column:
    """A term column; null where v is."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    v = as_col(v)
    kind = (k if isinstance(k, Column) else F.lit(k)).cast("tinyint")
    parts = [kind.alias("k"), v.alias("v"), as_col(lang).alias("l"), as_col(direction).alias("d"), as_col(datatype).alias("dt")]
    return F.when(v.isNotNull(), F.struct(*parts))


def constant(term: object) -> Column:
    return struct(*term.struct)


def n3_column(t: Column) -> Column:
    """The canonical N-Triples form of a term column, without leaving the JVM."""
    v = t["v"]
    for raw, short in (("\\", "\\\\"), *[x for x in _SHORT.items() if x[0] != "\\"]):
        v = F.replace(v, F.lit(raw), F.lit(short))
    for code in (*range(8), 11, *range(14, 32), 127, 0xFFFE, 0xFFFF):
        v = F.replace(v, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    v = F.when(t["v"].rlike(_ODD.pattern), v).otherwise(t["v"])
    tag = F.when(t["l"] != "", F.concat(F.lit("@"), t["l"], F.when(t["d"] != "", F.concat(F.lit("--"), t["d"])).otherwise("")))
    kind = F.when(t["dt"] == STRING, "").otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    literal = F.concat(F.lit('"'), v, F.lit('"'), F.coalesce(tag, kind))
    return (
        F.when(t["k"] == K_IRI, F.concat(F.lit("<"), t["v"], F.lit(">")))
        .when(t["k"] == K_BNODE, F.concat(F.lit("_:"), t["v"]))
        .when(t["k"] == K_TRIPLE, t["v"])
        .when(t["k"] == K_LITERAL, literal)
    )
