"""The named functions of SPARQL 1.1 on values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import struct
from . import values as V
from .values import Value


def _str(v: Value) -> Value:
    if v.kind == "iri":
        return Value("str", v.iri)
    if v.kind == "term":
        return Value("str", F.when(v.col["k"].isin(R.K_IRI, R.K_LITERAL), v.col["v"]))
    return Value("str", V.lexical(v))


def _lang(v: Value) -> Value:
    if v.kind == "lang":
        return Value("str", v.lang)
    return Value("str", V.tag(v))


def _datatype(v: Value) -> Value:
    if v.kind == "iri":
        return V.null()
    if v.kind == "term":
        return Value("iri", F.when(v.col["k"] == R.K_LITERAL, v.col["dt"]))
    return Value("iri", F.when(v.bound, F.lit(V.DATATYPES[v.kind])))


def _langmatches(tag: Value, wanted: Value) -> Value:
    t, w = F.lower(V.text(tag)), F.lower(V.text(wanted))
    return Value("bool", F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))))


def _kind(*kinds: int):
    static = {R.K_IRI: {"iri"}, R.K_LITERAL: {*V.DATATYPES}}
    native = set().union(*(static.get(k, set()) for k in kinds))

    def test(v: Value) -> Value:
        if v.kind == "term":
            return Value("bool", v.col["k"].isin(*kinds))
        return Value("bool", F.when(v.bound, F.lit(v.kind in native)))

    return test


def _is_numeric(v: Value) -> Value:
    if v.kind == "term":
        fits = F.when(v.col["dt"].isin(*R.INTEGERS), v.col["v"].rlike(r"^[+-]?\d+$")).otherwise(V.number(v).isNotNull())
        return Value("bool", F.when(v.bound, F.coalesce(V.rank(v.col).isNotNull() & fits, F.lit(False))))
    return Value("bool", F.when(v.bound, F.lit(v.kind in V.NUMERIC)))


def _numeric(f_int, f_dec, f_dbl):
    """A function of one number that keeps its type."""

    def apply(v: Value) -> Value:
        if v.kind in V.NUMERIC:
            return Value(v.kind, {"int": f_int, "dec": f_dec, "dbl": f_dbl}[v.kind](v.col))
        if v.kind != "term":
            return V.null()
        t, r = v.col, V.rank(v.col)
        form = (
            F.when(r == 1, f_int(t["v"].try_cast("bigint")).cast("string"))
            .when(r == 2, V.decimal_text(f_dec(t["v"].try_cast("decimal(38,18)"))))
            .when(r > 2, f_dbl(V.number(v)).cast("string"))
        )
        return Value("term", struct(R.K_LITERAL, form, "", "", t["dt"]))

    return apply


def _whole(x: Column, f) -> Column:
    """A rounding of doubles, for which the dialect would give integers that overflow."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


_abs = _numeric(F.abs, F.abs, F.abs)
_ceil = _numeric(lambda x: x, lambda x: F.ceil(x).cast("decimal(38,18)"), lambda x: _whole(x, F.ceil))
_floor = _numeric(lambda x: x, lambda x: F.floor(x).cast("decimal(38,18)"), lambda x: _whole(x, F.floor))
# halves go up: -2.5 is -2
_round = _numeric(lambda x: x, lambda x: F.floor(x + F.lit("0.5").cast("decimal(2,1)")).cast("decimal(38,18)"), lambda x: _whole(x, lambda y: F.floor(y + 0.5)))


def _strlen(v: Value) -> Value:
    return Value("int", F.char_length(V.text(v)).cast("bigint"))


def _substr(v: Value, start: Value, length: Value | None = None) -> Value:
    """Characters from round(start), counted from 1, as many as there are before round(start) + round(length)."""
    first = F.floor(V.number(start) + 0.5).cast("int")
    if length is None:
        return V.like(v, F.substring(V.text(v), F.greatest(first, F.lit(1)), F.lit(2**31 - 1)))
    stop = first + F.floor(V.number(length) + 0.5).cast("int")
    begin = F.greatest(first, F.lit(1))
    return V.like(v, F.substring(V.text(v), begin, F.greatest(stop - begin, F.lit(0))))


def _concat(*vs: Value) -> Value:
    if not vs:
        return Value("str", F.lit(""))
    col = F.concat(*map(V.text, vs))
    if all(v.kind == "str" for v in vs):
        return Value("str", col)
    tags = [V.tag(v) for v in vs]
    same = tags[0] != ""
    for t in tags[1:]:
        same = same & (t == tags[0])
    lang = F.when(same, tags[0]).otherwise("")
    return Value("term", struct(R.K_LITERAL, col, lang, "", F.when(same, R.LANG_STRING).otherwise(R.STRING)))


def _fits(a: Value, b: Value) -> Column:
    """Whether b may be looked for in a: it has no language, or a's."""
    if b.kind == "str":
        return F.lit(True)
    return (V.tag(b) == "") | (V.tag(a) == V.tag(b))


def _test(f):
    return lambda a, b: Value("bool", f(V.text(a), V.text(b)) if b.kind == "str" else F.when(_fits(a, b), f(V.text(a), V.text(b))))


def _part(before: bool):
    def apply(a: Value, b: Value) -> Value:
        t, w = V.text(a), V.text(b)
        at = F.when(w == "", 1).otherwise(F.position(w, t))
        cut = F.substring(t, F.lit(1), at - 1) if before else F.substring(t, at + F.char_length(w), F.lit(2**31 - 1))
        found = F.when(_fits(a, b), at > 0)
        if a.kind == "str":
            return Value("str", F.when(found, cut).otherwise(F.when(~found, F.lit(""))))
        # without a match the result is a plain empty string
        return Value("term", F.when(found, V.to_term(V.like(a, cut))).when(~found, R.constant(R.Literal(""))))

    return apply


def _pattern(pattern: Value, flags: Value | None) -> Column:
    """A Java regular expression with the flags i, m, s, x and q; an unknown flag makes it null."""
    if flags is None:
        return V.text(pattern)
    f, p = V.text(flags), V.text(pattern)
    if isinstance(flags.const, R.Literal) and isinstance(pattern.const, R.Literal):
        text, given = pattern.const.value, flags.const.value
        if set(given) - set("imsxq"):
            return F.lit(None).cast("string")
        if "q" in given:
            text = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)
        inline = "".join(c for c in dict.fromkeys(given) if c != "q")
        return F.lit((f"(?{inline})" if inline else "") + text)
    quoted = F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    inline = F.regexp_replace(f, "q", "")
    body = F.when(F.contains(f, F.lit("q")), quoted).otherwise(p)
    return F.when(f.rlike("^[imsxq]*$"), F.concat(F.when(inline == "", "").otherwise(F.concat(F.lit("(?"), inline, F.lit(")"))), body))


def _regex(v: Value, pattern: Value, flags: Value | None = None) -> Value:
    return Value("bool", F.regexp_like(V.text(v), _pattern(pattern, flags)))


def _replace(v: Value, pattern: Value, by: Value, flags: Value | None = None) -> Value:
    return V.like(v, F.regexp_replace(V.text(v), _pattern(pattern, flags), V.text(by)))


def _encode(v: Value) -> Value:
    """Percent-encode all but unreserved characters; the built-in encodes for forms."""
    e = F.url_encode(V.text(v))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return Value("str", e)


def _field(f):
    return lambda v: Value("int", f(_local(v)).cast("bigint"))


def _local(v: Value) -> Column:
    """A dateTime as written, without its zone."""
    if v.kind in ("dt", "date"):
        return v.col
    form = F.when(v.col["dt"].isin(R.DATETIME, R.DATE), v.col["v"]) if v.kind == "term" else F.lit(None).cast("string")
    return F.regexp_replace(form, r"(Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")


def _seconds(v: Value) -> Value:
    at = _local(v)
    return Value("dec", (F.unix_micros(at.cast("timestamp")) % F.lit(60_000_000)).cast("decimal(38,18)") / F.lit(1_000_000).cast("decimal(7,0)")) if v.kind in ("dt", "date") else Value(
        "dec", F.regexp_extract(F.when(at.isNotNull(), v.col["v"]), r":(\d{2}(?:\.\d+)?)(?:Z|[+-]\d{2}:\d{2})?$", 1).try_cast("decimal(38,18)")
    )


def _zone(v: Value) -> Column:
    form = F.when(v.col["dt"] == R.DATETIME, v.col["v"]) if v.kind == "term" else F.when(v.bound, F.lit("")) if v.kind == "dt" else F.lit(None).cast("string")
    return F.regexp_extract(form, r"(Z|[+-]\d{2}:\d{2})$", 1)


def _timezone(v: Value) -> Value:
    z = _zone(v)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    body = F.concat(F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    form = F.when((z == "Z") | z.isin("+00:00", "-00:00"), "PT0S").when(F.startswith(z, F.lit("-")), F.concat(F.lit("-"), body)).when(z != "", body)
    return Value("term", struct(R.K_LITERAL, form, "", "", R.DURATION))


def _digest(f):
    def apply(v: Value) -> Value:
        plain = F.when(V.tag(v) == "", V.text(v)) if v.kind != "str" else v.col
        return Value("str", f(plain))

    return apply


def _iri(v: Value) -> Value:
    return v if v.kind == "iri" else Value("iri", F.when(V.to_term(v)["k"] == R.K_IRI, V.to_term(v)["v"]).otherwise(V.text(v)))


def _strlang(v: Value, lang: Value) -> Value:
    plain = F.when(V.tag(v) == "", V.text(v))
    return Value("lang", F.when(V.text(lang) != "", plain), F.lower(V.text(lang)))


def _strdt(v: Value, kind: Value) -> Value:
    if kind.kind != "iri":
        return V.null()
    return Value("term", struct(R.K_LITERAL, F.when(V.tag(v) == "", V.text(v)), "", "", kind.iri))


def _bnode(v: Value | None = None) -> Value:
    """A fresh node for each solution, or one for each string in it."""
    label = F.replace(F.uuid(), F.lit("-"), F.lit("")) if v is None else F.md5(V.text(v))
    return Value("term", struct(R.K_BNODE, F.concat(F.lit("n"), label)))


def common_kind(vs: list[Value]) -> tuple[str, list[Column]]:
    """A kind that holds all of the values, and their columns in it."""
    kinds = {v.kind for v in vs}
    if kinds <= set(V.NUMERIC):
        # numbers of several kinds keep each their own
        if len(kinds) == 1:
            return vs[0].kind, [v.col for v in vs]
    elif len(kinds) == 1 and not kinds & {"lang", "term"}:
        return vs[0].kind, [V.native(v) for v in vs]
    return "term", [V.to_term(v) for v in vs]


def _coalesce(*vs: Value) -> Value:
    if not vs:
        return V.null()
    kind, cols = common_kind(list(vs))
    return Value(kind, F.coalesce(*cols))


def _if(test: Value, a: Value, b: Value) -> Value:
    kind, (x, y) = common_kind([a, b])
    c = V.truth(test)
    return Value(kind, F.when(c, x).when(~c, y))


def _in(v: Value, *options: Value) -> Value:
    """Null only where nothing is equal and some comparison is an error."""
    if not options:
        return Value("bool", F.when(v.bound, F.lit(False)))
    native = v.kind in ("str", "int") and all(o.kind == v.kind and o.const is not None for o in options)
    if native:
        raw = [int(o.const.value) if v.kind == "int" else o.const.value for o in options]
        return Value("bool", v.col.isin(*raw))
    tests = [V.equal(v, o) for o in options]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return Value("bool", out)


TABLE = {
    "STR": _str, "LANG": _lang, "DATATYPE": _datatype, "LANGMATCHES": _langmatches, "ISIRI": _kind(R.K_IRI), "ISBLANK": _kind(R.K_BNODE),
    "ISLITERAL": _kind(R.K_LITERAL), "ISTRIPLE": _kind(R.K_TRIPLE), "ISNUMERIC": _is_numeric, "ABS": _abs, "CEIL": _ceil, "FLOOR": _floor, "ROUND": _round,
    "STRLEN": _strlen, "SUBSTR": _substr, "UCASE": lambda v: V.like(v, F.upper(V.text(v))), "LCASE": lambda v: V.like(v, F.lower(V.text(v))),
    "CONCAT": _concat, "CONTAINS": _test(F.contains), "STRSTARTS": _test(F.startswith), "STRENDS": _test(F.endswith), "STRBEFORE": _part(True),
    "STRAFTER": _part(False), "REGEX": _regex, "REPLACE": _replace, "ENCODE_FOR_URI": _encode, "YEAR": _field(F.year), "MONTH": _field(F.month),
    "DAY": _field(F.dayofmonth), "HOURS": _field(F.hour), "MINUTES": _field(F.minute), "SECONDS": _seconds, "TZ": lambda v: Value("str", _zone(v)),
    "TIMEZONE": _timezone, "NOW": lambda: Value("term", struct(R.K_LITERAL, F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), "", "", R.DATETIME)),
    "RAND": lambda: Value("dbl", F.rand()), "UUID": lambda: Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid())), "STRUUID": lambda: Value("str", F.uuid()),
    "MD5": _digest(F.md5), "SHA1": _digest(F.sha1), "SHA256": _digest(lambda c: F.sha2(c, 256)), "SHA384": _digest(lambda c: F.sha2(c, 384)),
    "SHA512": _digest(lambda c: F.sha2(c, 512)), "IRI": _iri, "BNODE": _bnode, "STRLANG": _strlang, "STRDT": _strdt, "COALESCE": _coalesce, "IF": _if,
    "SAMETERM": lambda a, b: Value("bool", V.same_term(a, b)), "IN": _in,
}


def call(name: str, args: list[Value]) -> Value:
    """An operator, function or cast of values."""
    if name in ("=", "!="):
        e = V.equal(*args)
        return Value("bool", e if name == "=" else ~e)
    if name in ("<", "<=", ">", ">="):
        return Value("bool", V.less(name, *args))
    if name in ("&&", "||"):
        a, b = map(V.truth, args)
        return Value("bool", a & b if name == "&&" else a | b)
    if name == "!":
        return Value("bool", ~V.truth(args[0]))
    if name in ("+", "-", "*", "/"):
        return V.arithmetic(name, *args)
    if name == "NEGATE":
        return V.arithmetic("-", V.constant(R.Literal("0", datatype=R.INTEGER)), args[0])
    if name == "PLUS":
        return V.arithmetic("+", V.constant(R.Literal("0", datatype=R.INTEGER)), args[0])
    if name in TABLE:
        return TABLE[name](*args)
    if name.startswith(R.XSD) and len(args) == 1:
        return V.cast(args[0], name)
    raise ValueError(f"no such function: {name}")
