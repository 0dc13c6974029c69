"""Values of expressions: a column with what is known of its type when the plan is made.

Where the type is known (a mapped double, a computed integer) operators are plain Spark expressions on native
columns, which reach the scan. Else a value is a term struct and its type is looked at row by row.
An error is null everywhere, as is an unbound variable."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import struct

#: Static kinds: native column, datatype.
DATATYPES = {"bool": R.BOOLEAN, "int": R.INTEGER, "dec": R.DECIMAL, "dbl": R.DOUBLE, "str": R.STRING, "dt": R.DATETIME, "date": R.DATE, "lang": R.LANG_STRING}
SQL_TYPES = {"bool": "boolean", "int": "bigint", "dec": "decimal(38,18)", "dbl": "double", "str": "string", "dt": "timestamp_ntz", "date": "date"}
NUMERIC = {"int": 1, "dec": 2, "dbl": 4}
_BY_RANK = {1: "int", 2: "dec", 3: "dbl", 4: "dbl"}


@dataclass(frozen=True)
class Template:
    """IRIs made of a prefix and key columns; hashed where the key is the whole row."""

    prefix: str
    kinds: tuple[str, ...]
    hashed: bool = False

    def render(self, keys: list[Column]) -> Column:
        if self.hashed:
            tail = F.sha2(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256)
            return F.when(F.coalesce(*[k.isNotNull() for k in keys[:1]]), F.concat(F.lit(self.prefix), tail))
        # one null key makes it null
        return F.concat(F.lit(self.prefix), *[x for i, k in enumerate(keys) for x in ([F.lit("-")] if i else []) + [k.cast("string")]])

    def match(self, iri: str, keys: list[Column]) -> Column | None:
        """The condition on the keys for the IRI; None where no keys make it."""
        if not iri.startswith(self.prefix):
            return None
        tail = iri[len(self.prefix) :]
        if self.hashed:
            return self.render(keys) == iri
        parts = tail.split("-") if len(keys) > 1 else [tail]
        if len(parts) != len(keys) or not all(p.isdigit() and (p == "0" or p[0] != "0") and int(p) < 2**63 for p in parts):
            return None
        out = keys[0] == int(parts[0])
        for k, p in zip(keys[1:], parts[1:]):
            out = out & (k == int(p))
        return out


@dataclass(frozen=True)
class Value:
    kind: str  # bool int dec dbl str dt date lang iri term
    col: Column | None
    lang: Column | None = None
    template: Template | None = None
    keys: tuple[Column, ...] = ()
    const: object = None  # the term, where it is known

    @property
    def iri(self) -> Column:
        return self.template.render(list(self.keys)) if self.template else self.col

    @property
    def bound(self) -> Column:
        return self.keys[0].isNotNull() if self.template else self.col.isNotNull()


def null() -> Value:
    return Value("term", F.lit(None).cast(R.TERM))


def decimal_text(c: Column) -> Column:
    """The shortest form with a point, as 1.5 and 2.0."""
    text = c.cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")


def timestamp_text(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(micros, "0+$", "")))


def lexical(v: Value) -> Column:
    """The lexical form of a literal of a static kind; a constant keeps its own."""
    if isinstance(v.const, R.Literal):
        return F.lit(v.const.value)
    return {"dec": decimal_text, "dt": timestamp_text}.get(v.kind, lambda c: c.cast("string"))(v.col)


def to_term(v: Value) -> Column:
    if v.kind == "term":
        return v.col
    if v.const is not None:
        return R.constant(v.const)
    if v.kind == "iri":
        return struct(R.K_IRI, v.iri)
    if v.kind == "lang":
        return struct(R.K_LITERAL, v.col, F.lower(v.lang), "", R.LANG_STRING)
    return struct(R.K_LITERAL, lexical(v), "", "", DATATYPES[v.kind])


def constant(t: object) -> Value:
    """A constant; of a static kind if its lexical form is one of that kind."""
    if isinstance(t, R.IRI):
        return Value("iri", F.lit(t.value), const=t)
    if isinstance(t, R.Literal):
        if t.lang:
            return Value("term", R.constant(t), const=t) if t.direction else Value("lang", F.lit(t.value), F.lit(t.lang.lower()), const=t)
        if t.datatype == R.STRING:
            return Value("str", F.lit(t.value), const=t)
        try:
            if t.datatype == R.INTEGER and abs(int(t.value)) < 2**63 and t.value == str(int(t.value)):
                return Value("int", F.lit(int(t.value)).cast("bigint"), const=t)
            if t.datatype == R.DECIMAL and len(t.value.strip("+-").replace(".", "")) <= 18:
                return Value("dec", F.lit(t.value).cast("decimal(38,18)"), const=t)
            if t.datatype == R.DOUBLE and t.value.lower().strip("+-") not in ("inf", "nan", "infinity"):
                return Value("dbl", F.lit(float(t.value)), const=t)
        except ValueError:
            pass
        if t.datatype == R.BOOLEAN and t.value in ("true", "false"):
            return Value("bool", F.lit(t.value == "true"), const=t)
    return Value("term", R.constant(t), const=t)


def _is_literal(t: Column) -> Column:
    return t["k"] == R.K_LITERAL


def rank(t: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; null for what isn't numeric."""
    dt = t["dt"]
    return F.when(dt.isin(*R.INTEGERS), 1).when(dt == R.DECIMAL, 2).when(dt == R.FLOAT, 3).when(dt == R.DOUBLE, 4)


def _double(v: Column) -> Column:
    return F.when(F.trim(v) == "INF", F.lit(float("inf"))).when(F.trim(v) == "-INF", F.lit(float("-inf"))).otherwise(v.try_cast("double"))


def number(v: Value) -> Column:
    """The value as a double, null where it is no number."""
    if v.kind in NUMERIC:
        return v.col.cast("double")
    if v.kind != "term":
        return F.lit(None).cast("double")
    return F.when(_is_literal(v.col) & rank(v.col).isNotNull(), _double(v.col["v"]))


def instant(v: Value) -> Column:
    """The value as a timestamp in UTC, null where it is no dateTime."""
    if v.kind == "dt":
        return v.col.cast("timestamp_ntz")
    if v.kind != "term":
        return F.lit(None).cast("timestamp_ntz")
    # a zone is applied; without one the time is taken as UTC
    text = v.col["v"]
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    shift = F.regexp_extract(zoned, r"([+-]\d{2}:\d{2})$", 1)
    local = F.regexp_replace(zoned, r"[+-]\d{2}:\d{2}$", "").try_cast("timestamp_ntz")
    minutes = F.substring(shift, 2, 2).try_cast("int") * 60 + F.substring(shift, 5, 2).try_cast("int")
    minutes = F.when(shift == "", 0).when(F.startswith(shift, F.lit("-")), -minutes).otherwise(minutes)
    utc = local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when(v.col["dt"] == R.DATETIME, utc)


def day(v: Value) -> Column:
    if v.kind == "date":
        return v.col
    if v.kind != "term":
        return F.lit(None).cast("date")
    return F.when(v.col["dt"] == R.DATE, v.col["v"].try_cast("date"))


def boolean(v: Value) -> Column:
    """The value of a boolean literal, null for others."""
    if v.kind == "bool":
        return v.col
    if v.kind != "term":
        return F.lit(None).cast("boolean")
    t = v.col["v"]
    return F.when(v.col["dt"] == R.BOOLEAN, F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False))


def text(v: Value) -> Column:
    """The lexical form of a string literal, with or without language; null for others."""
    if v.kind in ("str", "lang"):
        return v.col
    if v.kind != "term":
        return F.lit(None).cast("string")
    return F.when(_is_literal(v.col) & v.col["dt"].isin(R.STRING, R.LANG_STRING, R.DIR_LANG_STRING), v.col["v"])


def tag(v: Value) -> Column:
    """The language of a literal, '' for none."""
    if v.kind == "lang":
        return F.lower(v.lang)
    if v.kind == "term":
        return F.when(_is_literal(v.col), v.col["l"])
    return F.when(v.bound, F.lit("")) if v.kind != "iri" else F.lit(None).cast("string")


def like(model: Value, col: Column) -> Value:
    """A string with the language of another."""
    if model.kind == "lang":
        return Value("lang", col, model.lang)
    if model.kind == "term":
        t = model.col
        return Value("term", struct(R.K_LITERAL, F.when(text(model).isNotNull(), col), t["l"], t["d"], t["dt"]))
    return Value("str", col)


def truth(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind in NUMERIC:
        return (v.col != 0) & ~F.isnan(v.col) if v.kind == "dbl" else v.col != 0
    if v.kind in ("str", "lang"):
        return v.col != ""
    if v.kind != "term":
        return F.lit(None).cast("boolean")
    n = number(v)
    numeric = _is_literal(v.col) & rank(v.col).isNotNull()
    # an ill-formed number or boolean is false
    return (
        F.when(v.col["dt"] == R.BOOLEAN, F.coalesce(boolean(v), F.lit(False)))
        .when(numeric, F.coalesce((n != 0) & ~F.isnan(n), F.lit(False)))
        .otherwise(text(v) != "")
    )


def _widest(a: Value, b: Value) -> str:
    return a.kind if NUMERIC[a.kind] >= NUMERIC[b.kind] else b.kind


def _comparable(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Native columns to compare, where the kinds are static and have an order in common."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        # a whole number against a double is compared as such, so that the scan gets a plain literal
        kind = _widest(a, b)
        conv = lambda v: v.col if v.kind == kind else (F.lit(float(v.const.value)) if kind == "dbl" and v.const is not None else v.col.cast(SQL_TYPES[kind]))
        return conv(a), conv(b)
    for kinds in (("str",), ("bool",), ("dt",), ("date",)):
        if a.kind in kinds and b.kind in kinds:
            return a.col, b.col
    for x, y, f in ((a, b, lambda p, q: (p, q)), (b, a, lambda p, q: (q, p))):
        # a dateTime constant against a native column
        if x.kind == "dt" and y.const is not None and isinstance(y.const, R.Literal) and y.const.datatype == R.DATETIME:
            return f(x.col, instant(y))
        if x.kind == "date" and y.const is not None and isinstance(y.const, R.Literal) and y.const.datatype == R.DATE:
            return f(x.col, day(y))
    return None


def equal(a: Value, b: Value) -> Column:
    """`=`: by value for numbers, booleans, dates and times, else by term; null for literals that can't be told apart."""
    if (both := _comparable(a, b)) is not None:
        return both[0] == both[1]
    if a.kind == "iri" and b.kind == "iri":
        return same_iri(a, b)
    if a.kind == "lang" and b.kind == "lang":
        return (a.col == b.col) & (F.lower(a.lang) == F.lower(b.lang))
    if {a.kind, b.kind} == {"str", "lang"}:
        return F.when(a.bound & b.bound, F.lit(False))
    x, y = to_term(a), to_term(b)
    va, vb = Value("term", x), Value("term", y)
    literals = _is_literal(x) & _is_literal(y)
    known = lambda t: t["dt"].isin(R.STRING, R.LANG_STRING, R.DIR_LANG_STRING, R.BOOLEAN, R.DATETIME, R.DATE, R.DOUBLE, R.FLOAT, R.DECIMAL, *R.INTEGERS)
    na, nb = number(va), number(vb)
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when(~literals, x == y).otherwise(
        F.when(na.isNotNull() & nb.isNotNull(), na == nb)
        .when(instant(va).isNotNull() & instant(vb).isNotNull(), instant(va) == instant(vb))
        .when(boolean(va).isNotNull() & boolean(vb).isNotNull(), boolean(va) == boolean(vb))
        .when(x == y, F.lit(True))
        .when(known(x) & known(y) & ((text(va).isNotNull() & text(vb).isNotNull()) | (day(va).isNotNull() & day(vb).isNotNull())), F.lit(False))
    )


def same_iri(a: Value, b: Value) -> Column:
    """Equality of IRIs; on the keys, where both have a template."""
    if a.template and b.template:
        if a.template != b.template:
            return F.when(a.bound & b.bound, F.lit(False))
        out = a.keys[0] == b.keys[0]
        for x, y in zip(a.keys[1:], b.keys[1:]):
            out = out & x.eqNullSafe(y)
        return out
    for x, y in ((a, b), (b, a)):
        if x.template and isinstance(y.const, R.IRI):
            found = x.template.match(y.const.value, list(x.keys))
            return F.when(x.bound, F.lit(False)) if found is None else found
    return a.iri == b.iri


def same_term(a: Value, b: Value) -> Column:
    if a.kind == "iri" and b.kind == "iri":
        return same_iri(a, b)
    if a.kind == b.kind and a.kind not in ("term", "lang", "dec"):
        return a.col == b.col
    return to_term(a) == to_term(b)


def compared(a: Value, b: Value) -> list[tuple[Column, Column]]:
    """The columns whose equality same_term() is made of, for rows to be laid out by."""
    if a.kind == b.kind == "iri":
        return list(zip(a.keys, b.keys)) if a.template and a.template == b.template else [(a.iri, b.iri)]
    return [(a.col, b.col) if a.kind == b.kind and a.kind not in ("term", "lang", "dec") else (to_term(a), to_term(b))]


def less(op: str, a: Value, b: Value) -> Column:
    """`<`, `<=`, `>` and `>=`; null for what has no order."""
    do = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
    if (both := _comparable(a, b)) is not None:
        return do(*both)
    na, nb, ta, tb = number(a), number(b), text(a), text(b)
    plain = F.coalesce(tag(a), F.lit("")) == F.coalesce(tag(b), F.lit(""))
    return (
        F.when(na.isNotNull() & nb.isNotNull(), do(na, nb))
        .when(ta.isNotNull() & tb.isNotNull() & plain, do(ta, tb))
        .when(instant(a).isNotNull() & instant(b).isNotNull(), do(instant(a), instant(b)))
        .when(day(a).isNotNull() & day(b).isNotNull(), do(day(a), day(b)))
        .when(boolean(a).isNotNull() & boolean(b).isNotNull(), do(boolean(a), boolean(b)))
    )


def _apply(op: str, kind: str, x: Column, y: Column) -> Column:
    """Arithmetic in one kind; overflow and division by zero are null, but for doubles, which have infinities."""
    if kind == "dbl":
        if op == "/":  # IEEE: the dialect's own division by zero is an error
            zero = F.when(x == 0, F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))
            return F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))
        return {"+": x + y, "-": x - y, "*": x * y}[op]
    if kind == "int" and op != "/":
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    if kind == "int":
        return F.try_divide(x.cast("decimal(20,0)"), y.cast("decimal(20,0)")).cast("decimal(38,18)")
    if op in "+-":
        out = (F.try_add if op == "+" else F.try_subtract)(x, y).try_cast("decimal(38,18)")
    elif op == "*":
        out = F.try_multiply(x.try_cast("decimal(19,9)"), y.try_cast("decimal(19,9)")).try_cast("decimal(38,18)")
    else:
        out = F.try_divide(x.try_cast("decimal(20,6)"), y.try_cast("decimal(20,6)")).try_cast("decimal(38,18)")
    wide = {"+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q, "/": F.try_divide}[op](x.cast("double"), y.cast("double"))
    return F.coalesce(out, wide.try_cast("decimal(38,18)"))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.kind in NUMERIC and b.kind in NUMERIC:
        kind = _widest(a, b)
        x, y = (v.col if v.kind == kind else v.col.cast(SQL_TYPES[kind]) for v in (a, b))
        return Value("dec" if kind == "int" and op == "/" else kind, _apply(op, kind, x, y))
    if any(v.kind not in (*NUMERIC, "term") for v in (a, b)):
        return null()
    x, y = to_term(a), to_term(b)
    r = F.when(rank(x).isNotNull() & rank(y).isNotNull(), F.greatest(rank(x), rank(y)))
    whole = lambda t, kind: t["v"].try_cast(SQL_TYPES[kind])
    ints = _apply(op, "int", whole(x, "int"), whole(y, "int"))
    decs = decimal_text(_apply(op, "dec", whole(x, "dec"), whole(y, "dec")))
    dbls = _apply(op, "dbl", _double(x["v"]), _double(y["v"])).cast("string")
    v = F.when(r == 1, decimal_text(ints) if op == "/" else ints.cast("string")).when(r == 2, decs).otherwise(F.when(r.isNotNull(), dbls))
    kind = F.when(r == 1, R.DECIMAL if op == "/" else R.INTEGER).when(r == 2, R.DECIMAL).when(r == 3, R.FLOAT).otherwise(R.DOUBLE)
    return Value("term", struct(R.K_LITERAL, v, "", "", kind))


def cast(v: Value, datatype: str) -> Value:
    """xsd:TYPE(v): null where the form doesn't fit."""
    if v.kind == "iri" or (v.kind == "term" and datatype == R.STRING):
        src = v.iri if v.kind == "iri" else F.when(v.col["k"].isin(R.K_IRI, R.K_LITERAL), v.col["v"])
    else:
        src = F.when(_is_literal(v.col), v.col["v"]) if v.kind == "term" else lexical(v)
    if datatype == R.STRING:
        return Value("str", src)
    if v.kind == "iri":
        return null()
    flag = boolean(v)
    form = F.trim(src)
    if datatype == R.BOOLEAN:
        as_number = (number(v) != 0) & ~F.isnan(number(v))
        return Value("bool", F.coalesce(flag, as_number, F.when(form.isin("true", "1"), True).when(form.isin("false", "0"), False)))
    bit = F.when(flag.isNotNull(), flag.cast("int"))
    if datatype in R.INTEGERS:
        if v.kind in NUMERIC:
            out = v.col.try_cast("bigint")
        else:
            out = F.coalesce(bit.cast("bigint"), F.when(form.rlike(r"^[+-]?\d+$"), form.try_cast("bigint")), number(v).try_cast("bigint"))
        return Value("int", out) if datatype == R.INTEGER else Value("term", struct(R.K_LITERAL, out.cast("string"), "", "", datatype))
    if datatype == R.DECIMAL:
        if v.kind in NUMERIC:
            return Value("dec", v.col.try_cast("decimal(38,18)"))
        plain = F.when(form.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), form.try_cast("decimal(38,18)"))
        return Value("dec", F.coalesce(bit.cast("decimal(38,18)"), plain, number(v).try_cast("decimal(38,18)")))
    if datatype in (R.DOUBLE, R.FLOAT):
        out = v.col.cast("double") if v.kind in NUMERIC else F.coalesce(bit.cast("double"), _double(form))
        return Value("dbl", out) if datatype == R.DOUBLE else Value("term", struct(R.K_LITERAL, out.cast("float").cast("string"), "", "", R.FLOAT))
    if datatype == R.DATETIME:
        if v.kind == "dt":
            return v
        start = F.when(form.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"), form)
        date = F.when(day(v).isNotNull(), F.concat(day(v).cast("string"), F.lit("T00:00:00")))
        return Value("term", struct(R.K_LITERAL, F.coalesce(date, start), "", "", R.DATETIME))
    if datatype == R.DATE:
        at = F.coalesce(day(v), instant(v).cast("date"), F.when(form.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(form, 1, 10).try_cast("date")))
        return Value("date", at)
    return Value("term", struct(R.K_LITERAL, src, "", "", datatype))


def sort_columns(v: Value, descending: bool) -> list[Column]:
    """Order by value: unbound, blank nodes, IRIs, literals; among these numbers, times, then the rest by form."""
    if v.kind == "term":
        t = v.col
        kind = F.when(t.isNull(), 0).when(t["k"] == R.K_BNODE, 1).when(t["k"] == R.K_IRI, 2).when(t["k"] == R.K_LITERAL, 3).otherwise(4)
        family = F.when(number(v).isNotNull(), 0).when(instant(v).isNotNull(), 1).otherwise(2)
        cols = [kind, family, number(v), instant(v), t["v"], t["dt"], t["l"]]
    elif v.kind == "iri":
        cols = [v.iri]
    elif v.kind == "lang":
        cols = [v.col, v.lang]
    else:
        cols = [v.col]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def native(v: Value) -> Column:
    """As a plain Spark column: numbers, strings, booleans and times as such, IRIs and forms of unknown type as strings."""
    if v.kind == "iri":
        return v.iri
    return v.col["v"] if v.kind == "term" else v.col
