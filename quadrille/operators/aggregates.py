"""The set functions: COUNT, SUM, AVG, MIN, MAX, SAMPLE and GROUP_CONCAT.

Unbound and ill-typed members are left out. Spark combines partial results before the shuffle for all but DISTINCT ones
and GROUP_CONCAT, whose members are sorted so that the result is the same on every run."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import terms as R
from ..functions import values as V
from ..functions.values import Value
from ..terms import struct


def aggregate(name: str, v: Value, distinct: bool, separator: str = " ") -> Value:
    if name == "COUNT":
        cols = list(v.keys) if v.template else [v.col, v.lang] if v.kind == "lang" else [v.col]
        return Value("int", F.count_distinct(*cols) if distinct else F.count(cols[0]))
    if name == "SAMPLE":
        if v.kind in ("lang", "iri"):
            v = Value("term", V.to_term(v))
        return Value(v.kind, F.any_value(v.col, F.lit(True)))
    if name in ("MIN", "MAX"):
        return _extreme(name, v)
    if name == "GROUP_CONCAT":
        form = v.iri if v.kind == "iri" else v.col["v"] if v.kind == "term" else V.lexical(v)
        items = F.collect_set(form) if distinct else F.collect_list(form)
        return Value("str", F.array_join(F.array_sort(items), separator))
    if v.kind not in (*V.NUMERIC, "term"):
        return Value("int", F.lit(None).cast("bigint"))
    if v.kind == "term":
        return _dynamic(name, v, distinct)
    total = (F.sum_distinct if distinct else F.try_sum if v.kind == "int" else F.sum)(v.col)
    n = F.count_distinct(v.col) if distinct else F.count(v.col)
    zero = F.lit(0).cast(V.SQL_TYPES[v.kind])
    if name == "SUM":
        return Value(v.kind, F.coalesce(total.cast(V.SQL_TYPES[v.kind]), F.when(n == 0, zero)))
    kind = "dbl" if v.kind == "dbl" else "dec"
    if v.kind == "int":
        mean = V._apply("/", "int", total, n)
    else:
        mean = total / F.when(n > 0, n) if v.kind == "dbl" else V._apply("/", "dec", total, n.cast("decimal(38,18)"))
    return Value(kind, F.when(n == 0, F.lit(0).cast(V.SQL_TYPES[kind])).otherwise(mean.cast(V.SQL_TYPES[kind])))


def _extreme(name: str, v: Value) -> Value:
    if v.kind not in ("lang", "term", "iri"):
        return Value(v.kind, (F.min if name == "MIN" else F.max)(v.col))
    t = V.to_term(v)
    as_term = Value("term", t)
    n, at = V.number(as_term), V.instant(as_term)
    family = F.when(n.isNotNull(), 0).when(at.isNotNull(), 1).otherwise(2)
    key = F.when(t.isNotNull(), F.struct(t["k"].alias("k"), family.alias("f"), n.alias("n"), at.alias("a"), t["v"].alias("v"), t["dt"].alias("d")))
    return Value("term", (F.min_by if name == "MIN" else F.max_by)(t, key))


def _dynamic(name: str, v: Value, distinct: bool) -> Value:
    """Sum and mean of terms, in the widest type that occurs."""
    r, number = V.rank(v.col), V.number(v)
    member = F.when(number.isNotNull(), v.col)
    exact = F.when((r <= 2) & number.isNotNull(), v.col["v"].try_cast("decimal(38,18)"))
    if distinct:
        every = F.collect_set(F.when(number.isNotNull(), F.struct(number.alias("x"), exact.alias("e"))))
        total = F.aggregate(every, F.lit(0.0), lambda a, x: a + x["x"])
        sure = F.aggregate(every, F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + F.coalesce(x["e"], F.lit(0).cast("decimal(38,18)"))).cast("decimal(38,18)"))
        n = F.size(every)
    else:
        total, sure, n = F.sum(number), F.sum(exact), F.count(member)
    top = F.max(F.when(number.isNotNull(), r))
    if name == "AVG":
        total, sure = F.try_divide(total, n.cast("double")), V._apply("/", "dec", sure, n.cast("decimal(38,18)"))
        top = F.greatest(top, F.lit(2))
    form = F.when(top == 1, sure.cast("decimal(38,0)").cast("string")).when(top == 2, V.decimal_text(sure)).when(top > 2, total.cast("string")).when(n == 0, "0")
    kind = F.when(top == 2, R.DECIMAL).when(top == 3, R.FLOAT).when(top == 4, R.DOUBLE).otherwise(R.INTEGER)
    return Value("term", struct(R.K_LITERAL, form, "", "", kind))
