"""Algebra to DataFrame plans. Nothing runs here but the rounds of `+` and `*` paths; joins, filters and the
rest are left to Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import terms as R
from ..functions import library
from ..functions import values as V
from ..functions.values import Value
from ..operators.aggregates import aggregate
from ..operators.closure import checkpointed, closure
from ..operators.relation import Held, Relation, always, col, empty, join, minus, union, unit, written
from . import algebra as A


def _conjuncts(conditions: Sequence[object]) -> list[object]:
    out: list[object] = []
    for c in conditions:
        out += _conjuncts(c.args) if isinstance(c, A.Call) and c.name == "&&" else [c]
    return out


def _exists(e: object) -> list[A.Exists]:
    if isinstance(e, A.Exists):
        return [e]
    return [x for a in e.args for x in _exists(a)] if isinstance(e, A.Call) else []


def _swap(e: object, new: dict) -> object:
    """The expression with parts of it replaced."""
    if e in new:
        return new[e]
    return A.Call(e.name, tuple(_swap(a, new) for a in e.args)) if isinstance(e, A.Call) else e


class Compiler:
    def __init__(self, spark: SparkSession, graph: object):
        self.spark, self.source = spark, graph
        self.fresh = count()

    # expressions

    def value(self, e: object, env: dict[str, Value]) -> Value:
        if isinstance(e, A.Var):
            return env.get(e.name) or V.null()
        if isinstance(e, A.Call):
            if e.name == "BOUND":
                v = env.get(e.args[0].name)
                return Value("bool", v.bound if v else F.lit(False))
            return library.call(e.name, [self.value(a, env) for a in e.args])
        if isinstance(e, (A.Exists, A.Aggregate)):
            raise ValueError(f"{type(e).__name__} can't stand here")
        return V.constant(e)

    def filtered(self, r: Relation, conditions: Sequence[object], graph: object) -> Relation:
        plain: list[object] = []
        for c in _conjuncts(conditions):
            negated = isinstance(c, A.Call) and c.name == "!" and isinstance(c.args[0], A.Exists)
            if isinstance(c, A.Exists) or negated:
                e = c.args[0] if negated else c
                r = self.semi(r, e.pattern, e.negated != negated, graph)
            elif inner := _exists(c):
                marks = {}
                for e in inner:
                    r, name = self.mark(r, e, graph)
                    marks[e] = A.Var(name)
                kept = [n for n in r.held if n not in {v.name for v in marks.values()}]
                r = self.filtered(r, [_swap(c, marks)], graph).select(kept)
            else:
                plain.append(c)
        if not plain:
            return r
        env = r.environment()
        for c in plain:
            r = r.where(V.truth(self.value(c, env)))
        return r

    def _inner(self, r: Relation, pattern: object, graph: object) -> tuple[Relation, list[object]]:
        """The solutions of a pattern in EXISTS, and those of its filters that need the outer solution."""
        lifted: list[object] = []
        if isinstance(pattern, A.Filter):
            scope = set(A.variables(pattern.pattern))
            every = _conjuncts(pattern.conditions)
            lifted = [c for c in every if not _exists(c) and (A.used(c) - scope) & set(r.held)]
            rest = tuple(c for c in every if c not in lifted)
            pattern = A.Filter(pattern.pattern, rest) if rest else pattern.pattern
        return self.pattern(pattern, graph), lifted

    def semi(self, r: Relation, pattern: object, negated: bool, graph: object) -> Relation:
        other, lifted = self._inner(r, pattern, graph)
        both = lambda env: reduce(Column.__and__, [V.truth(self.value(c, env)) for c in lifted], F.lit(True))
        # unlike MINUS, a pattern without a variable in common decides for all rows: the extra condition says so
        return join(r, other, "anti" if negated else "semi", both if lifted else always if negated else None)

    def mark(self, r: Relation, e: A.Exists, graph: object) -> tuple[Relation, str]:
        """The relation with a boolean variable that says whether the pattern of EXISTS has a solution."""
        other, lifted = self._inner(r, e.pattern, graph)
        name = f".x{next(self.fresh)}"
        shared = [n for n in other.held if n in r.held]
        if lifted or any(n not in r.certain or n not in other.certain for n in shared):
            # number the rows, keep the numbers of those that match, and look them up
            row = f".r{next(self.fresh)}"
            base = Relation(checkpointed(r.df.withColumn(row, F.monotonically_increasing_id())), r.held | {row: Held("int")}, r.certain | {row})
            hit = self._hits(base, other, lifted).select([row])
            flag = hit.assign({name: Value("bool", F.lit(True))})
            out = join(base, flag, "left")
            out = out.select([n for n in out.held if n != row])
        else:
            keys = other.select(shared)
            keys = Relation(keys.df.distinct() if shared else keys.df.limit(1), keys.held, keys.certain)
            out = join(r, keys.assign({name: Value("bool", F.lit(True))}), "left")
        return out.assign({name: Value("bool", out.value(name).bound != F.lit(e.negated))}, [name]), name

    def _hits(self, base: Relation, other: Relation, lifted: list[object]) -> Relation:
        both = lambda env: reduce(Column.__and__, [V.truth(self.value(c, env)) for c in lifted], F.lit(True))
        return join(base, other, "semi", both if lifted else None)

    # patterns

    def pattern(self, p: object, graph: object = None) -> Relation:
        match p:
            case A.Unit():
                return unit(self.spark)
            case A.BGP(triples):
                return self.basic(triples, graph)
            case A.Join(a, b):
                return join(self.pattern(a, graph), self.pattern(b, graph))
            case A.LeftJoin(a, b, conditions):
                left, right = self.pattern(a, graph), self.pattern(b, graph)
                nested = [c for c in conditions if _exists(c)]
                if nested:
                    right = self.filtered(right, nested, graph)
                conditions = [c for c in conditions if c not in nested]
                if not conditions:
                    return join(left, right, "left")
                return join(left, right, "left", lambda env: reduce(Column.__and__, [V.truth(self.value(c, env)) for c in conditions]))
            case A.Union():
                parts = [p]
                while isinstance(parts[0], A.Union):
                    parts[:1] = [parts[0].left, parts[0].right]
                return union(*[self.pattern(x, graph) for x in parts])
            case A.Minus(a, b):
                return minus(self.pattern(a, graph), self.pattern(b, graph))
            case A.Graph(name, inner):
                return self.pattern(inner, name)
            case A.Filter(inner, conditions):
                return self.filtered(self.pattern(inner, graph), conditions, graph)
            case A.Extend(inner, var, e):
                r = self.pattern(inner, graph)
                return self.extended(r, var.name, e, graph)
            case A.Values(names, rows):
                return self.constants(names, rows)
            case A.SubSelect(query):
                return self.select(query, graph)
        raise ValueError(f"not a pattern: {p!r}")

    def extended(self, r: Relation, name: str, e: object, graph: object = None) -> Relation:
        marks = {}
        for x in _exists(e):
            r, mark = self.mark(r, x, graph)
            marks[x] = A.Var(mark)
        if isinstance(e, A.Var) and e.name in r.held:
            return r.assign({name: r.value(e.name)}, [name] if e.name in r.certain else [])
        v = self.value(_swap(e, marks) if marks else e, r.environment())
        out = r.assign({name: v}, [name] if v.const is not None else [])
        return out.select([n for n in out.held if n not in {m.name for m in marks.values()}]) if marks else out

    def computed(self, r: Relation, items: Sequence[tuple[str, object]], graph: object = None) -> Relation:
        """Several expressions under their names; those that don't use each other are one projection."""
        new: dict[str, Value] = {}
        env = r.environment()
        for name, e in items:
            if A.used(e) & set(new) or _exists(e) or isinstance(e, A.Var):
                r, new = (r.assign(new, [n for n, v in new.items() if v.const is not None]) if new else r), {}
                env = r.environment()
            if _exists(e) or isinstance(e, A.Var):
                r = self.extended(r, name, e, graph)
                env = r.environment()
            else:
                new[name] = self.value(e, env)
        return r.assign(new, [n for n, v in new.items() if v.const is not None]) if new else r

    def constants(self, names: Sequence[A.Var], rows: Sequence[tuple]) -> Relation:
        """VALUES as a table in the plan."""
        if not rows:
            return empty(self.spark, [v.name for v in names])
        held, fields, certain = {}, [[] for _ in rows], set()
        for i, v in enumerate(names):
            cells = [None if r[i] is None else V.constant(r[i]) for r in rows]
            kinds = {c.kind for c in cells if c is not None}
            kind = kinds.pop() if len(kinds) == 1 and not kinds & {"lang", "term"} else "term"
            kind = "term" if kind == "lang" else kind
            held[v.name] = Held(kind)
            if None not in cells:
                certain.add(v.name)
            kind_sql = R.TERM if kind == "term" else V.SQL_TYPES.get(kind, "string")
            for f, c in zip(fields, cells):
                x = F.lit(None) if c is None else V.to_term(c) if kind == "term" else c.col
                f.append(x.cast(kind_sql).alias(f"c{i}"))
        if not names:
            df = self.spark.range(len(rows)).select(F.lit(0).alias("#"))
            return Relation(df)
        df = self.spark.range(1).select(F.inline(F.array(*[F.struct(*f) for f in fields])))
        return Relation(df.select(*[F.col(f"c{i}").alias(v.name) for i, v in enumerate(names)]), held, frozenset(certain))

    def basic(self, triples: Sequence[A.Triple], graph: object) -> Relation:
        plain, parts = [], []
        for t in triples:
            if isinstance(t.p, A.PATHS):
                parts.append(t)
            else:
                plain.append(t)
        # sequences and inverses are patterns with hidden variables, so that they are joined like any other
        deep, excluded = [], {}
        for t in parts:
            for x in self.flattened(t):
                if isinstance(x.p, A.NotIn) and not x.p.backward:
                    v = A.Var(f".p{next(self.fresh)}")
                    excluded[v.name] = [i.value for i in x.p.forward]
                    x = A.Triple(x.s, v, x.o)
                deep.append(x)
        plain += [t for t in deep if not isinstance(t.p, A.PATHS)]
        out = self.source.bgp(plain, graph) if plain or not deep else None
        for name, values in excluded.items():
            if name in out.held:
                out = out.where(~V.native(out.value(name)).isin(*values)) if values else out
                out = out.select([n for n in out.held if n != name])
        for t in deep:
            if isinstance(t.p, A.PATHS):
                r = self.path(t.p, t.s, t.o, graph)
                out = r if out is None else join(out, r)
        return out

    def flattened(self, t: A.Triple) -> list[A.Triple]:
        if isinstance(t.p, A.Inverse):
            return self.flattened(A.Triple(t.o, t.p.path, t.s))
        if isinstance(t.p, A.Sequence):
            at, out = t.s, []
            for i, p in enumerate(t.p.parts):
                to = t.o if i == len(t.p.parts) - 1 else A.Var(f".p{next(self.fresh)}")
                out += self.flattened(A.Triple(at, p, to))
                at = to
            return out
        return [t]

    def path(self, p: object, s: object, o: object, graph: object) -> Relation:
        """Solutions of a path between two ends that aren't one triple pattern."""
        names = [x.name for x in (graph, s, o) if isinstance(x, A.Var)]
        match p:
            case A.Alternative(parts):
                return union(*[self.basic([A.Triple(s, x, o)], graph) for x in parts])
            case A.NotIn(forward, backward):
                sides = []
                for excluded, a, b in ((forward, s, o), (backward, o, s)):
                    if excluded or (a is s and not backward):
                        v = A.Var(f".p{next(self.fresh)}")
                        r = self.source.bgp([A.Triple(a, v, b)], graph)
                        if excluded and v.name in r.held:
                            r = r.where(~V.native(r.value(v.name)).isin(*[x.value for x in excluded]))
                        sides.append(r.select(names))
                return union(*sides)
            case A.Repeat(inner, least, many):
                return self.repeated(inner, least, many, s, o, graph)
        return self.basic([A.Triple(s, p, o)], graph)

    def repeated(self, inner: object, least: int, many: bool, s: object, o: object, graph: object) -> Relation:
        """`?`, `*` and `+`: distinct pairs. From a constant end only what it reaches is followed."""
        if isinstance(graph, A.Var):
            raise ValueError("a path with ?, * or + in GRAPH needs the graph's name")
        if isinstance(s, A.Var) and not isinstance(o, A.Var):
            return self.repeated(A.Inverse(inner), least, many, o, s, graph)
        a, b = A.Var(".a"), A.Var(".b")
        r = self.basic([A.Triple(a, inner, b)], graph)
        pairs = r.df.select(V.to_term(r.value(".a")).alias("a"), V.to_term(r.value(".b")).alias("b"))
        start = None
        if not isinstance(s, A.Var):
            start = self.spark.range(1).select(R.constant(s).alias("a"))
        if many:
            pairs = closure(pairs, start)
        elif start is not None:
            pairs = pairs.where(F.col("a") == R.constant(s))
        if least == 0:
            if start is not None:
                none = start.select("a", F.col("a").alias("b"))
            else:
                n = self.source.nodes(graph)
                every = V.to_term(n.value(".n"))
                none = n.df.select(every.alias("a"), every.alias("b"))
            pairs = pairs.unionByName(none)
        pairs = pairs.distinct()
        for name, x in (("a", s), ("b", o)):
            if not isinstance(x, A.Var):
                pairs = pairs.where(F.col(name) == R.constant(x))
        if isinstance(s, A.Var) and s == o:
            pairs = pairs.where("a = b")
        env = {x.name: Value("term", F.col(n)) for n, x in (("a", s), ("b", o)) if isinstance(x, A.Var)}
        held, cols = {}, {}
        for n, v in env.items():
            held[n], more = written(n, v)
            cols |= more
        return Relation(pairs.select(*[c.alias(n) for n, c in cols.items()]) if cols else pairs.select(F.lit(0).alias("#")), held, frozenset(env))

    # queries

    def select(self, q: A.Query, graph: object = None) -> Relation:
        r = self.pattern(q.where, graph)
        items = q.items if q.items is not None else [(A.Var(v), None) for v in A.projected(q)]
        order, having = list(q.order), list(q.having)
        wanted = {x: None for _, e in items if e is not None for x in A.aggregates(e)}
        wanted |= {x: None for e, _ in order for x in A.aggregates(e)} | {x: None for e in having for x in A.aggregates(e)}
        if q.group is not None or wanted:
            new = {x: A.Var(f".g{i}") for i, x in enumerate(wanted)}
            r = self.grouped(r, q.group or [], new)
            items = [(v, None if e is None else _swap(e, new)) for v, e in items]
            order = [(_swap(e, new), d) for e, d in order]
            r = self.filtered(r, [_swap(e, new) for e in having], graph)
        r = self.computed(r, [(v.name, e) for v, e in items if e is not None], graph)
        names = list(dict.fromkeys(v.name for v, _ in items))
        keys: list[Column] = []
        if order:
            env = r.environment()
            sorts = [(V.sort_columns(self.value(e, env), d), d) for e, d in order]
            if q.distinct:
                r, keys = self._distinct_sorted(r, names, order)
            else:
                keys = [c for cols, _ in sorts for c in cols]
                r = Relation(r.df.orderBy(*keys), r.held, r.certain)
        if not (order and q.distinct):
            r = r.select(names)
            if q.distinct:
                r = Relation(r.df.distinct(), r.held, r.certain)
        df = r.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Relation(df, r.held, r.certain)

    def _distinct_sorted(self, r: Relation, names: list[str], order: list) -> tuple[Relation, list[Column]]:
        """DISTINCT with ORDER BY: equal solutions are one, at the place of the first of them."""
        if all(A.used(e) <= set(names) for e, _ in order):
            out = r.select(names)
            out = Relation(out.df.distinct(), out.held, out.certain)
        else:
            hidden, held = {}, {}
            for i, (e, _) in enumerate(order):
                held[f".o{i}"], cols = written(f".o{i}", Value("term", V.to_term(self.value(e, r.environment()))))
                hidden |= cols
            wide = r.df.select(*map(col, r.columns(names)), *[c.alias(n) for n, c in hidden.items()])
            first = [aggregate("MAX" if d else "MIN", Value("term", col(f".o{i}")), False).col.alias(f".o{i}") for i, (_, d) in enumerate(order)]
            df = wide.groupBy(*map(col, r.columns(names))).agg(*first)
            out = Relation(df, {n: r.held[n] for n in names} | held, r.certain & set(names))
            order = [(A.Var(f".o{i}"), d) for i, (_, d) in enumerate(order)]
        env = out.environment()
        keys = [c for e, d in order for c in V.sort_columns(self.value(e, env), d)]
        return Relation(out.df.orderBy(*keys), out.held, out.certain).select(names), keys

    def grouped(self, r: Relation, group: list, wanted: dict[A.Aggregate, A.Var]) -> Relation:
        names = []
        for i, (v, e) in enumerate(group):
            name = v.name if v is not None else e.name if isinstance(e, A.Var) else f".k{i}"
            if not (isinstance(e, A.Var) and e.name == name and name in r.held):
                r = self.extended(r, name, e)
            names.append(name)
        env = r.environment()
        held = {n: r.held[n] for n in names}
        cols: dict[str, Column] = {}
        for x, v in wanted.items():
            if x.arg is None:
                every = [F.struct(*map(col, r.columns()))] if r.held else [F.lit(1)]
                value = Value("int", F.count_distinct(*every) if x.distinct else F.count(F.lit(1)))
            else:
                value = aggregate(x.name, self.value(x.arg, env), x.distinct, x.separator)
            held[v.name], more = written(v.name, value)
            cols |= more
        by = [col(c) for n in names for c in held[n].columns(n)]
        aggs = [c.alias(n) for n, c in cols.items()]
        if by:
            df = r.df.groupBy(*by).agg(*aggs) if aggs else r.df.select(*by).distinct()
        else:
            df = r.df.agg(*(aggs or [F.count(F.lit(1)).alias("#")]))
            df = df if not group else df.where(F.lit(True))
        return Relation(df, held, r.certain & set(names))

    def construct(self, q: A.Query) -> Relation:
        """?s ?p ?o of the template for each solution, without what is no triple; each triple once. The template is
        filled in one pass over the solutions, so that its blank nodes are fresh for each and shared within one."""
        r = self.modified(q)
        env = r.environment()
        has_blank = any(isinstance(x, R.BNode) for t in q.template for x in (t.s, t.o))
        df = r.df.withColumn("#n", F.monotonically_increasing_id()) if has_blank else r.df

        def term(x: object) -> Column:
            if isinstance(x, R.BNode):
                return R.struct(R.K_BNODE, F.concat(F.lit(x.label + "x"), F.col("`#n`").cast("string")))
            return V.to_term(self.value(x, env))

        rows = [F.struct(term(t.s).alias("s"), term(t.p).alias("p"), term(t.o).alias("o")) for t in q.template]
        held = {n: Held("term") for n in "spo"}
        if not rows:
            return empty(self.spark, list("spo"))
        if not q.order and q.limit is None and not q.offset:
            # solutions are narrow and triples wide: a task makes its triples distinct in memory, so tasks are made even before
            df = df.repartition(*[F.col(f"`{c}`") for c in df.columns])
        df = df.select(F.explode(F.array(*rows)).alias("t")).select("t.*").where("s is not null and p.k = 1 and o is not null and s.k in (1, 2)")
        return Relation(df.distinct(), held, frozenset("spo"))

    def modified(self, q: A.Query) -> Relation:
        """Solutions with the modifiers of a query that projects nothing."""
        whole = A.Query("SELECT", q.where, [(A.Var(v), None) for v in A.variables(q.where)], limit=q.limit, offset=q.offset, order=q.order, group=q.group, having=q.having)
        if q.group is not None:
            whole.items = [(v or e, None) for v, e in q.group if v is not None or isinstance(e, A.Var)]
        return self.select(whole) if whole.items else self.pattern(q.where)

    def describe(self, q: A.Query) -> Relation:
        """All triples whose subject is a resource that is listed, or bound to a variable that is."""
        parts: list[Relation] = []
        fixed = [x for x in q.targets if isinstance(x, R.IRI)]
        for x in fixed:
            parts.append(self.source.bgp([A.Triple(x, A.Var(".p"), A.Var(".o"))]).assign({".s": V.constant(x)}, [".s"]))
        if any(isinstance(x, A.Var) for x in q.targets):
            r = self.modified(q)
            for x in q.targets:
                if isinstance(x, A.Var) and x.name in r.held:
                    parts += self.source.about(r, x.name)
        if not parts:
            return empty(self.spark, list("spo"))
        all_parts = [p.df.select(*[V.to_term(p.value("." + n)).alias(n) for n in "spo"]) for p in parts if {".s", ".p", ".o"} <= set(p.held)]
        df = reduce(lambda a, b: a.unionByName(b), all_parts).where("s is not null and p is not null and o is not null").distinct()
        return Relation(df, {n: Held("term") for n in "spo"}, frozenset("spo"))
