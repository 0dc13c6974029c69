"""What patterns are matched against: a table of quads, or relational tables seen through a mapping.

Both answer `bgp`: the solutions of triple patterns in the default graph (None), a named graph, or any (a variable)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as R
from ..functions import values as V
from ..functions.values import Template, Value
from ..operators.relation import Relation, empty, join, ordered, union, unit, written
from ..plans.algebra import Triple, Var
from . import mapping as M


#: A table is crowded about another that it points to if its files are so many times larger.
CROWDED = 16


def _names(triples: Sequence[Triple], graph: object) -> list[str]:
    return list(dict.fromkeys(x.name for t in triples for x in (graph, t.s, t.p, t.o) if isinstance(x, Var)))


def _relation(df: DataFrame, env: dict[str, Value]) -> Relation:
    held, cols = {}, {}
    for n, v in env.items():
        held[n], more = written(n, v)
        cols |= more
    return Relation(df.select(*[c.alias(n) for n, c in cols.items()]) if cols else df.select(F.lit(0).alias("#")), held, frozenset(env))


class QuadGraph:
    """Quads in a DataFrame of the schema QUADS. Constants become filters on nested fields, which reach parquet."""

    def __init__(self, quads: DataFrame):
        self.quads, self.spark = quads, quads.sparkSession

    def dataset(self, default: list[R.IRI], named: list[R.IRI]) -> QuadGraph:
        """The graphs of FROM as the default graph, and those of FROM NAMED."""
        g = F.col("g.v")
        merged = self.quads.where(g.isin(*[x.value for x in default])).withColumn("g", F.lit(None).cast(R.TERM)).dropDuplicates() if default else None
        kept = self.quads.where(g.isin(*[x.value for x in named])) if named else None
        parts = [x for x in (merged, kept) if x is not None]
        return QuadGraph(reduce(DataFrame.unionByName, parts)) if parts else self

    def _is(self, field: str, term: object) -> Column:
        k, v, lang, d, dt = term.struct
        out = (F.col(f"{field}.v") == v) & (F.col(f"{field}.k") == k)
        if k == R.K_LITERAL:
            out = out & (F.col(f"{field}.dt") == dt) & (F.col(f"{field}.l") == lang) & (F.col(f"{field}.d") == d)
        return out

    def match(self, t: Triple, graph: object = None) -> Relation:
        df, env = self.quads, {}
        if graph is None:
            df = df.where("g is null")
        elif isinstance(graph, Var):
            df = df.where("g is not null")
            env[graph.name] = Value("term", F.col("g"))
        else:
            df = df.where(self._is("g", graph))
        if isinstance(t.p, R.IRI):
            df = df.where(F.col("p") == t.p.value)
        elif not isinstance(t.p, Var):
            return empty(self.spark, _names([t], graph))
        for name, x in (("s", t.s), ("o", t.o)):
            if not isinstance(x, Var):
                df = df.where(self._is(name, x))
        for name, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(x, Var):
                v = Value("iri" if name == "p" else "term", F.col(name))
                if x.name in env:
                    df = df.where(V.same_term(env[x.name], v))
                else:
                    env[x.name] = v
        return _relation(df, env)

    def bgp(self, triples: Sequence[Triple], graph: object = None) -> Relation:
        if not triples:
            return unit(self.spark)
        weigh = lambda t: 4 * (not isinstance(t.s, Var)) + 2 * (not isinstance(t.o, Var)) + (not isinstance(t.p, Var))
        return reduce(join, ordered([(weigh(t), self.match(t, graph)) for t in triples]))

    def nodes(self, graph: object = None) -> Relation:
        """Every subject and object, as ?.n."""
        r = self.match(Triple(Var(".s"), Var(".p"), Var(".n")), graph)
        extra = [graph.name] if isinstance(graph, Var) else []
        objects, subjects = r.select([".n", *extra]), r.select([".s", *extra])
        both = union(objects, Relation(subjects.df.withColumnRenamed(".s", ".n"), {".n": objects.held[".n"], **{n: r.held[n] for n in extra}}, objects.certain))
        return Relation(both.df.distinct(), both.held, both.certain)

    def about(self, resources: Relation, name: str) -> list[Relation]:
        """The triples of the default graph whose subject is one of the resources in ?name, as ?.s ?.p ?.o."""
        found = self.match(Triple(Var(".s"), Var(".p"), Var(".o")))
        return [join(found, resources.select([name]).assign({".s": resources.value(name)}, [".s"]).select([".s"]), "semi")]


class MappedGraph:
    """Tables under a mapping. Patterns with the same subject are one scan of its table; no IRI is built to join on."""

    def __init__(self, spark: SparkSession, folder: str, mapping: M.Mapping | None = None, named: M.Mapping | None = None):
        """mapping has the tables of the default graph, named those that GRAPH sees (the same, if it isn't given)."""
        self.spark, self.folder, self.mapping = spark, folder, mapping or M.Mapping()
        self.named = self.mapping if named is None else named
        self._read: dict[str, DataFrame] = {}

    def dataset(self, default: list[R.IRI], named: list[R.IRI]) -> MappedGraph:
        """The graphs of FROM merged as the default graph, and those of FROM NAMED; what isn't listed is in neither."""
        if not default and not named:
            return self
        pick = lambda wanted: M.Mapping({n: t for n, t in self.named.tables.items() if t.graph in {x.value for x in wanted}})
        return MappedGraph(self.spark, self.folder, pick(default), pick(named))

    def _seen(self, graph: object) -> M.Mapping:
        return self.mapping if graph is None else self.named

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def _object(self, t: M.Mapped, c: M.Column) -> Value:
        raw = F.col(c.name)
        if c.kind == "fk":
            target = self.mapping.tables.get(c.target) or self.named.tables.get(c.target) or M.TABLES[c.target]
            return Value("iri", None, template=target.template, keys=(raw.cast("bigint"),))
        if c.kind == "lang":
            return Value("lang", F.when(F.col(c.target).isNotNull(), raw), F.col(c.target))
        if c.kind in ("int", "dbl", "dt", "bool"):
            return Value(c.kind, raw.cast(V.SQL_TYPES[c.kind]))
        return Value(c.kind, raw)

    def _subject(self, t: M.Mapped) -> Value:
        return Value("iri", None, template=t.template, keys=tuple(self._object(t, c).col for c in t.key))

    @staticmethod
    def _constant(v: Value, term: object) -> Column | None:
        """The condition that a mapped value is this term; None where it never is."""
        if v.kind == "iri":
            if not isinstance(term, R.IRI):
                return None
            return v.template.match(term.value, list(v.keys)) if v.template else v.col == term.value
        if not isinstance(term, R.Literal):
            return None
        if v.kind == "lang":
            return (v.col == term.value) & (F.lower(v.lang) == term.lang.lower()) if term.lang else None
        if term.lang or term.datatype != V.DATATYPES[v.kind]:
            return None
        known = V.constant(term)
        if known.kind == v.kind:
            return v.col == known.col
        return v.col == V.instant(known) if v.kind == "dt" else None

    def _star(self, t: M.Mapped, subject: object, triples: Sequence[Triple], graph: object) -> Relation:
        """The solutions of patterns with one subject in one table."""
        names = _names(triples, graph)
        none = empty(self.spark, names)
        if isinstance(graph, R.IRI) and graph.value != t.graph:
            return none
        df, conditions, env, free = self.table(t.name), [], {}, []
        if isinstance(graph, Var):
            env[graph.name] = Value("iri", F.lit(t.graph), const=R.IRI(t.graph))
        me = self._subject(t)

        def put(x: object, v: Value) -> bool:
            if isinstance(x, Var):
                if x.name in env:
                    conditions.append(V.same_term(env[x.name], v))
                else:
                    env[x.name] = v
                return True
            c = self._constant(v, x)
            conditions.append(c)
            return c is not None

        if not put(subject, me):
            return none
        for x in triples:
            if isinstance(x.p, Var):
                free.append(x)
            elif x.p.value == R.TYPE:
                if not put(x.o, Value("iri", F.lit(t.rdf_class))):
                    return none
            else:
                c = self._seen(graph).predicates[x.p.value][1]
                v = self._object(t, c)
                conditions.append(v.bound)
                if not put(x.o, v):
                    return none
        if free:
            # all triples of a row are made at once; the row is read once however many columns there are
            values = [(t.predicate(c), self._object(t, c)) for c in t.columns] + [(R.TYPE, Value("iri", F.lit(t.rdf_class)))]
            for i, x in enumerate(free):
                fixed = not isinstance(x.o, Var)
                pairs = []
                for name, v in values:
                    # of a known object only the columns that can hold it are read
                    hit = self._constant(v, x.o) if fixed else v.bound
                    if hit is not None:
                        pair = F.struct(F.lit(name).alias("p")) if fixed else F.struct(F.lit(name).alias("p"), V.to_term(v).alias("o"))
                        pairs.append(F.when(hit, pair))
                if not pairs:
                    return none
                df = df.select("*", F.explode(F.array_compact(F.array(*pairs))).alias(f"#{i}"))
                put(x.p, Value("iri", F.col(f"#{i}.p")))
                if not fixed:
                    put(x.o, Value("term", F.col(f"#{i}.o")))
        return _relation(df.where(reduce(Column.__and__, conditions)) if conditions else df, env)

    def bgp(self, triples: Sequence[Triple], graph: object = None) -> Relation:
        if not triples:
            return unit(self.spark)
        names, mapping = _names(triples, graph), self._seen(graph)
        stars: dict[object, list[Triple]] = defaultdict(list)
        targets: dict[str, set[str]] = defaultdict(set)
        for t in triples:
            if not isinstance(t.s, (Var, R.IRI)) or not isinstance(t.p, (Var, R.IRI)):
                return empty(self.spark, names)
            stars[t.s].append(t)
            if isinstance(t.p, R.IRI) and isinstance(t.o, Var) and t.p.value in mapping.predicates:
                c = mapping.predicates[t.p.value][1]
                targets[t.o.name].add(c.target if c.kind == "fk" else "")
        parts = []
        for subject, own in stars.items():
            tables = dict(mapping.tables)
            for t in own:
                if isinstance(t.p, Var):
                    continue
                if t.p.value == R.TYPE:
                    if not isinstance(t.o, Var):
                        found = mapping.classes.get(t.o.value) if isinstance(t.o, R.IRI) else None
                        tables = {n: x for n, x in tables.items() if x is found}
                else:
                    found = mapping.predicates.get(t.p.value, (None,))[0]
                    tables = {n: x for n, x in tables.items() if x is found}
            if isinstance(subject, R.IRI):
                tables = {n: x for n, x in tables.items() if subject.value.startswith(x.template.prefix)}
            elif subject.name in targets:
                tables = {n: x for n, x in tables.items() if n in targets[subject.name]}
            if isinstance(graph, R.IRI):
                tables = {n: x for n, x in tables.items() if x.graph == graph.value}
            if not tables:
                return empty(self.spark, names)
            relation = union(*[self._star(x, subject, own, graph) for x in tables.values()])
            constants = sum(not isinstance(x, Var) for t in own for x in (t.s, t.o))
            parts.append((constants, relation))
        self._crowd([r for _, r in parts], list(stars.values()), mapping)
        return reduce(join, ordered(parts))

    def _crowd(self, parts: list[Relation], stars: list[list[Triple]], mapping: M.Mapping) -> None:
        """Mark the variables in which several tables point to one with far fewer rows, by the bytes of their files; no row is read."""
        uses: dict[str, list[tuple[Relation, str, str]]] = defaultdict(list)
        for r, own in zip(parts, stars):
            for t in own:
                if isinstance(t.p, R.IRI) and isinstance(t.o, Var) and t.p.value in mapping.predicates:
                    table, c = mapping.predicates[t.p.value]
                    if c.kind == "fk":
                        uses[t.o.name].append((r, table.name, c.target))
        for name, found in uses.items():
            if len(found) > 1 and all(self._bytes(table) >= CROWDED * self._bytes(target) for _, table, target in found):
                for r, _, _ in found:
                    r.crowded |= {name}

    def _bytes(self, name: str) -> int:
        """The size of a table's files; endless of one that isn't there, as nothing is known of what points to it."""
        try:
            return int(str(self.table(name)._jdf.queryExecution().analyzed().stats().sizeInBytes()))
        except AnalysisException:
            return 2**63

    def nodes(self, graph: object = None) -> Relation:
        r = self.bgp([Triple(Var(".s"), Var(".p"), Var(".n"))], graph)
        extra = [graph.name] if isinstance(graph, Var) else []
        objects = r.select([".n", *extra])
        subjects = r.select([".s", *extra]).assign({".n": Value("term", V.to_term(r.value(".s")))}, [".n"]).select([".n", *extra])
        both = union(objects, subjects)
        return Relation(both.df.distinct(), both.held, both.certain)

    def about(self, resources: Relation, name: str) -> list[Relation]:
        h = resources.held.get(name)
        tables = [t for t in self.mapping.tables.values() if h is None or h.template is None or h.template == t.template]
        wanted = resources.select([name]).assign({".s": resources.value(name)}, [".s"]).select([".s"])
        triple = [Triple(Var(".s"), Var(".p"), Var(".o"))]
        return [join(self._star(t, Var(".s"), triple, None), wanted, "semi") for t in tables]


__all__ = ["MappedGraph", "QuadGraph", "Template"]
