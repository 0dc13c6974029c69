"""Solutions as a DataFrame: which columns hold each variable, and the operators of the algebra on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.library import common_kind
from ..functions.values import Template, Value


@dataclass(frozen=True)
class Held:
    """How a variable is held: a native column, a term struct, or the key columns of an IRI template."""

    kind: str
    template: Template | None = None

    def columns(self, name: str) -> list[str]:
        if self.template:
            return [f"{name}#{i}" for i in range(len(self.template.kinds))]
        return [name, f"{name}#l"] if self.kind == "lang" else [name]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def read(name: str, held: Held) -> Value:
    cols = [col(c) for c in held.columns(name)]
    if held.template:
        return Value("iri", None, template=held.template, keys=tuple(cols))
    return Value(held.kind, cols[0], cols[1] if len(cols) > 1 else None)


def written(name: str, v: Value) -> tuple[Held, dict[str, Column]]:
    """The columns that hold a value under a name."""
    held = Held(v.kind, v.template)
    parts = list(v.keys) if v.template else [v.col, v.lang] if v.kind == "lang" else [v.col]
    return held, dict(zip(held.columns(name), parts))


@dataclass
class Relation:
    df: DataFrame
    held: dict[str, Held] = field(default_factory=dict)
    certain: frozenset[str] = frozenset()  # variables that are bound in every row
    crowded: frozenset[str] = frozenset()  # variables of few values, each of which many rows have

    def value(self, name: str) -> Value:
        return read(name, self.held[name]) if name in self.held else V.null()

    def environment(self) -> dict[str, Value]:
        return {n: self.value(n) for n in self.held}

    def columns(self, names: Sequence[str] | None = None) -> list[str]:
        return [c for n in (self.held if names is None else names) if n in self.held for c in self.held[n].columns(n)]

    def select(self, names: Sequence[str]) -> Relation:
        """The named variables; one that is never bound is a column of nulls."""
        held = {n: self.held.get(n, Held("term")) for n in names}
        cols = [x for n in names for x in ([col(c) for c in self.columns([n])] or [V.null().col.alias(n)])]
        df = self.df.select(*cols) if cols else self.df.select(F.lit(0).alias("#"))
        return Relation(df, held, self.certain & set(names), self.crowded & set(names))

    def assign(self, new: dict[str, Value], certain: Sequence[str] = ()) -> Relation:
        held, cols = dict(self.held), {}
        for n, v in new.items():
            held[n], more = written(n, v)
            cols |= more
        # columns that only the old form of a variable had go
        keep = [c for n in self.held if n not in new for c in self.held[n].columns(n)]
        df = self.df.select(*map(col, keep), *[c.alias(n) for n, c in cols.items()]) if keep or cols else self.df
        return Relation(df, held, (self.certain - set(new)) | set(certain))

    def where(self, c: Column) -> Relation:
        return Relation(self.df.where(c), self.held, self.certain, self.crowded)


def unit(spark: SparkSession) -> Relation:
    """One solution that binds nothing."""
    return Relation(spark.range(1).select(F.lit(0).alias("#")))


def empty(spark: SparkSession, names: Sequence[str]) -> Relation:
    df = spark.range(0).select(F.lit(0).alias("#"))
    return Relation(df).assign({n: V.null() for n in names})


Condition = Callable[[dict[str, Value]], Column]

#: Each side of a join of crowded variables is cut into so many parts by key, so that a key's pairs are the work of GRID ** 2 tasks.
GRID = 4


def always(env: dict[str, Value]) -> Column:
    """The condition that all pairs meet: of anti, it makes absence of any compatible row, not of one that shares a binding."""
    return F.lit(True)


def join(left: Relation, right: Relation, how: str = "inner", extra: Condition | None = None) -> Relation:
    """Join on compatible mappings: variables of both sides are equal terms, or one is unbound.

    how: inner, left, semi, anti. Where shared variables are bound in every row of both sides the condition is an
    equality of native columns, which Spark hashes or merges; extra is a further condition over both sides.
    For anti without extra, a pair must also have a variable that both bind. If no shared variable is bound in every row
    of both sides, rows that bind one are joined apart from those that don't, so that there is an equality again."""
    shared = [n for n in left.held if n in right.held]
    if shared and not any(n in left.certain and n in right.certain for n in shared):
        return _apart(left, right, how, extra, max(shared, key=lambda n: (n in left.certain) + (n in right.certain)))
    return _joined(left, right, how, extra)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _gridded(left: DataFrame, right: DataFrame, on: Column, keys: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Inner join of few keys with many rows each: a row of the left is in one of GRID rows of cells and in all columns, one of
    the right in one of GRID columns and all rows. Two rows share one cell, so that each pair is made once. By bytes, which is how
    Spark sizes partitions, the sides are small; the number of cells' tasks is fixed, as it is pairs that take the time."""
    part = lambda df: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(GRID)).cast("int")
    every = F.explode(F.array(*[F.lit(i) for i in range(GRID)]))
    left = left.withColumn("#row", part(left)).withColumn("#column", every)
    right = right.withColumn("#column~", part(right)).withColumn("#row~", every)
    cell = (F.col("`#row`") == F.col("`#row~`")) & (F.col("`#column`") == F.col("`#column~`"))
    n = _tasks(left)
    left = left.repartition(n, *[a for a, _ in keys], F.col("`#row`"), F.col("`#column`"))
    right = right.repartition(n, *[b for _, b in keys], F.col("`#row~`"), F.col("`#column~`"))
    return left.join(right, on & cell)


def _parts(r: Relation, name: str) -> tuple[Relation, Relation | None]:
    """The rows that bind the variable, and the others, without it; None if there are no others."""
    if name in r.certain:
        return r, None
    bound = r.value(name).bound
    return Relation(r.df.where(bound), r.held, r.certain | {name}), Relation(r.df.where(~bound), r.held, r.certain).select([n for n in r.held if n != name])


def _apart(left: Relation, right: Relation, how: str, extra: Condition | None, name: str) -> Relation:
    """join() by whether a shared variable is bound on each side."""
    if how == "left":
        found = join(left, right, "inner", extra)
        alone = join(left, right, "anti", extra or always)
        return union(found, alone)
    (lb, lu), (rb, ru) = _parts(left, name), _parts(right, name)
    if how == "inner":
        # a value that is no key, on either side: any number of rows may have it
        parts = [_joined(lb, rb, how, extra, grid=left.held[name].template is None)]
        parts += [join(lb, ru, how, extra)] if ru else []
        parts += [join(lu, right, how, extra)] if lu else []
        return union(*parts)
    # a row stays or goes by the first of the right side's parts that decides it
    if how == "semi":
        parts = [_joined(lb, rb, how, extra)]
        if ru:
            rest = _joined(lb, rb, "anti", extra or always)
            parts.append(join(rest, ru, how, extra))
    else:
        kept = _joined(lb, rb, how, extra)
        parts = [join(kept, ru, how, extra) if ru else kept]
    if lu:
        parts.append(join(lu, right, how, extra))
    return union(*parts)


def _joined(left: Relation, right: Relation, how: str, extra: Condition | None, grid: bool = False) -> Relation:
    """join() in one piece; grid: an inner one is laid out as of crowded variables."""
    shared = [n for n in left.held if n in right.held]
    if not shared and how in ("semi", "anti") and extra in (None, always):
        right = Relation(right.df.limit(1), right.held, right.certain)  # any row decides for all
    names = {c: f"{c}~" for n in shared for c in right.held[n].columns(n)}
    other = right.df.select(*[col(c).alias(names.get(c, c)) for c in right.columns()]) if right.held else right.df.select(F.lit(0).alias("#~"))
    theirs = {}
    for n in shared:
        h = right.held[n]
        cols = [col(names[c]) for c in h.columns(n)]
        theirs[n] = Value("iri", None, template=h.template, keys=tuple(cols)) if h.template else Value(h.kind, cols[0], cols[1] if len(cols) > 1 else None)
    on: Column | None = None
    met: Column | None = None
    for n in shared:
        a, b = left.value(n), theirs[n]
        same = V.same_term(a, b)
        if not (n in left.certain and n in right.certain):
            same = same | ~a.bound | ~b.bound
            both = a.bound & b.bound
            met = both if met is None else met | both
        on = same if on is None else on & same
    certain_shared = [n for n in shared if n in left.certain and n in right.certain]
    if how == "anti" and extra is None:
        if not shared:
            return left
        if not certain_shared:
            on = on & met
    env = {n: right.value(n) for n in right.held if n not in shared} | left.environment()
    merged: dict[str, Value] = {}
    for n in shared:
        if n not in left.certain:
            kind, cols = common_kind([left.value(n), theirs[n]]) if left.held[n] != right.held[n] or left.held[n].kind == "lang" else (None, [])
            if kind is None:
                h = left.held[n]
                pairs = [F.coalesce(col(c), col(names[c])) for c in h.columns(n)]
                merged[n] = Value("iri", None, template=h.template, keys=tuple(pairs)) if h.template else Value(h.kind, pairs[0])
            else:
                merged[n] = Value(kind, F.coalesce(*cols))
    env |= merged
    if extra is not None:
        c = extra(env)
        on = c if on is None else on & c
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    if on is None:
        if how == "inner":
            # all pairs are the answer: tasks are as many as the session's, not as the left side's few bytes make
            df = left.df.repartition(_tasks(left.df)).crossJoin(other)
        else:
            df = left.df.join(other, F.lit(True), kind)
    elif how == "inner" and extra is None and (grid or set(shared) <= left.crowded & right.crowded):
        df = _gridded(left.df, other, on, [pair for n in certain_shared for pair in V.compared(left.value(n), theirs[n])])
    else:
        df = left.df.join(other, on, kind)
    if how in ("semi", "anti"):
        return Relation(df, left.held, left.certain)
    held = dict(left.held) | {n: h for n, h in right.held.items() if n not in shared}
    certain = left.certain | right.certain if how == "inner" else left.certain
    crowded = left.crowded | right.crowded
    out = Relation(df, held, frozenset(certain), crowded)
    if merged:
        return out.assign(merged, [n for n in merged if n in certain])
    return Relation(df.select(*map(col, out.columns())) if held else df.select(F.lit(0).alias("#")), held, frozenset(certain), crowded)


def union(*parts: Relation) -> Relation:
    """Solutions of all parts; a variable of some parts alone is unbound in the others'."""
    if len(parts) == 1:
        return parts[0]
    held: dict[str, Held] = {}
    for r in parts:
        for n, h in r.held.items():
            held[n] = h if held.get(n, h) == h else Held("term")
    sides = []
    for r in parts:
        cols = []
        for n, h in held.items():
            if n not in r.held:
                cols += [F.lit(None).cast(t).alias(c) for c, t in zip(h.columns(n), _types(h))]
            elif r.held[n] == h:
                cols += [col(c) for c in h.columns(n)]
            else:
                cols.append(V.to_term(r.value(n)).alias(n))
        sides.append(r.df.select(*cols) if cols else r.df.select(F.lit(0).alias("#")))
    # columns are in the same order: a balanced tree keeps the plan shallow
    while len(sides) > 1:
        sides = [sides[i].union(sides[i + 1]) if i + 1 < len(sides) else sides[i] for i in range(0, len(sides), 2)]
    return Relation(sides[0], held, frozenset.intersection(*[r.certain for r in parts]))


def _types(h: Held) -> list[str]:
    if h.template:
        return [V.SQL_TYPES.get(k, "string") for k in h.template.kinds]
    if h.kind == "lang":
        return ["string", "string"]
    return [V.R.TERM.simpleString() if h.kind == "term" else V.SQL_TYPES.get(h.kind, "string")]


def minus(left: Relation, right: Relation) -> Relation:
    return join(left, right, "anti")


def ordered(parts: list[tuple[int, Relation]]) -> list[Relation]:
    """Join order: the most selective first, then always one that shares a variable with what is joined, if there is one."""
    rest = sorted(range(len(parts)), key=lambda i: -parts[i][0])
    out, seen = [], set()
    while rest:
        pick = next((i for i in rest if not seen or seen & set(parts[i][1].held)), rest[0])
        rest.remove(pick)
        seen |= set(parts[pick][1].held)
        out.append(parts[pick][1])
    return out
