"""The algebra of SPARQL: patterns, paths, expressions and queries as frozen values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Triple:
    s: object
    p: object  # a term, a Var or a path
    o: object


# Paths


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """least is 0 or 1; many is False for `?`."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class NotIn:
    """A negated property set: IRIs that the predicate isn't, forwards and backwards."""

    forward: tuple
    backward: tuple


PATHS = (Inverse, Sequence, Alternative, Repeat, NotIn)

# Patterns


@dataclass(frozen=True)
class Unit:
    """The pattern with one empty solution."""


@dataclass(frozen=True)
class BGP:
    triples: tuple


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    conditions: tuple = ()


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Graph:
    name: object
    pattern: object


@dataclass(frozen=True)
class Filter:
    pattern: object
    conditions: tuple


@dataclass(frozen=True)
class Extend:
    pattern: object
    var: Var
    expr: object


@dataclass(frozen=True)
class Values:
    vars: tuple
    rows: tuple


@dataclass(frozen=True)
class SubSelect:
    query: object


# Expressions; a Var or a term is an expression too


@dataclass(frozen=True)
class Call:
    """An operator or function by its upper-case name, or a cast by its datatype IRI."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object  # None: *
    distinct: bool = False
    separator: str = " "


@dataclass
class Query:
    form: str  # SELECT, ASK, CONSTRUCT, DESCRIBE
    where: object = Unit()
    items: list | None = None  # of (Var, expression or None); None: *
    distinct: bool = False
    template: tuple = ()
    targets: list = field(default_factory=list)
    from_default: list = field(default_factory=list)
    from_named: list = field(default_factory=list)
    group: list | None = None  # of (Var or None, expression)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # of (expression, descending)
    limit: int | None = None
    offset: int = 0


def variables(x: object) -> list[str]:
    """In-scope variables of a pattern, in order of first appearance."""
    out: dict[str, None] = {}

    def see(*terms: object) -> None:
        for t in terms:
            if isinstance(t, Var) and not t.name.startswith("."):
                out[t.name] = None

    def walk(p: object) -> None:
        match p:
            case BGP(triples):
                for t in triples:
                    see(t.s, t.p, t.o)
            case Join(a, b) | LeftJoin(a, b) | Union(a, b):
                walk(a), walk(b)
            case Minus(a, _) | Filter(a, _):
                walk(a)
            case Graph(name, a):
                see(name), walk(a)
            case Extend(a, v, _):
                walk(a), see(v)
            case Values(vs, _):
                see(*vs)
            case SubSelect(q):
                for v in projected(q):
                    out[v] = None

    walk(x)
    return list(out)


def projected(q: Query) -> list[str]:
    """The variables that a SELECT returns, in order."""
    return variables(q.where) if q.items is None else [v.name for v, _ in q.items]


def used(e: object) -> set[str]:
    """Variables that an expression mentions."""
    match e:
        case Var(name):
            return {name}
        case Call(_, args):
            return set().union(*map(used, args)) if args else set()
        case Aggregate(_, arg):
            return used(arg) if arg is not None else set()
        case Exists(p, _):
            return set(variables(p))
    return set()


def aggregates(e: object) -> list[Aggregate]:
    match e:
        case Aggregate():
            return [e]
        case Call(_, args):
            return [x for a in args for x in aggregates(a)]
    return []
