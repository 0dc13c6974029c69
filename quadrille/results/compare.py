"""Equality up to the names of blank nodes: of graphs, datasets and solutions. For what fits on the driver."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

from ..terms import BNode, Quad, TripleTerm

Tuples = list[tuple]


def _nodes(x: object) -> list[BNode]:
    if isinstance(x, BNode):
        return [x]
    if isinstance(x, (TripleTerm, Quad)) or type(x) is tuple:
        return [b for y in x for b in _nodes(y)]
    return []


def _renamed(x: object, names: dict) -> object:
    if isinstance(x, BNode):
        return names.get(x, x)
    if isinstance(x, TripleTerm):
        return TripleTerm(*[_renamed(y, names) for y in x])
    return tuple(_renamed(y, names) for y in x) if type(x) is tuple else x


def _colours(rows: Tuples, fixed: dict[BNode, object]) -> dict[BNode, object]:
    """A colour for each node by what it stands beside, refined until the number of colours is stable."""
    at: dict[BNode, list[tuple]] = defaultdict(list)
    for r in rows:
        for b in set(_nodes(r)):
            at[b].append(r)
    colour: dict[BNode, object] = {b: ("fixed", fixed[b]) if b in fixed else 0 for b in at}
    classes = -1
    while len(set(colour.values())) != classes:
        classes = len(set(colour.values()))
        new = {}
        for b, rs in at.items():
            # `here` is told apart from others of the same colour
            seen = sorted(repr(_renamed(r, {x: ("here",) if x == b else ("node", colour[x]) for x in _nodes(r)})) for r in rs)
            new[b] = hash((colour[b], tuple(seen)))
        colour = new
    return colour


def same(left: Iterable[tuple], right: Iterable[tuple]) -> bool:
    """Whether a one-to-one renaming of blank nodes makes the two bags of tuples equal."""
    a, b = [tuple(x) for x in left], [tuple(x) for x in right]
    if len(a) != len(b):
        return False

    def search(fixed_a: dict, fixed_b: dict) -> bool:
        ca, cb = _colours(a, fixed_a), _colours(b, fixed_b)
        if Counter(ca.values()) != Counter(cb.values()):
            return False
        groups: dict[object, list[BNode]] = defaultdict(list)
        for n, c in ca.items():
            groups[c].append(n)
        unsure = [g for g in groups.values() if len(g) > 1]
        if not unsure:
            by = {c: n for n, c in cb.items()}
            names = {n: by[c] for n, c in ca.items()}
            return Counter(_renamed(r, names) for r in a) == Counter(b)
        # give one node of the smallest class each partner in turn
        one = min(unsure, key=len)[0]
        k = len(fixed_a)
        return any(search({**fixed_a, one: k}, {**fixed_b, x: k}) for x, c in cb.items() if c == ca[one])

    return search({}, {})


def isomorphic(left: Iterable[Quad], right: Iterable[Quad]) -> bool:
    """Equality of graphs or datasets as sets of quads."""
    return same({tuple(q) for q in left}, {tuple(q) for q in right})


def same_solutions(left: Iterable[dict[str, object]], right: Iterable[dict[str, object]]) -> bool:
    """Equality of solutions as bags, in any order."""
    as_rows = lambda rows: [tuple(x for v in sorted(r) for x in (v, r[v])) for r in rows]
    return same(as_rows(left), as_rows(right))
