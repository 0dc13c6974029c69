"""SPARQL algebra the slow way: dictionaries and nested loops, by the letter of the definitions."""

from __future__ import annotations

from quadrille.plans import algebra as A
from quadrille.terms import IRI, Literal


def compatible(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def truth(e, row):
    """Effective boolean value, or None for an error; enough operators for the tests."""
    v = value(e, row)
    return v if isinstance(v, bool) else None


def value(e, row):
    if isinstance(e, A.Var):
        return row.get(e.name)
    if isinstance(e, A.Call):
        if e.name == "BOUND":
            return e.args[0].name in row
        if e.name == "!":
            t = truth(e.args[0], row)
            return None if t is None else not t
        if e.name == "||":
            a, b = (truth(x, row) for x in e.args)
            return True if a is True or b is True else None if a is None or b is None else False
        if e.name == "&&":
            a, b = (truth(x, row) for x in e.args)
            return False if a is False or b is False else None if a is None or b is None else True
        a, b = (value(x, row) for x in e.args)
        if a is None or b is None:
            return None
        if e.name == "=":
            return a == b
        if e.name == "!=":
            return a != b
        raise NotImplementedError(e.name)
    return e


def match(t, quad, row):
    out = dict(row)
    for p, x in zip((t.s, t.p, t.o), quad[:3]):
        if isinstance(p, A.Var):
            if out.setdefault(p.name, x) != x:
                return None
        elif p != x:
            return None
    return out


def solve(p, quads, graph=None):
    match_graph = lambda q: q[3] == graph
    match p:
        case A.Unit():
            return [{}]
        case A.BGP(triples):
            rows = [{}]
            for t in triples:
                rows = [m for r in rows for q in quads if match_graph(q) and (m := match(t, q, r)) is not None]
            return rows
        case A.Join(a, b):
            return [l | r for l in solve(a, quads, graph) for r in solve(b, quads, graph) if compatible(l, r)]  # noqa: E741
        case A.LeftJoin(a, b, conditions):
            out, right = [], solve(b, quads, graph)
            for l in solve(a, quads, graph):  # noqa: E741
                hits = [l | r for r in right if compatible(l, r) and all(truth(c, l | r) is True for c in conditions)]
                out += hits or [l]
            return out
        case A.Union(a, b):
            return solve(a, quads, graph) + solve(b, quads, graph)
        case A.Minus(a, b):
            right = solve(b, quads, graph)
            return [l for l in solve(a, quads, graph) if not any(l.keys() & r.keys() and compatible(l, r) for r in right)]  # noqa: E741
        case A.Filter(a, conditions):
            return [r for r in solve(a, quads, graph) if all(holds(c, r, quads, graph) for c in conditions)]
        case A.Graph(name, a):
            if not isinstance(name, A.Var):
                return solve(a, quads, name)
            graphs = {q[3] for q in quads if q[3] is not None}
            return [r | {name.name: g} for g in sorted(graphs) for r in solve(a, quads, g) if r.get(name.name, g) == g]
        case A.Extend(a, v, e):
            return [r if (x := value(e, r)) is None else r | {v.name: x} for r in solve(a, quads, graph)]
        case A.Values(names, rows):
            return [{n.name: x for n, x in zip(names, r) if x is not None} for r in rows]
    raise NotImplementedError(p)


def holds(c, row, quads, graph):
    if isinstance(c, A.Exists):
        inner = c.pattern
        conditions = ()
        if isinstance(inner, A.Filter):
            inner, conditions = inner.pattern, inner.conditions
        found = any(compatible(row, r) and all(truth(x, row | r) is True for x in conditions) for r in solve(inner, quads, graph))
        return found != c.negated
    return truth(c, row) is True


__all__ = ["IRI", "Literal", "solve"]
