"""JSON-LD without remote contexts: @context, @id, @type, @value, @language, @list, @set, @graph, @reverse, nesting."""

from __future__ import annotations

import json

from .. import terms as R
from ..terms import BNode, IRI, Literal, Quad
from . import iris


class _Reader:
    def __init__(self, base: str, scope: str):
        self.base, self.scope, self.made, self.out = base, scope, 0, []

    def fresh(self) -> BNode:
        self.made += 1
        return BNode(f"{self.scope}.{self.made}")

    def context(self, now: dict, given: object) -> dict:
        if given is None:
            return {"terms": {}}
        if isinstance(given, list):
            for x in given:
                now = self.context(now, x)
            return now
        if not isinstance(given, dict):
            raise ValueError(f"a remote context: {given!r}")
        out = {**now, "terms": dict(now["terms"])}
        for k, v in given.items():
            if k in ("@vocab", "@language", "@base"):
                out[k] = v
            elif not k.startswith("@"):
                out["terms"][k] = {"@id": v} if isinstance(v, str) or v is None else v
        return out

    def expand(self, ctx: dict, name: str, vocab: bool) -> str | None:
        """The IRI of a term, compact IRI or reference; None for what has none."""
        seen: set[str] = set()
        while vocab and name in ctx["terms"] and name not in seen:
            seen.add(name)
            found = ctx["terms"][name].get("@id")
            if found is None:
                if "@id" in ctx["terms"][name]:
                    return None
                break
            name = found
        if name.startswith(("@", "_:")):
            return name
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and prefix in ctx["terms"]:
            stem = self.expand(ctx, prefix, True)
            return None if stem is None else stem + local
        if colon:
            return name
        if vocab:
            return ctx["@vocab"] + name if ctx.get("@vocab") else None
        base = ctx.get("@base", self.base)
        return iris.resolve(base or "", name)

    def ref(self, ctx: dict, name: str, vocab: bool = False) -> object:
        full = self.expand(ctx, name, vocab)
        if full is None or full.startswith("_:"):
            return None if full is None else BNode(self.scope + full[2:])
        return IRI(full) if iris.is_absolute(full) else None

    def node(self, ctx: dict, obj: dict, graph: object) -> object:
        if "@context" in obj:
            ctx = self.context(ctx, obj["@context"])
        keys = {k: self.expand(ctx, k, True) for k in obj}
        alias = {v: k for k, v in keys.items() if v and v.startswith("@")}
        given = obj.get(alias.get("@id", "@id"))
        me = self.ref(ctx, given) if isinstance(given, str) else self.fresh()
        if me is None:
            return None
        inner = alias.get("@graph")
        if inner is not None:
            named = len([k for k in obj if keys[k] not in ("@context", "@graph")]) > 0
            for x in _many(obj[inner]):
                self.node(ctx, x, me if named else graph)
        for k, value in obj.items():
            full, term = keys[k], ctx["terms"].get(k) or {}
            if full == "@type":
                for x in _many(value):
                    if (t := self.ref(ctx, x, True)) is not None:
                        self.out.append(Quad(me, IRI(R.TYPE), t, graph))
            elif full == "@reverse":
                for p, subjects in value.items():
                    self.link(ctx, p, subjects, me, graph, True)
            elif full and not full.startswith("@") and iris.is_absolute(full):
                self.link(ctx, k, value, me, graph, "@reverse" in term)
            elif full is None and "@reverse" in term:
                self.link(ctx, term["@reverse"], value, me, graph, True)
        return me

    def link(self, ctx: dict, key: str, value: object, me: object, graph: object, back: bool) -> None:
        term = ctx["terms"].get(key) or {}
        p = self.ref(ctx, key, True)
        if not isinstance(p, IRI):
            return
        values = [{"@list": value}] if term.get("@container") == "@list" and not (isinstance(value, dict) and "@list" in value) else _many(value)
        if term.get("@container") == "@language" and isinstance(value, dict):
            values = [{"@value": x, "@language": k} for k, v in value.items() for x in _many(v)]
        for x in values:
            o = self.value(ctx, term, x, graph)
            if o is not None:
                self.out.append(Quad(o, p, me, graph) if back else Quad(me, p, o, graph))

    def value(self, ctx: dict, term: dict, x: object, graph: object) -> object:
        if isinstance(x, dict):
            if "@value" in x:
                if x["@value"] is None:
                    return None
                if x.get("@language"):
                    return Literal(str(x["@value"]), x["@language"], x.get("@direction") or "")
                kind = x.get("@type")
                return self.scalar(x["@value"], self.expand(ctx, kind, True) if kind else None)
            if "@list" in x:
                items = [o for v in _many(x["@list"]) if (o := self.value(ctx, term, v, graph)) is not None]
                head: object = IRI(R.NIL)
                for o in reversed(items):
                    cell = self.fresh()
                    self.out += [Quad(cell, IRI(R.FIRST), o, graph), Quad(cell, IRI(R.REST), head, graph)]
                    head = cell
                return head
            if "@set" in x:
                raise ValueError("@set inside an array")
            return self.node(ctx, x, graph)
        if x is None:
            return None
        kind = term.get("@type")
        if kind in ("@id", "@vocab") and isinstance(x, str):
            return self.ref(ctx, x, kind == "@vocab")
        lang = term.get("@language", ctx.get("@language"))
        if isinstance(x, str) and lang and not kind:
            return Literal(x, lang)
        return self.scalar(x, self.expand(ctx, kind, True) if kind and not kind.startswith("@") else None)

    @staticmethod
    def scalar(x: object, kind: str | None) -> Literal:
        if isinstance(x, bool):
            return Literal("true" if x else "false", datatype=kind or R.BOOLEAN)
        if isinstance(x, float) and (x % 1 or abs(x) >= 1e21 or kind == R.DOUBLE):
            mantissa, _, exponent = f"{x:.15E}".partition("E")
            return Literal(f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa and mantissa.rstrip('0')[-1] != '.' else mantissa.rstrip('0') + '0'}E{int(exponent)}", datatype=kind or R.DOUBLE)
        if isinstance(x, (int, float)):
            return Literal(str(int(x)), datatype=kind or R.INTEGER)
        return Literal(str(x), datatype=kind or R.STRING)


def _many(x: object) -> list:
    if isinstance(x, dict) and set(x) == {"@set"}:
        return _many(x["@set"])
    return x if isinstance(x, list) else [x]


def parse(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a document. Remote contexts aren't fetched: they are an error."""
    r = _Reader(base, scope)
    doc = json.loads(text)
    for x in _many(doc):
        if not isinstance(x, dict):
            raise ValueError("a document is an object or an array of objects")
        r.node({"terms": {}}, x, None)
    return r.out
