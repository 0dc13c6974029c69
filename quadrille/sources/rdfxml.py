"""RDF/XML: node and property elements by turns, over a namespace-aware tree."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from .. import terms as R
from ..terms import BNode, IRI, Literal, Quad, TripleTerm
from . import iris

_XML = "{http://www.w3.org/XML/1998/namespace}"
_ITS = "{http://www.w3.org/2005/11/its}"
_N = f"{{{R.RDF}}}"
_SYNTAX = {_N + x for x in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "annotation", "annotationNodeID", "version")}
_OLD = {_N + x for x in ("aboutEach", "aboutEachPrefix", "bagID")}
_NCNAME = re.compile(r"[^\W\d][\w.\-·]*\Z")


class _Reader:
    def __init__(self, base: str, scope: str):
        self.base, self.scope, self.made, self.out, self.ids = base, scope, 0, [], set()

    def fresh(self) -> BNode:
        self.made += 1
        return BNode(f"{self.scope}.{self.made}")

    def emit(self, s: object, p: object, o: object) -> None:
        self.out.append(Quad(s, p, o))

    def scoped(self, e: ET.Element, env: dict) -> dict:
        """Base, language, direction and version that hold inside an element."""
        out = dict(env)
        if (b := e.get(_XML + "base")) is not None:
            out["base"] = iris.resolve(env["base"], b.split("#")[0]) if b else env["base"]
        if (x := e.get(_XML + "lang")) is not None:
            out["lang"] = x
        if (x := e.get(_ITS + "dir")) is not None:
            out["dir"] = x
        if (x := e.get(_N + "version")) is not None:
            out["version"] = x
        return out

    def iri(self, env: dict, ref: str) -> IRI:
        return IRI(iris.check(iris.resolve(env["base"], ref)))

    def named(self, env: dict, name: str) -> IRI:
        if not _NCNAME.match(name):
            raise ValueError(f"rdf:ID {name!r} is no name")
        full = iris.resolve(env["base"], "#" + name)
        if full in self.ids:
            raise ValueError(f"rdf:ID {name!r} is there twice")
        self.ids.add(full)
        return IRI(full)

    def blank(self, name: str) -> BNode:
        if not _NCNAME.match(name):
            raise ValueError(f"rdf:nodeID {name!r} is no name")
        return BNode(self.scope + name)

    def text(self, env: dict, value: str) -> Literal:
        direction = env.get("dir", "") if env.get("lang") and env.get("version") == "1.2" else ""
        return Literal(value, env.get("lang", ""), direction)

    def tag(self, name: str) -> IRI:
        if not name.startswith("{"):
            raise ValueError(f"{name!r} has no namespace")
        return IRI(name[1:].replace("}", "", 1))

    def attributes(self, e: ET.Element) -> dict[str, str]:
        """Attributes that are properties."""
        out = {}
        for k, v in e.attrib.items():
            if k.startswith(_XML) or k.startswith(_ITS) or k in _SYNTAX:
                continue
            if not k.startswith("{"):
                raise ValueError(f"attribute {k!r} has no namespace")
            if k in _OLD or k in (_N + "Description", _N + "li"):
                raise ValueError(f"attribute {k!r} can't be a property")
            out[k] = v
        return out

    def node(self, e: ET.Element, env: dict) -> object:
        env = self.scoped(e, env)
        if e.tag in _SYNTAX | _OLD or e.tag == _N + "li":
            raise ValueError(f"{e.tag} can't be a node")
        names = [k for k in ("ID", "about", "nodeID") if e.get(_N + k) is not None]
        if len(names) > 1:
            raise ValueError(f"{' and '.join('rdf:' + n for n in names)} on one node")
        if not names:
            me: object = self.fresh()
        else:
            v = e.get(_N + names[0])
            me = {"ID": self.named, "about": self.iri}[names[0]](env, v) if names[0] != "nodeID" else self.blank(v)
        if e.tag != _N + "Description":
            self.emit(me, IRI(R.TYPE), self.tag(e.tag))
        self.properties_of(me, self.attributes(e), env)
        if (e.text or "").strip() or any((c.tail or "").strip() for c in e):
            raise ValueError(f"text inside the node {e.tag}")
        count = 0
        for c in e:
            if not isinstance(c.tag, str):
                continue
            if c.tag == _N + "li":
                count += 1
                self.property(me, IRI(f"{R.RDF}_{count}"), c, env)
            else:
                if c.tag in _SYNTAX | _OLD or c.tag == _N + "Description":
                    raise ValueError(f"{c.tag} can't be a property")
                self.property(me, self.tag(c.tag), c, env)
        return me

    def properties_of(self, me: object, attributes: dict[str, str], env: dict) -> None:
        for k, v in attributes.items():
            if k == _N + "type":
                self.emit(me, IRI(R.TYPE), self.iri(env, v))
            else:
                self.emit(me, self.tag(k), self.text(env, v))

    def property(self, me: object, p: IRI, e: ET.Element, env: dict) -> None:
        env = self.scoped(e, env)
        kind = e.get(_N + "parseType")
        children = [c for c in e if isinstance(c.tag, str)]
        extra = self.attributes(e)
        resource, node_id, datatype = (e.get(_N + k) for k in ("resource", "nodeID", "datatype"))
        if kind is not None and (resource is not None or node_id is not None or datatype is not None or extra):
            raise ValueError("rdf:parseType with other attributes")
        if resource is not None and node_id is not None:
            raise ValueError("rdf:resource and rdf:nodeID on one property")
        if kind == "Resource":
            o: object = self.fresh()
            self.emit(me, p, o)
            inner = ET.Element(_N + "Description")
            inner.extend(children)
            self.inside(o, inner, env)
        elif kind == "Collection":
            items = [self.node(c, env) for c in children]
            cells = [self.fresh() for _ in items]
            o = cells[0] if cells else IRI(R.NIL)
            self.emit(me, p, o)
            for i, (cell, x) in enumerate(zip(cells, items)):
                self.emit(cell, IRI(R.FIRST), x)
                self.emit(cell, IRI(R.REST), cells[i + 1] if i + 1 < len(cells) else IRI(R.NIL))
        elif kind == "Triple" and env.get("version") == "1.2":
            # the one triple of the one node inside is a term, not an assertion
            mark = len(self.out)
            for c in children:
                self.node(c, env)
            made, self.out = self.out[mark:], self.out[:mark]
            if len(made) != 1:
                raise ValueError("rdf:parseType='Triple' holds one triple")
            o = TripleTerm(*made[0][:3])
            self.emit(me, p, o)
        elif kind is not None:
            o = Literal(_markup(e), datatype=R.RDF + "XMLLiteral")
            self.emit(me, p, o)
        elif children:
            if len(children) > 1 or (e.text or "").strip() or any((c.tail or "").strip() for c in children):
                raise ValueError(f"more than one node in {e.tag}")
            if extra or resource is not None or node_id is not None or datatype is not None:
                raise ValueError(f"a node in {e.tag}, which has an object already")
            o = self.node(children[0], env)
            self.emit(me, p, o)
        elif resource is not None or node_id is not None or (extra and datatype is None):
            if (e.text or "").strip():
                raise ValueError(f"text in {e.tag}, which has an object already")
            o = self.iri(env, resource) if resource is not None else self.blank(node_id) if node_id is not None else self.fresh()
            self.emit(me, p, o)
            self.properties_of(o, extra, env)
        elif datatype is not None:
            o = Literal(e.text or "", datatype=self.iri(env, datatype).value)
            self.emit(me, p, o)
        else:
            o = self.text(env, e.text or "")
            self.emit(me, p, o)
        if (name := e.get(_N + "ID")) is not None:
            about = self.named(env, name)
            for q, x in ((R.TYPE, IRI(R.RDF + "Statement")), (R.RDF + "subject", me), (R.RDF + "predicate", p), (R.RDF + "object", o)):
                self.emit(about, IRI(q), x)
        for key, make in (("annotation", lambda v: self.iri(env, v)), ("annotationNodeID", self.blank)):
            if (v := e.get(_N + key)) is not None and env.get("version") == "1.2":
                self.emit(make(v), IRI(R.REIFIES), TripleTerm(me, p, o))

    def inside(self, me: object, e: ET.Element, env: dict) -> None:
        count = 0
        for c in e:
            if c.tag == _N + "li":
                count += 1
                self.property(me, IRI(f"{R.RDF}_{count}"), c, env)
            else:
                self.property(me, self.tag(c.tag), c, env)


def _markup(e: ET.Element) -> str:
    """The content of an element as canonical XML: namespaces where they are first used."""

    def show(x: ET.Element, known: dict[str, str]) -> str:
        known = dict(known)
        new: dict[str, str] = {}

        def name(tag: str, attribute: bool = False) -> str:
            if not tag.startswith("{"):
                return tag
            uri, local = tag[1:].split("}")
            if uri == _XML[1:-1]:
                return "xml:" + local
            if uri not in known:
                known[uri] = new[uri] = f"ns{len(known)}"
            return f"{known[uri]}:{local}"

        tag = name(x.tag)
        attributes = "".join(f" {name(k, True)}={quoteattr(v)}" for k, v in sorted(x.attrib.items()))
        spaces = "".join(f' xmlns:{v}="{escape(k)}"' for k, v in new.items())
        body = escape(x.text or "") + "".join(show(c, known) + escape(c.tail or "") for c in x)
        return f"<{tag}{spaces}{attributes}>{body}</{tag}>"

    return escape(e.text or "") + "".join(show(c, {}) + escape(c.tail or "") for c in e)


def parse(text: str, base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a document; ValueError where it is malformed."""
    try:
        root = ET.fromstring(text.encode("utf-8") if not text.lstrip().startswith("<?xml") else re.sub(r"^\s*<\?xml[^>]*\?>", "", text).encode("utf-8"))
    except ET.ParseError as e:
        raise ValueError(str(e)) from e
    r = _Reader(base, scope)
    env = {"base": base}
    if root.tag == _N + "RDF":
        env = r.scoped(root, env)
        for c in root:
            r.node(c, env)
    else:
        r.node(root, env)
    return r.out
