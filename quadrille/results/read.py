"""Readers of results that others wrote: SPARQL XML and JSON, and result sets that are described in RDF."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from .. import terms as R
from ..terms import BNode, IRI, Literal, Quad

_S = "{http://www.w3.org/2005/sparql-results#}"
_RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"
Solutions = tuple[list[str], list[dict[str, object]]]


def read_xml(text: str) -> Solutions | bool:
    """(variables, solutions), or the answer of ASK."""
    root = ET.fromstring(text)
    if (b := root.find(_S + "boolean")) is not None:
        return b.text.strip() == "true"

    def term(e: ET.Element) -> object:
        kind = e.tag.removeprefix(_S)
        if kind == "uri":
            return IRI(e.text or "")
        if kind == "bnode":
            return BNode(e.text or "")
        if kind == "triple":
            return R.TripleTerm(*[term(e.find(_S + k)[0]) for k in ("subject", "predicate", "object")])
        return Literal(e.text or "", e.get("{http://www.w3.org/XML/1998/namespace}lang", ""), e.get("{http://www.w3.org/2005/11/its}dir", ""), e.get("datatype", R.STRING))

    names = [v.get("name") for v in root.iterfind(f"{_S}head/{_S}variable")]
    return names, [{b.get("name"): term(b[0]) for b in r.iterfind(_S + "binding")} for r in root.iterfind(f"{_S}results/{_S}result")]


def read_json(text: str) -> Solutions | bool:
    doc = json.loads(text)
    if "boolean" in doc:
        return doc["boolean"]

    def term(x: dict) -> object:
        if x["type"] == "uri":
            return IRI(x["value"])
        if x["type"] == "bnode":
            return BNode(x["value"])
        if x["type"] == "triple":
            return R.TripleTerm(*[term(x["value"][k]) for k in ("subject", "predicate", "object")])
        return Literal(x["value"], x.get("xml:lang", ""), x.get("its:dir", ""), x.get("datatype", R.STRING))

    return doc["head"]["vars"], [{v: term(t) for v, t in r.items()} for r in doc["results"]["bindings"]]


def read_result_set(quads: list[Quad]) -> Solutions | bool:
    """Solutions that are described with the rs: vocabulary, in the order of rs:index where there is one."""
    out: dict[object, dict[str, list]] = {}
    for q in quads:
        out.setdefault(q.s, {}).setdefault(q.p.value, []).append(q.o)
    me = next((s for s, ps in out.items() if IRI(_RS + "ResultSet") in ps.get(R.TYPE, [])), None)
    if me is None:
        raise ValueError("no rs:ResultSet")
    if flag := out[me].get(_RS + "boolean"):
        return flag[0].value == "true"
    names = [x.value for x in out[me].get(_RS + "resultVariable", [])]
    found = sorted(out[me].get(_RS + "solution", []), key=lambda s: int(out[s].get(_RS + "index", [Literal("0")])[0].value))
    bindings = [[out[b] for b in out.get(s, {}).get(_RS + "binding", [])] for s in found]
    return names, [{b[_RS + "variable"][0].value: b[_RS + "value"][0] for b in row} for row in bindings]
