"""Results as text: SPARQL JSON, XML, CSV and TSV for solutions and ASK, N-Triples and N-Quads for graphs.

`serialize` makes one string on the driver, for results that a person or an HTTP client reads; `write` makes files from the
executors, for results of any size, with rows rendered by JVM expressions."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as R
from ..terms import BNode, IRI, Literal, n3

JSON, XML, CSV, TSV, NTRIPLES = "application/sparql-results+json", "application/sparql-results+xml", "text/csv", "text/tab-separated-values", "application/n-triples"
#: In the order in which an Accept header is searched for them.
_ACCEPT = ((("sparql-results+xml",), XML), (("sparql-results+json",), JSON), (("text/csv",), CSV), (("tab-separated-values",), TSV), (("json",), JSON), (("xml",), XML))


def negotiate(accept: str | None) -> str:
    """The media type of solutions for an Accept header: the first known one that it mentions, else JSON."""
    accept = (accept or "").lower()
    return next((media for words, media in _ACCEPT if any(w in accept for w in words)), JSON)


def media_of(name: str) -> str:
    short = {"json": JSON, "xml": XML, "csv": CSV, "tsv": TSV, "ntriples": NTRIPLES, "nt": NTRIPLES}
    return short.get(name.lower(), name.split(";")[0].strip().lower())


class _Labels:
    """Blank nodes under names of their own, in order of appearance."""

    def __init__(self) -> None:
        self.known: dict[str, str] = {}

    def __call__(self, node: BNode) -> str:
        return self.known.setdefault(node.label, f"b{len(self.known)}")


def _json_term(t: object, label: _Labels) -> dict:
    if isinstance(t, IRI):
        return {"type": "uri", "value": t.value}
    if isinstance(t, BNode):
        return {"type": "bnode", "value": label(t)}
    if isinstance(t, R.TripleTerm):
        return {"type": "triple", "value": {k: _json_term(x, label) for k, x in zip(("subject", "predicate", "object"), t)}}
    out = {"type": "literal", "value": t.value}
    if t.lang:
        out["xml:lang"] = t.lang
        if t.direction:
            out["its:dir"] = t.direction
    elif t.datatype != R.STRING:
        out["datatype"] = t.datatype
    return out


def _xml_term(t: object, label: _Labels) -> str:
    if isinstance(t, IRI):
        return f"<uri>{escape(t.value)}</uri>"
    if isinstance(t, BNode):
        return f"<bnode>{label(t)}</bnode>"
    if isinstance(t, R.TripleTerm):
        parts = "".join(f"<{k}>{_xml_term(x, label)}</{k}>" for k, x in zip(("subject", "predicate", "object"), t))
        return f"<triple>{parts}</triple>"
    attribute = ""
    if t.lang:
        attribute = f" xml:lang={quoteattr(t.lang)}"
        if t.direction:
            attribute += f" its:dir={quoteattr(t.direction)}"
    elif t.datatype != R.STRING:
        attribute = f" datatype={quoteattr(t.datatype)}"
    return f"<literal{attribute}>{escape(t.value)}</literal>"


_BARE = {R.INTEGER: re.compile(r"[+-]?\d+"), R.DECIMAL: re.compile(r"[+-]?\d*\.\d+"), R.DOUBLE: re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+")}


def _tsv_term(t: object, label: _Labels) -> str:
    if t is None:
        return ""
    if isinstance(t, BNode):
        return f"_:{label(t)}"
    if isinstance(t, Literal) and not t.lang and (form := _BARE.get(t.datatype)) and form.fullmatch(t.value):
        return t.value
    return n3(t)


def _csv_term(t: object, label: _Labels) -> str:
    if t is None:
        return ""
    if isinstance(t, BNode):
        return f"_:{label(t)}"
    return n3(t) if isinstance(t, R.TripleTerm) else t.value


def select_text(variables: list[str], rows: Iterable[dict[str, object]], media: str) -> str:
    """Solutions in a media type."""
    label = _Labels()
    if media == JSON:
        found = [{v: _json_term(t, label) for v, t in r.items()} for r in rows]
        return json.dumps({"head": {"vars": variables}, "results": {"bindings": found}}, indent=2, ensure_ascii=False)
    if media == XML:
        head = "".join(f"<variable name={quoteattr(v)}/>" for v in variables)
        body = "".join("<result>" + "".join(f"<binding name={quoteattr(v)}>{_xml_term(r[v], label)}</binding>" for v in variables if v in r) + "</result>\n" for r in rows)
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#" xmlns:its="http://www.w3.org/2005/11/its">\n<head>{head}</head>\n<results>\n{body}</results>\n</sparql>\n'
    if media == TSV:
        lines = ["\t".join("?" + v for v in variables), *["\t".join(_tsv_term(r.get(v), label) for v in variables) for r in rows]]
        return "\n".join(lines) + "\n"
    if media == CSV:
        out = io.StringIO()
        w = csv.writer(out)  # ends lines with CR LF, as the format wants
        w.writerow(variables)
        w.writerows([_csv_term(r.get(v), label) for v in variables] for r in rows)
        return out.getvalue()
    raise ValueError(f"no writer of solutions as {media}")


def ask_text(answer: bool, media: str) -> str:
    word = "true" if answer else "false"
    if media == JSON:
        return json.dumps({"head": {}, "boolean": answer}, indent=2)
    if media == XML:
        return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head/>\n<boolean>{word}</boolean>\n</sparql>\n'
    if media == CSV:
        return f"result\r\n{word}\r\n"
    if media == TSV:
        return f"?result\n{word}\n"
    raise ValueError(f"no writer of answers as {media}")


def serialize(result, media: str) -> str:  # noqa: ANN001
    """A whole result as text; CONSTRUCT and DESCRIBE are N-Triples whatever the media type."""
    media = media_of(media)
    if result.kind == "ASK":
        return ask_text(result.boolean(), media)
    if result.kind == "SELECT":
        return select_text(result.variables, result.bindings(), media)
    rows = result.triples().select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line")).collect()
    return "".join(r[0] + "\n" for r in rows)


def canonical_lines(quads: DataFrame) -> DataFrame:
    """One column, `value`: each quad (or triple, without g) as a canonical line."""
    parts = [R.n3_column(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")) if dict(quads.dtypes)["p"] == "string" else R.n3_column(F.col("p")), R.n3_column(F.col("o"))]
    if "g" in quads.columns:
        parts.append(R.n3_column(F.col("g")))
    return quads.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


def canonical(quads: Iterable[R.Quad]) -> str:
    """Quads as canonical N-Quads (N-Triples for the default graph), in the order given."""
    return "".join(" ".join(n3(x) for x in q if x is not None) + " .\n" for q in quads)


def _tsv_column(t: Column) -> Column:
    bare = F.lit(False)
    for kind, form in _BARE.items():
        bare = bare | ((t["dt"] == kind) & t["v"].rlike(f"^(?:{form.pattern})$"))
    return F.coalesce(F.when((t["k"] == R.K_LITERAL) & bare, t["v"]).otherwise(R.n3_column(t)), F.lit(""))


def write(result, path: str, form: str) -> None:  # noqa: ANN001
    """Files of a result, one for each partition. csv and tsv files each begin with the head."""
    if form == "parquet":
        result.terms().write.parquet(path)
    elif form in ("ntriples", "nt"):
        canonical_lines(result.terms()).write.text(path)
    elif form == "csv":
        df = result.terms()
        plain = [F.when(F.col(f"`{v}`")["k"] == R.K_BNODE, F.concat(F.lit("_:"), F.col(f"`{v}`")["v"])).otherwise(F.col(f"`{v}`")["v"]).alias(v) for v in result.variables]
        df.select(*plain).write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
    elif form == "tsv":
        df = result.terms().select(*[_tsv_column(F.col(f"`{v}`")).alias("?" + v) for v in result.variables])
        # tabs and line ends in literals are escaped already, so fields need no quotes
        df.write.option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    else:
        raise ValueError(f"no writer of files as {form}")
