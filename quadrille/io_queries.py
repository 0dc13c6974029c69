"""Registered queries of what goes in and out: readers, the store, result formats, comparison. Files are written from the
tables by Spark itself to the shared folder and read back, so that SQL over the same tables says what must come out."""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as R
from .engine import Engine
from .http import Endpoint
from .results import compare, read, write
from .shared import shared_path
from .sources.files import parse_text, read_rdf
from .store import QuadStore
from .terms import IRI, BNode, Literal, Quad

_X = "http://ex/"
_INT = "^^<http://www.w3.org/2001/XMLSchema#integer>"
_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_REIFIES = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies>"
#: Tables that are written as files: key, name, foreign key, where that points to.
_SHAPES = {"customer": ("c_custkey", "c_name", "c_nationkey", "nation"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "nation"), "nation": ("n_nationkey", "n_name", "n_regionkey", "region")}
Query = Callable[[SparkSession, str], DataFrame]


def _fill(text: str, table: str) -> Column:
    """A line for each row: KEY, NAME and REF stand for its columns, T for the table and U for where REF points to."""
    key, name, ref, target = _SHAPES[table]
    parts: list[Column] = []
    for i, x in enumerate(text.replace("<T>", table).replace("<U>", target).replace("<name>", name).replace("<ref>", ref).replace("<key>", key).split("@@")):
        parts.append(F.lit(x) if i % 2 == 0 else F.col({"KEY": key, "NAME": name, "REF": ref}[x]).cast("string"))
    return F.concat(*parts).alias("value")


def _written(spark: SparkSession, folder: str, table: str, line: str, ending: str, around: tuple[str, str] | None = None, between: str = "") -> str:
    """The path of files with a line for each row of a table; with around, one document."""
    path = shared_path(spark, f"io-{ending}")
    lines = spark.read.parquet(f"{folder}/{table}.parquet").select(_fill(line, table))
    if around is not None:
        lines = lines.agg(F.concat(F.lit(around[0]), F.array_join(F.sort_array(F.collect_list("value")), between), F.lit(around[1])).alias("value"))
    lines.write.text(path)
    return path


def _shown(quads: DataFrame, graph: bool = False) -> DataFrame:
    """Quads as the canonical forms of their terms."""
    cols = [R.n3_column(F.col("s")).alias("s"), F.concat(F.lit("<"), F.col("p"), F.lit(">")).alias("p"), R.n3_column(F.col("o")).alias("o")]
    return quads.select(*cols, *([R.n3_column(F.col("g")).alias("g")] if graph else []))


def _triples_sql(table: str, graph: str = "") -> str:
    key, name, ref, target = _SHAPES[table]
    s, tail = f"'<{_X}{table}/' || {key} || '>'", f", {graph} AS g" if graph else ""
    rows = [(f"'{_TYPE}'", f"'<{_X}{table.capitalize()}>'"), (f"'<{_X}{table}#{key}>'", f"'\"' || {key} || '\"{_INT}'"), (f"'<{_X}{table}#{name}>'", f"'\"' || {name} || '\"'"), (f"'<{_X}{table}#{ref}>'", f"'<{_X}{target}/' || {ref} || '>'")]
    return " UNION ALL ".join(f"SELECT {s} AS s, {p} AS p, {o} AS o{tail} FROM {table}" for p, o in rows)


_S = f"<{_X}<T>/@@KEY@@>"
_FULL = [f"{_TYPE} <{_X}TYPE>", f'<{_X}<T>#<key>> "@@KEY@@"{_INT}', f'<{_X}<T>#<name>> "@@NAME@@"', f"<{_X}<T>#<ref>> <{_X}<U>/@@REF@@>"]


def _statements(table: str, graph: str = "") -> str:
    return "\n".join(f"{_S} {x.replace('TYPE', table.capitalize())} {graph}." for x in _FULL)


def _reader(table: str, line: str, ending: str, around: tuple[str, str] | None = None, between: str = "", graph: bool = False, **options: object) -> Query:
    return lambda spark, folder: _shown(read_rdf(spark, _written(spark, folder, table, line, ending, around, between), ending, **options), graph)


_PREFIX = f"PREFIX x: <{_X}> PREFIX t: <{_X}<T>#> "
_BODY = "a x:TYPE ; t:<key> @@KEY@@ ; t:<name> \"@@NAME@@\" ; t:<ref> <" + _X + "<U>/@@REF@@>"
_XML = (
    f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{R.RDF}" xmlns:x="{_X}" xmlns:t="{_X}supplier#">\n',
    "\n</rdf:RDF>",
)
_XML_ROW = f'<x:Supplier rdf:about="{_X}<T>/@@KEY@@"><t:<key> rdf:datatype="{R.INTEGER}">@@KEY@@</t:<key>><t:<name>>@@NAME@@</t:<name>><t:<ref> rdf:resource="{_X}<U>/@@REF@@"/></x:Supplier>'
_JSON = ('{"@context": {"x": "http://ex/", "t": "http://ex/supplier#"}, "@graph": [\n', "\n]}")
_JSON_ROW = f'{{"@id": "{_X}<T>/@@KEY@@", "@type": "x:Supplier", "t:<key>": @@KEY@@, "t:<name>": ["@@NAME@@"], "t:<ref>": {{"@id": "{_X}<U>/@@REF@@"}}}}'
_ANNOTATED = f'<{_X}<T>/@@KEY@@> <{_X}<T>#<name>> "@@NAME@@" ~ <{_X}claim/@@KEY@@> {{| <{_X}by> <{_X}<U>/@@REF@@> |}} .'


def _nation_quads(spark: SparkSession, folder: str) -> DataFrame:
    return read_rdf(spark, _written(spark, folder, "nation", _statements("nation"), "nt"), "ntriples")


def _customer_quads(spark: SparkSession, folder: str) -> DataFrame:
    return read_rdf(spark, _written(spark, folder, "customer", _statements("customer"), "nt"), "ntriples")


def _store(spark: SparkSession, quads: DataFrame | None = None) -> QuadStore:
    store = QuadStore(spark, shared_path(spark, "store"))
    if quads is not None:
        store.insert(quads)
    return store


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# the store


def store_match(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, _customer_quads(spark, folder))
    return _shown(store.match(p=IRI(f"{_X}customer#c_nationkey"), o=IRI(f"{_X}nation/7")))


def store_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches that overlap: all, then those of one predicate again and in a named graph."""
    quads = _customer_quads(spark, folder)
    store = _store(spark, quads)
    names = quads.where(F.col("p") == f"{_X}customer#c_name")
    store.insert(names.unionByName(names.withColumn("g", R.constant(IRI(f"{_X}g")))))
    return store.quads.groupBy("p", F.col("g.v").alias("g")).agg(F.count(F.lit(1)).alias("n"))


def store_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A batch is deleted, and a part of it inserted again."""
    quads = _customer_quads(spark, folder)
    store = _store(spark, quads)
    names = quads.where(F.col("p") == f"{_X}customer#c_name")
    store.delete(names)
    store.insert(names.where(F.col("o.v").endswith("7")))
    return _shown(store.quads)


def store_contains(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, _nation_quads(spark, folder))
    asked = [Quad(IRI(f"{_X}nation/3"), IRI(R.TYPE), IRI(f"{_X}Nation")), Quad(IRI(f"{_X}nation/99"), IRI(R.TYPE), IRI(f"{_X}Nation")), Quad(IRI(f"{_X}nation/3"), IRI(R.TYPE), IRI(f"{_X}Nation"), IRI(f"{_X}g")), Quad(IRI(f"{_X}nation/3"), IRI(f"{_X}nation#n_name"), Literal("NATION_3"))]
    return _rows(spark, [(i, store.contains(q)) for i, q in enumerate(asked)], "i int, there boolean")


def store_count(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, [(_store(spark, _customer_quads(spark, folder)).count(),)], "n long")


def store_isolation(spark: SparkSession, folder: str) -> DataFrame:
    """A reader that was opened before a deletion, an insertion and a compaction still has what it began with."""
    quads = _nation_quads(spark, folder)
    store = _store(spark, quads)
    before = store.quads
    store.delete(quads.where(F.col("p") == f"{_X}nation#n_name"))
    middle = store.quads
    store.insert([Quad(IRI(f"{_X}new"), IRI(f"{_X}p"), Literal("x"))])
    store.compact()
    return _rows(spark, [("before", before.count()), ("middle", middle.count()), ("after", store.count())], "reader string, n long")


def upload(spark: SparkSession, folder: str) -> DataFrame:
    """A document that is sent to the endpoint's /data."""
    nation = spark.read.parquet(f"{folder}/nation.parquet").select(_fill(_PREFIX + _S + " " + _BODY.replace("TYPE", "Nation") + " .", "nation"))
    store = _store(spark)
    status, _, body = Endpoint(store=store).upload("\n".join(r[0] for r in nation.collect()).encode(), "text/turtle")  # 25 rows
    if status != 200:
        raise ValueError(body)
    return _shown(store.quads)


# result formats

_SELECT = "PREFIX n: <http://ex/nation#> SELECT ?k ?n ?r { ?x n:n_nationkey ?k ; n:n_regionkey ?r OPTIONAL { ?x n:n_name ?n FILTER(?k > 4) } } ORDER BY ?k"
_ASK = "PREFIX n: <http://ex/nation#> ASK { ?x n:n_name 'NATION_3' }"


def _text(query: str, media: str, cut: Callable[[str], list[str]]) -> Query:
    """The lines of a serialised result, numbered."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        text = Engine.over_tables(spark, folder).sparql(query).serialize(media)
        return _rows(spark, list(enumerate(cut(text))), "i int, line string")

    return run


def _bindings(text: str) -> list[str]:
    doc = json.loads(text)
    return [json.dumps(x, separators=(",", ":")) for x in [doc["head"], *doc.get("results", {}).get("bindings", []), *([doc["boolean"]] if "boolean" in doc else [])]]


def _numbered(head: str, line: str, tail: str = "") -> str:
    return f"SELECT 0 AS i, {head} AS line UNION ALL SELECT n_nationkey + 1, {line} FROM nation" + (f" UNION ALL {tail}" if tail else "")


_OPT = "CASE WHEN n_nationkey > 4 THEN {} ELSE '' END"
_I = R.INTEGER


def _files(form: str, reader: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = shared_path(spark, f"result-{form}")
        Engine.over_tables(spark, folder).sparql("PREFIX c: <http://ex/customer#> SELECT ?k ?n { ?x c:c_custkey ?k ; c:c_name ?n }").write(path, form)
        return reader(spark, path)

    return run


def read_result_xml(spark: SparkSession, folder: str) -> DataFrame:
    names, rows = read.read_xml(Engine.over_tables(spark, folder).sparql(_SELECT).serialize("xml"))
    return _rows(spark, [tuple(None if v not in r else R.n3(r[v]) for v in names) for r in rows], ", ".join(f"{v} string" for v in names))


def read_result_json(spark: SparkSession, folder: str) -> DataFrame:
    names, rows = read.read_json(Engine.over_tables(spark, folder).sparql(_SELECT).serialize("json"))
    return _rows(spark, [tuple(None if v not in r else R.n3(r[v]) for v in names) for r in rows], ", ".join(f"{v} string" for v in names))


def read_result_rdf(spark: SparkSession, folder: str) -> DataFrame:
    """Solutions that are described with the vocabulary of result sets."""
    row = 'rs:solution [ rs:index @@KEY@@ ; rs:binding [ rs:variable "k" ; rs:value @@KEY@@ ], [ rs:variable "n" ; rs:value "@@NAME@@" ] ]'
    rows = spark.read.parquet(f"{folder}/nation.parquet").select(_fill(row, "nation")).collect()  # 25 rows
    text = "PREFIX rs: <http://www.w3.org/2001/sw/DataAccess/tests/result-set#> [] a rs:ResultSet ; rs:resultVariable \"k\", \"n\" ; " + " ; ".join(r[0] for r in rows) + " ."
    _, found = read.read_result_set(parse_text(text, "turtle"))
    return _rows(spark, [(i, R.n3(r["k"]), R.n3(r["n"])) for i, r in enumerate(found)], "i int, k string, n string")


def canonical_nquads(spark: SparkSession, folder: str) -> DataFrame:
    line = _statements("customer", f"<{_X}graph/<T>> ")
    return write.canonical_lines(read_rdf(spark, _written(spark, folder, "customer", line, "nq"), "nquads"))


_ACCEPTS = {"": write.JSON, "*/*": write.JSON, "text/csv": write.CSV, "application/sparql-results+xml, text/csv": write.XML, "application/json": write.JSON, "text/xml": write.XML, "text/tab-separated-values;q=1": write.TSV, "application/sparql-results+json": write.JSON}


def negotiation(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, [(a, write.negotiate(a)) for a in _ACCEPTS], "accept string, media string")


def command_line(spark: SparkSession, folder: str) -> DataFrame:
    """What the shell command prints for a query over the tables."""
    from .__main__ import main

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        main(["--tables", folder, "query", "PREFIX n: <http://ex/nation#> SELECT ?k ?n { ?x n:n_nationkey ?k ; n:n_name ?n } ORDER BY ?k"])
    return _rows(spark, list(enumerate(out.getvalue().splitlines())), "i int, line string")


# comparison


def isomorphism(spark: SparkSession, folder: str) -> DataFrame:
    """Graphs, datasets and solutions made of the nations with blank nodes for subjects, under other names, in another
    order, and with one thing changed."""
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows
    p = lambda x: IRI(f"{_X}{x}")
    graph = lambda tag, g=None, wrong=False: [q for k, n, r in rows for q in (Quad(BNode(f"{tag}{k}"), p("name"), Literal(n + "!" * (wrong and k == 3)), g), Quad(BNode(f"{tag}{k}"), p("in"), BNode(f"{tag}r{r}"), g))]
    solutions = lambda tag, extra=0: [{"x": BNode(f"{tag}{k % (5 + extra)}"), "n": Literal(n)} for k, n, _ in rows]
    found = [
        ("graph_renamed", compare.isomorphic(graph("a"), graph("b")[::-1])),
        ("graph_changed", compare.isomorphic(graph("a"), graph("b", wrong=True))),
        ("dataset_renamed", compare.isomorphic(graph("a", BNode("g")), graph("b", BNode("h")))),
        ("dataset_moved", compare.isomorphic(graph("a", p("g")), graph("b", p("h")))),
        ("solutions_renamed", compare.same_solutions(solutions("a"), solutions("b")[::-1])),
        ("solutions_merged", compare.same_solutions(solutions("a"), solutions("b", 1))),
    ]
    return _rows(spark, found, "what string, same boolean")


# terms of mixed kinds, in a table of quads


def _kinds(function: str) -> Query:
    """How many objects of each predicate a function is true of; of nations whose regions are blank nodes."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        quads = _nation_quads(spark, folder)
        blank = R.struct(R.K_BNODE, F.concat(F.lit("r"), F.regexp_extract("o.v", r"(\d+)$", 1)))
        quads = quads.withColumn("o", F.when(F.col("p") == f"{_X}nation#n_regionkey", blank).otherwise(F.col("o")))
        return Engine.over_quads(quads).query(f"SELECT ?p (COUNT(*) AS ?n) {{ ?s ?p ?o FILTER({function}) }} GROUP BY ?p")

    return run


def fn_datatype_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return Engine.over_quads(_nation_quads(spark, folder)).query("SELECT ?p ?d (COUNT(*) AS ?n) { ?s ?p ?o BIND(DATATYPE(?o) AS ?d) } GROUP BY ?p ?d")


def _kinds_sql(*columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{R.TYPE if c == 'type' else f'{_X}nation#{c}'}' AS p, count(*) AS n FROM nation" for c in columns)


_N, _C, _SUP = _triples_sql("nation"), _triples_sql("customer"), _triples_sql("supplier")
_SOLUTIONS = f"SELECT '\"' || n_nationkey || '\"{_INT}' AS k, CASE WHEN n_nationkey > 4 THEN '\"' || n_name || '\"' END AS n, '<http://ex/region/' || n_regionkey || '>' AS r FROM nation"
_ASKED = "(SELECT CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END FROM nation WHERE n_name = 'NATION_3')"
#: name: (query, SQL)
IO: dict[str, tuple[Query, str]] = {
    "read_ntriples": (_reader("customer", _statements("customer"), "nt", lenient=True), _C),
    "read_ntriples_strict": (_reader("customer", _statements("customer"), "nt"), _C),
    "read_nquads": (_reader("customer", _statements("customer", f"<{_X}graph/<T>> "), "nq", graph=True), _triples_sql("customer", f"'<{_X}graph/customer>'")),
    "read_turtle": (_reader("customer", _PREFIX + _S + " " + _BODY.replace("TYPE", "Customer") + " .", "ttl"), _C),
    "read_trig": (_reader("customer", _PREFIX + f"GRAPH x:g@@REF@@ {{ {_S} {_BODY.replace('TYPE', 'Customer')} }}", "trig", graph=True), _triples_sql("customer", f"'<{_X}g' || c_nationkey || '>'")),
    "read_rdfxml": (_reader("supplier", _XML_ROW, "rdf", _XML, "\n"), _SUP),
    "read_jsonld": (_reader("supplier", _JSON_ROW, "jsonld", _JSON, ",\n"), _SUP),
    "read_annotations": (
        _reader("supplier", _ANNOTATED, "ttl"),
        f"SELECT '<{_X}supplier/' || s_suppkey || '>' AS s, '<{_X}supplier#s_name>' AS p, '\"' || s_name || '\"' AS o FROM supplier UNION ALL SELECT '<{_X}claim/' || s_suppkey || '>', '{_REIFIES}', '<<( <{_X}supplier/' || s_suppkey || '> <{_X}supplier#s_name> \"' || s_name || '\" )>>' FROM supplier UNION ALL SELECT '<{_X}claim/' || s_suppkey || '>', '<{_X}by>', '<{_X}nation/' || s_nationkey || '>' FROM supplier",
    ),
    "read_result_xml": (read_result_xml, _SOLUTIONS),
    "read_result_json": (read_result_json, _SOLUTIONS),
    "read_result_rdf": (read_result_rdf, f"SELECT n_nationkey AS i, '\"' || n_nationkey || '\"{_INT}' AS k, '\"' || n_name || '\"' AS n FROM nation"),
    "upload": (upload, _N),
    "store_match": (store_match, f"SELECT '<{_X}customer/' || c_custkey || '>' AS s, '<{_X}customer#c_nationkey>' AS p, '<{_X}nation/7>' AS o FROM customer WHERE c_nationkey = 7"),
    "store_insert": (store_insert, f"SELECT p, g, count(*) AS n FROM customer, (VALUES ('{R.TYPE}', NULL), ('{_X}customer#c_custkey', NULL), ('{_X}customer#c_nationkey', NULL), ('{_X}customer#c_name', NULL), ('{_X}customer#c_name', '{_X}g')) t(p, g) GROUP BY p, g"),
    "store_delete": (store_delete, f"SELECT * FROM ({_C}) WHERE p <> '<{_X}customer#c_name>' OR o LIKE '%7\"'"),
    "store_contains": (store_contains, "SELECT 0 AS i, count(*) > 0 AS there FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 1, count(*) > 0 FROM nation WHERE n_nationkey = 99 UNION ALL SELECT 2, false UNION ALL SELECT 3, count(*) > 0 FROM nation WHERE n_nationkey = 3 AND n_name = 'NATION_3'"),
    "store_count": (store_count, "SELECT 4 * count(*) AS n FROM customer"),
    "store_isolation": (store_isolation, "SELECT 'before' AS reader, 4 * count(*) AS n FROM nation UNION ALL SELECT 'middle', 3 * count(*) FROM nation UNION ALL SELECT 'after', 3 * count(*) + 1 FROM nation"),
    "select_json": (
        _text(_SELECT, "json", _bindings),
        _numbered("'{\"vars\":[\"k\",\"n\",\"r\"]}'", f"'{{\"k\":{{\"type\":\"literal\",\"value\":\"' || n_nationkey || '\",\"datatype\":\"{_I}\"}}' || " + _OPT.format("',\"n\":{\"type\":\"literal\",\"value\":\"' || n_name || '\"}'") + " || ',\"r\":{\"type\":\"uri\",\"value\":\"http://ex/region/' || n_regionkey || '\"}}'"),
    ),
    "select_xml": (
        _text(_SELECT, "xml", lambda t: [x for x in t.splitlines() if x.startswith(("<head>", "<result>"))]),
        _numbered("'<head><variable name=\"k\"/><variable name=\"n\"/><variable name=\"r\"/></head>'", f"'<result><binding name=\"k\"><literal datatype=\"{_I}\">' || n_nationkey || '</literal></binding>' || " + _OPT.format("'<binding name=\"n\"><literal>' || n_name || '</literal></binding>'") + " || '<binding name=\"r\"><uri>http://ex/region/' || n_regionkey || '</uri></binding></result>'"),
    ),
    "select_csv": (_text(_SELECT, "csv", lambda t: t.split("\r\n")[:-1]), _numbered("'k,n,r'", f"n_nationkey || ',' || {_OPT.format('n_name')} || ',http://ex/region/' || n_regionkey")),
    "select_tsv": (_text(_SELECT, "tsv", lambda t: t.split("\n")[:-1]), _numbered("'?k' || chr(9) || '?n' || chr(9) || '?r'", f"n_nationkey || chr(9) || {_OPT.format(chr(39) + chr(34) + chr(39) + ' || n_name || ' + chr(39) + chr(34) + chr(39))} || chr(9) || '<http://ex/region/' || n_regionkey || '>'")),
    "ask_json": (_text(_ASK, "json", _bindings), f"SELECT 0 AS i, '{{}}' AS line UNION ALL SELECT 1, {_ASKED}"),
    "ask_xml": (_text(_ASK, "xml", lambda t: [x for x in t.splitlines() if "boolean" in x]), f"SELECT 0 AS i, '<boolean>' || {_ASKED} || '</boolean>' AS line"),
    "ask_csv": (_text(_ASK, "csv", lambda t: t.split("\r\n")[:-1]), f"SELECT 0 AS i, 'result' AS line UNION ALL SELECT 1, {_ASKED}"),
    "ask_tsv": (_text(_ASK, "tsv", lambda t: t.split("\n")[:-1]), f"SELECT 0 AS i, '?result' AS line UNION ALL SELECT 1, {_ASKED}"),
    "files_csv": (_files("csv", lambda s, p: s.read.option("header", True).csv(p)), "SELECT c_custkey::VARCHAR AS k, c_name AS n FROM customer"),
    "files_tsv": (_files("tsv", lambda s, p: s.read.option("header", True).option("sep", "\t").option("quote", "").csv(p).toDF("k", "n")), "SELECT c_custkey::VARCHAR AS k, '\"' || c_name || '\"' AS n FROM customer"),
    "canonical_nquads": (canonical_nquads, f"SELECT s || ' ' || p || ' ' || o || ' <{_X}graph/customer> .' AS value FROM ({_C})"),
    "negotiation": (negotiation, "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{m}')" for a, m in _ACCEPTS.items()) + ") t(accept, media)"),
    "command_line": (command_line, "SELECT 0 AS i, '?k' || chr(9) || '?n' AS line UNION ALL SELECT n_nationkey + 1, n_nationkey || chr(9) || '\"' || n_name || '\"' FROM nation"),
    "isomorphism": (isomorphism, "SELECT * FROM (VALUES ('graph_renamed', true), ('graph_changed', false), ('dataset_renamed', true), ('dataset_moved', false), ('solutions_renamed', true), ('solutions_merged', false)) t(what, same)"),
    "fn_isiri": (_kinds("isIRI(?o)"), _kinds_sql("type")),
    "fn_isblank": (_kinds("isBlank(?o)"), _kinds_sql("n_regionkey")),
    "fn_isliteral": (_kinds("isLiteral(?o)"), _kinds_sql("n_nationkey", "n_name")),
    "fn_isnumeric": (_kinds("isNumeric(?o)"), _kinds_sql("n_nationkey")),
    "fn_datatype": (fn_datatype_mixed, f"SELECT '{R.TYPE}' AS p, NULL::VARCHAR AS d, count(*) AS n FROM nation UNION ALL SELECT '{_X}nation#n_regionkey', NULL, count(*) FROM nation UNION ALL SELECT '{_X}nation#n_name', '{R.STRING}', count(*) FROM nation UNION ALL SELECT '{_X}nation#n_nationkey', '{R.INTEGER}', count(*) FROM nation"),
}
