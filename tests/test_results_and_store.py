"""Result formats, the store, the endpoint, the stream of files and the registered queries."""

import json
import threading
import urllib.request
from urllib.error import HTTPError
from urllib.parse import quote

import pytest

import __spark_entry__ as registry
from quadrille import BNode, Engine, IRI, Literal, Quad, QuadStore, TripleTerm
from quadrille.http import Endpoint
from quadrille.results import read, write
from quadrille.results.compare import same_solutions
from quadrille.sources.files import parse_text
from quadrille.streaming.ingest import ingest
from quadrille.terms import DECIMAL, DOUBLE, INTEGER, QUADS

E = "http://e/"
iri = lambda x: IRI(E + x)
ROWS = [
    {"a": IRI("http://x/?a=1&b=<2>".replace("<2>", "2")), "b": Literal('q"uo, te\n<&>')}, {"a": BNode("n1"), "b": Literal("x", "en")}, {"b": Literal("5", datatype=INTEGER)}, {"a": BNode("n1"), "b": BNode("n2")},
    {"a": Literal("1.5", datatype=DECIMAL), "b": Literal("1.0E6", datatype=DOUBLE)}, {"a": Literal("bad", datatype=INTEGER), "b": TripleTerm(iri("s"), iri("p"), Literal("o", "ar", "rtl"))},
]


def test_json_and_xml_round_trips():
    for media, reader in ((write.JSON, read.read_json), (write.XML, read.read_xml)):
        names, got = reader(write.select_text(["a", "b"], ROWS, media))
        assert names == ["a", "b"] and same_solutions(got, ROWS)
        assert reader(write.ask_text(True, media)) is True and reader(write.ask_text(False, media)) is False


def test_csv_and_tsv():
    lines = write.select_text(["a", "b"], ROWS, write.TSV).split("\n")
    assert lines[0] == "?a\t?b" and lines[1].endswith('"q\\"uo, te\\n<&>"') and lines[2] == '_:b0\t"x"@en' and lines[3] == "\t5" and lines[4] == "_:b0\t_:b1" and lines[5] == "1.5\t1.0E6"
    text = write.select_text(["a", "b"], ROWS, write.CSV)
    assert text.startswith('a,b\r\nhttp://x/?a=1&b=2,"q""uo, te\n<&>"\r\n_:b0,x\r\n,5\r\n')
    assert write.ask_text(True, write.CSV) == "result\r\ntrue\r\n" and write.ask_text(False, write.TSV) == "?result\nfalse\n"


def test_negotiation():
    for accept, want in {"": write.JSON, "*/*": write.JSON, "text/csv": write.CSV, "application/sparql-results+xml, text/csv": write.XML, "application/json": write.JSON, "text/xml": write.XML, "text/tab-separated-values;q=1": write.TSV}.items():
        assert write.negotiate(accept) == want


def test_result_sets_in_rdf():
    text = """PREFIX rs: <http://www.w3.org/2001/sw/DataAccess/tests/result-set#> [] a rs:ResultSet ; rs:resultVariable "x" ;
    rs:solution [ rs:index 2 ; rs:binding [ rs:variable "x" ; rs:value 2 ] ], [ rs:index 1 ; rs:binding [ rs:variable "x" ; rs:value <http://e/a> ] ] ."""
    assert read.read_result_set(parse_text(text, "turtle")) == (["x"], [{"x": iri("a")}, {"x": Literal("2", datatype=INTEGER)}])


def test_canonical_lines_are_the_same_in_python_and_in_columns(spark):
    quads = [Quad(iri("s"), iri("p"), Literal('\t"\\\n\x01\x7f é￾')), Quad(BNode("b"), iri("p"), Literal("x", "EN", "LTR"), iri("g")), Quad(iri("s"), iri("p"), Literal("5", datatype=INTEGER)), Quad(iri("s"), iri("p"), TripleTerm(iri("a"), iri("b"), Literal("c")))]
    df = spark.createDataFrame([q.row() for q in quads], QUADS).coalesce(1)
    text = write.canonical(quads)
    assert "".join(r.value + "\n" for r in write.canonical_lines(df).collect()) == text
    assert '"x"@en--ltr' in text and "\\u0001\\u007F" in text and "é" in text


def test_files_of_a_result(spark, tmp_path):
    e = Engine.over_quads(spark.createDataFrame([Quad(iri("s"), iri("p"), Literal('a"b,\tc')).row(), Quad(iri("s"), iri("p"), Literal("5", datatype=INTEGER)).row()], QUADS).coalesce(1))
    r = e.sparql("SELECT ?s ?o { ?s ?p ?o }")
    for form in ("csv", "tsv", "parquet"):
        r.write(str(tmp_path / form), form)
    body = lambda f: "".join(p.read_text() for p in sorted((tmp_path / f).glob("part-*")))
    assert '"a""b,\tc"' in body("csv") and body("csv").startswith("s,o")
    assert body("tsv").splitlines() == ["?s\t?o", '<http://e/s>\t"a\\"b,\\tc"', "<http://e/s>\t5"]
    e.sparql("CONSTRUCT WHERE { ?s ?p ?o }").write(str(tmp_path / "nt"), "ntriples")
    assert len(parse_text(body("nt"), "ntriples")) == 2


def test_store_is_a_set_with_atomic_batches(spark, tmp_path):
    store = QuadStore(spark, f"file://{tmp_path}/store")
    assert store.count() == 0 and not store.contains(Quad(iri("a"), iri("p"), iri("b")))
    store.insert([Quad(iri("a"), iri("p"), iri("b")), Quad(iri("a"), iri("p"), Literal("1", datatype=INTEGER)), Quad(iri("c"), iri("p"), iri("d"), iri("g"))])
    store.insert([Quad(iri("a"), iri("p"), iri("b")), Quad(iri("a"), iri("p"), iri("b"), iri("g"))])
    assert store.count() == 4 and store.match().count() == 2 and store.match(g=iri("g")).count() == 2 and store.match(any_graph=True).count() == 4
    assert store.contains(Quad(iri("a"), iri("p"), iri("b"))) and store.match(s=iri("a"), o=Literal("1", datatype=INTEGER)).count() == 1 and store.match(p=iri("q")).count() == 0
    before = store.quads
    store.delete([Quad(iri("a"), iri("p"), iri("b")), Quad(iri("x"), iri("p"), iri("y"))])
    assert store.count() == 3 and not store.contains(Quad(iri("a"), iri("p"), iri("b"))) and store.contains(Quad(iri("a"), iri("p"), iri("b"), iri("g")))
    assert store.graphs().count() == 1 and before.schema == store.quads.schema
    (tmp_path / "x.ttl").write_text("<http://e/n> <http://e/p> 1, 2 .")
    assert store.load(str(tmp_path / "x.ttl"), graph=iri("h")) == 2 and store.match(g=iri("h")).count() == 2
    assert QuadStore(spark, f"file://{tmp_path}/store").count() == 5
    store.clear()
    assert store.count() == 0


def test_readers_keep_their_version_and_batches_write_their_own_size(spark, tmp_path):
    store = QuadStore(spark, f"file://{tmp_path}/store")
    store.insert([Quad(iri(f"s{i:04d}"), iri("p"), iri("o")) for i in range(500)])
    readers = [(store.quads, 500)]
    store.insert([Quad(iri("s0001"), iri("p"), iri("o")), Quad(iri("new"), iri("p"), iri("o"))])
    readers.append((store.quads, 501))
    store.delete([Quad(iri("s0001"), iri("p"), iri("o")), Quad(iri("s0002"), iri("p"), iri("o"))])
    readers.append((store.quads, 499))
    store.insert([Quad(iri("s0001"), iri("p"), iri("o"))])
    readers.append((store.quads, 500))
    _, segments = store._current()
    assert [(sign, store._segment(name).count()) for sign, name in segments] == [("+", 500), ("+", 1), ("-", 2), ("+", 1)]
    store.compact()
    assert [df.count() for df, _ in readers] == [n for _, n in readers]
    store.vacuum()
    assert store.count() == 500 and QuadStore(spark, store.path).count() == 500 and len(list((tmp_path / "store").glob("data-*"))) == 1
    store.clear()
    assert store.count() == 0 and store.insert([Quad(iri("a"), iri("p"), iri("o"))]) == 1 and store.count() == 1


def test_many_batches_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quadrille.store.MOST_SEGMENTS", 3)
    store = QuadStore(spark, f"file://{tmp_path}/store")
    for i in range(5):
        store.insert([Quad(iri(f"s{i}"), iri("p"), iri("o"))])
    assert store.count() == 5 and len(store._current()[1]) <= 3


def test_a_version_that_was_cut_off_is_passed_over(spark, tmp_path):
    store = QuadStore(spark, f"file://{tmp_path}/store")
    store.insert([Quad(iri("a"), iri("p"), iri("o"))])
    (tmp_path / "store" / "version-000000000002").write_text('[["+", "ab')
    assert store.count() == 1
    store.insert([Quad(iri("b"), iri("p"), iri("o"))])
    assert store.count() == 2


def test_triple_terms_are_stored_and_matched(spark, tmp_path):
    store = QuadStore(spark, f"file://{tmp_path}/store")
    store.insert(parse_text("PREFIX : <http://e/> :a :b :c ~ :r {| :src :d |} .", "turtle"))
    got = store.engine().sparql("PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> SELECT ?t { <http://e/r> rdf:reifies ?t FILTER(isTriple(?t)) }").bindings()
    assert got == [{"t": TripleTerm(iri("a"), iri("b"), iri("c"))}]


def test_endpoint(spark, tmp_path):
    server = Endpoint(store=QuadStore(spark, f"file://{tmp_path}/store"), max_body=1000).server(port=0)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, body, {k.replace("_", "-"): v for k, v in headers.items()})) as r:
                return r.status, r.headers, r.read().decode()
        except HTTPError as e:
            return e.code, e.headers, e.read().decode()

    try:
        status, _, body = ask("/data", b"<http://e/a> <http://e/p> 1, 2 .", Content_Type="text/turtle")
        assert status == 200 and json.loads(body)["inserted"] == 2
        q = "SELECT ?o { ?s ?p ?o } ORDER BY ?o"
        status, head, body = ask("/sparql?query=" + quote(q))
        assert status == 200 and head["Content-Type"].startswith(write.JSON) and head["Access-Control-Allow-Origin"] == "*"
        assert [b["o"]["value"] for b in json.loads(body)["results"]["bindings"]] == ["1", "2"]
        assert ask("/sparql", q.encode(), Content_Type="application/sparql-query", Accept="text/csv")[2] == "o\r\n1\r\n2\r\n"
        assert ask("/sparql", ("query=" + quote("ASK {}")).encode(), Content_Type="application/x-www-form-urlencoded", Accept="text/csv")[2] == "result\r\ntrue\r\n"
        assert ask("/sparql?query=" + quote("CONSTRUCT WHERE { ?s ?p ?o }"))[1]["Content-Type"].startswith("application/n-triples")
        assert ask("/sparql?query=SELECT")[0] == 400 and ask("/sparql")[0] == 400 and ask("/nowhere")[0] == 404 and ask("/")[0] == 200
        assert ask("/data", b"#" * 1001, Content_Type="text/turtle")[0] == 413
        assert ask("/data", b"<a", Content_Type="text/turtle")[0] == 400 and ask("/data", b"", Content_Type="image/png")[0] == 415
    finally:
        server.shutdown()
        server.server_close()


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.nt").write_text(f'<http://e/{i}> <http://e/p> "x" .\n')
        ingest(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2
    # a batch that is run again after a crash writes over itself
    last = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))[-1]
    last.unlink()
    for crc in (tmp_path / "check" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    ingest(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_registry(spark, small):
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert registry.entry(spark).count() == 10
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name in ("join_fk3", "optional_filter", "exists", "group_sum_avg", "construct_nt", "path_plus", "values_undef", "quads_numeric", "from_and_named", "join_unbound", "minus_unbound", "read_trig", "store_delete", "select_json"):
        df = queries[name](spark, small)
        cols = sorted(df.columns)
        want = con.execute(sql[name])
        names = [d[0] for d in want.description]
        rows = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == rows, name
