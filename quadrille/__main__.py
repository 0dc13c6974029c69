"""python -m quadrille query|load|serve|demo: the engine from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine
from .http import Endpoint
from .sources.files import parse_text
from .store import QuadStore
from . import terms as R

DEMO = """@prefix : <http://people.example/> . @prefix foaf: <http://xmlns.com/foaf/0.1/> .
:ann foaf:name "Ann" ; foaf:age 31 ; foaf:knows :ben . :ben foaf:name "Ben" ; foaf:age 24 ; foaf:knows :cleo . :cleo foaf:name "Cleo" ; foaf:age 27 .
GRAPH :team1 { :ann foaf:nick "A" . :ben foaf:nick "B" } GRAPH :team2 { :cleo foaf:nick "C" . :ann foaf:nick "AA" }"""


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quadrille")
    parser.add_argument("--store", default="./quads", help="folder of the quad store")
    parser.add_argument("--tables", help="query the parquet tables in this folder through the mapping instead")
    sub = parser.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a query")
    q.add_argument("text")
    q.add_argument("--format", default="tsv", help="json, xml, csv or tsv")
    load = sub.add_parser("load", help="add a file or folder to the store")
    load.add_argument("path")
    load.add_argument("--format")
    load.add_argument("--base", default="")
    serve = sub.add_parser("serve", help="answer queries over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    sub.add_parser("demo", help="a small graph and a query")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quadrille").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = None if a.tables else QuadStore(spark, a.store)
    engine = Engine.over_tables(spark, a.tables) if a.tables else None
    if a.command == "query":
        print((engine or store.engine()).sparql(a.text).serialize(a.format), end="")
    elif a.command == "load":
        print(f"{store.load(a.path, a.format, base=a.base)} quads")
    elif a.command == "serve":
        Endpoint(engine, store).server(a.host, a.port).serve_forever()
    else:
        demo = Engine.over_quads(spark.createDataFrame([x.row() for x in parse_text(DEMO, "trig")], R.QUADS))
        print(demo.sparql("PREFIX foaf: <http://xmlns.com/foaf/0.1/> SELECT ?n ?a { ?p foaf:name ?n ; foaf:age ?a } ORDER BY ?n").serialize("tsv"), end="")


if __name__ == "__main__":
    main()
