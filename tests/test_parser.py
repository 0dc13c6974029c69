"""The query parser: what it takes, what it makes of it, and what it refuses."""

import pytest

from quadrille.plans import algebra as A
from quadrille.plans.parser import SparqlSyntaxError, parse
from quadrille.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, IRI, Literal

GOOD = [
    "SELECT * {}", "SELECT ?x WHERE { ?x ?y ?z }", "select distinct $x { $x a <t:T> } limit 3 offset 2", "SELECT ?x { ?x <a:b> 1 } OFFSET 2 LIMIT 3",
    "PREFIX : <a:> BASE <http://b/> SELECT * { :x.y :p <rel> . _:b :q ?z ; ; a :T , :U . }", "ASK { <a:b> <c:d> 'x'^^<e:f>, 'y'@en-GB--ltr }", "ASK { ?s ?p ?o } # end",
    "SELECT * { { ?a ?b ?c } UNION { ?d ?e ?f } UNION { } OPTIONAL { ?a ?g ?h } }", "SELECT * { ?s (<a:p>|^<a:q>)+/<a:r>? ?o ; !(<a:x>|^a) ?z }",
    "SELECT (COUNT(DISTINCT *) AS ?n) (GROUP_CONCAT(?x; SEPARATOR=', ') AS ?g) { ?x ?y ?z } GROUP BY ?y (STR(?z) AS ?w) HAVING (COUNT(*) > 1) ORDER BY DESC(?n) ASC(?y) (?w)",
    "SELECT * { VALUES (?a ?b) { (1 UNDEF) (UNDEF 'x') } } VALUES ?c { <a:b> }", "CONSTRUCT { ?s <a:p> [ <a:q> (1 2) ] } WHERE { ?s ?p ?o }", "CONSTRUCT WHERE { ?s ?p ?o . }",
    "DESCRIBE <a:b> ?x WHERE { ?x ?y ?z }", "DESCRIBE <a:b>", "DESCRIBE * { ?x ?y ?z }", "SELECT ?x FROM <a:g> FROM NAMED <a:h> { GRAPH ?g { ?x ?y ?z } }",
    "SELECT * { FILTER(1 + 2 * -3 <= 4 && !(?a IN (1, 2)) || ?b NOT IN ()) }", "SELECT * { FILTER NOT EXISTS { ?a ?b ?c } FILTER REGEX(?a, 'x', 'i') }",
    'SELECT * { ?s ?p """a "quoted" \\n\\u00e9""" }', "SELECT * { { SELECT ?x { ?x ?y ?z } LIMIT 1 } }", "SELECT * { ?s ?p true, false, 1.5, .5, 1e3, -2, +3.0 }",
    "SELECT (?x + 1 AS ?y) { ?x ?p ?o } ORDER BY ?y", "SELECT * { [] <a:p> [ <a:q> ?v ] . (1) <a:r> () . [ <a:s> 1 ] }", "SELECT * { <a:b> <a:c> ?x. FILTER(<http://www.w3.org/2001/XMLSchema#integer>(?x) = 1) }",
]
BAD = [
    "", "SELECT { ?x ?y ?z }", "SELECT * { ?x ?y }", "SELECT * { ?x ?y ?z", "SELECT * { ?x ?y ?z } trailing", "SELECT * { 'x' FILTER }", "SELECT ?x { } GROUP BY", "SELECT * { p:x ?y ?z }",
    "SELECT * { ?s ?p 'x\\q' }", "SELECT * { ?s ?p '\\uD800' }", "SELECT (1 AS ?x) { ?x ?y ?z }", "SELECT ?z { ?x ?y ?z } GROUP BY ?x", "SELECT * { VALUES (?a ?b) { (1) } }", "SELECT * { SERVICE <a:b> { ?x ?y ?z } }",
    "SELECT * { FILTER(BOUND(1)) }", "SELECT * { FILTER(NOSUCH(?x)) }", "SELECT * { FILTER(STR(?x, ?y)) }", "CONSTRUCT WHERE { ?s ?p ?o FILTER(?o > 1) }", "INSERT DATA { <a:b> <c:d> 1 }", "SELECT * { ?x ?y ?z } LIMIT x",
    "SELECT * { ?a ?b ?c } GROUP BY ?a", "SELECT * { ?s ?p 'x'@en--up }",
]


@pytest.mark.parametrize("text", GOOD)
def test_taken(text):
    assert parse(text).form in ("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")


@pytest.mark.parametrize("text", BAD)
def test_refused(text):
    with pytest.raises(SparqlSyntaxError):
        parse(text)


def test_precedence():
    e = parse("SELECT * { FILTER(1 || 2 && 3 = 4 + 5 * -6) }").where.conditions[0]
    lit = lambda n: Literal(str(n), datatype=INTEGER)
    product = A.Call("*", (lit(5), lit(-6)))
    assert e == A.Call("||", (lit(1), A.Call("&&", (lit(2), A.Call("=", (lit(3), A.Call("+", (lit(4), product))))))))


def test_literals_and_iris():
    q = parse("BASE <http://b/c/> PREFIX p: <d#> SELECT * { <x> p:y 1, 1.0, 1e0, true, 'a'@EN, 'b'^^p:t }")
    t = q.where.triples
    assert t[0].s == IRI("http://b/c/x") and t[0].p == IRI("http://b/c/d#y")
    assert [x.o.datatype for x in t[:4]] == [INTEGER, DECIMAL, DOUBLE, BOOLEAN]
    assert t[4].o.lang == "EN" and t[5].o.datatype == "http://b/c/d#t"


def test_filters_of_a_group_come_last_and_optionals_keep_theirs():
    q = parse("SELECT * { FILTER(?a > 1) ?x <p:p> ?a OPTIONAL { ?x <p:q> ?b FILTER(?b > ?a) } ?x <p:r> ?c }").where
    assert isinstance(q, A.Filter) and isinstance(q.pattern, A.Join) and isinstance(q.pattern.left, A.LeftJoin)
    assert len(q.pattern.left.conditions) == 1


def test_blank_nodes_are_hidden_variables():
    q = parse("SELECT * { _:a <p:p> ?x . _:a <p:q> ?y }")
    assert q.where.triples[0].s == q.where.triples[1].s and A.projected(q) == ["x", "y"]
