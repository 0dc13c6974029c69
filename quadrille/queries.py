"""The registered queries of the engine: SPARQL over the mapped tables, and the SQL that has the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .io_queries import IO

PREFIXES = "".join(
    f"PREFIX {p}: <http://ex/{t}#>\n"
    for p, t in {
        "r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem", "e": "events",
        "d": "documents", "pg": "pages", "b": "benchmark", "lb": "labels", "cv": "conversations",
    }.items()
) + "PREFIX ex: <http://ex/>\nPREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"

#: name: (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str]] = {
    # scans
    "scan_const_pred": ("SELECT ?name { ?c c:c_name ?name }", "SELECT c_name AS name FROM customer"),
    "scan_const_obj": ("SELECT ?price { ?o o:o_orderstatus 'F' ; o:o_totalprice ?price }", "SELECT o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'"),
    "scan_const_subject": (
        "SELECT ?p ?o { <http://ex/nation/3> ?p ?o }",
        "SELECT 'http://ex/nation#n_nationkey' AS p, '3' AS o UNION ALL SELECT 'http://ex/nation#n_name', n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://ex/nation#n_regionkey', 'http://ex/region/' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex/Nation'",
    ),
    "scan_repeated_var": (
        "SELECT ?x ?t { ?e e:event_id ?x ; e:user_id ?x ; e:event_type ?t }",
        "SELECT event_id AS x, event_type AS t FROM events WHERE event_id = user_id",
    ),
    "scan_class": ("SELECT ?s { ?s a ex:Supplier }", "SELECT 'http://ex/supplier/' || s_suppkey AS s FROM supplier"),
    "scan_any_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) { ?s ?p 'EUROPE' } GROUP BY ?p",
        "SELECT 'http://ex/region#r_name' AS p, count(*) AS n FROM region WHERE r_name = 'EUROPE'",
    ),
    "blank_node_pattern": (
        "SELECT ?name { ?c c:c_nationkey [ n:n_name 'NATION_7' ] ; c:c_name ?name }",
        "SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
    ),
    # filters
    "filter_numeric": ("SELECT ?name ?bal { ?c c:c_name ?name ; c:c_acctbal ?bal FILTER(?bal > 9000) }", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000"),
    "filter_string": ("SELECT ?name { ?p p:p_name ?name ; p:p_brand ?b FILTER(?b >= 'Brand#3') }", "SELECT p_name AS name FROM part WHERE p_brand >= 'Brand#3'"),
    "filter_and_or_not": (
        "SELECT ?k { ?o o:o_orderkey ?k ; o:o_orderstatus ?s ; o:o_totalprice ?t FILTER((?s = 'F' && ?t > 200000) || !(?s != 'P' || ?t >= 50000)) }",
        "SELECT o_orderkey AS k FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'P' AND o_totalprice < 50000)",
    ),
    "filter_in": ("SELECT ?k ?t { ?e e:event_id ?k ; e:event_type ?t FILTER(?t IN ('click', 'error')) }", "SELECT event_id AS k, event_type AS t FROM events WHERE event_type IN ('click', 'error')"),
    "filter_not_in": ("SELECT ?k { ?e e:event_id ?k ; e:event_type ?t FILTER(?t NOT IN ('click', 'view')) }", "SELECT event_id AS k FROM events WHERE event_type NOT IN ('click', 'view')"),
    "filter_date": (
        "SELECT ?k ?d { ?o o:o_orderkey ?k ; o:o_orderdate ?d FILTER(?d >= '1996-01-01T00:00:00'^^xsd:dateTime && ?d < '1996-02-01T00:00:00'^^xsd:dateTime) }",
        "SELECT o_orderkey AS k, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'",
    ),
    "filter_ebv": ("SELECT ?k { ?l lb:doc_id ?x ; lb:quality ?q ; lb:toxic ?t . ?x d:doc_id ?k FILTER(?q && !?t) }", "SELECT doc_id AS k FROM labels WHERE quality <> 0 AND toxic = 0"),
    # computed columns
    "bind_arith": (
        "SELECT ?k ?q ?net { ?o o:o_orderkey ?k . ?li l:l_orderkey ?o ; l:l_quantity ?q ; l:l_extendedprice ?p ; l:l_discount ?x BIND(?p * (1 - ?x) AS ?net) }",
        "SELECT l_orderkey AS k, l_quantity AS q, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    ),
    "select_expr": ("SELECT ?k (?t / 2 + 1 AS ?half) { ?o o:o_orderkey ?k ; o:o_totalprice ?t }", "SELECT o_orderkey AS k, o_totalprice / 2 + 1 AS half FROM orders"),
    "arith_integer": ("SELECT ?k (?z * 3 - 7 AS ?y) (-?z AS ?neg) { ?p p:p_partkey ?k ; p:p_size ?z }", "SELECT p_partkey AS k, (p_size * 3 - 7)::BIGINT AS y, (-p_size)::BIGINT AS neg FROM part"),
    "bind_if_coalesce": (
        "SELECT ?k ?w ?v { ?o o:o_orderkey ?k ; o:o_totalprice ?t BIND(IF(?t > 150000, 'high', 'low') AS ?w) BIND(COALESCE(?missing, ?k) AS ?v) }",
        "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'low' END AS w, o_orderkey::VARCHAR AS v FROM orders",
    ),
    # joins
    "join_star": ("SELECT ?n ?b ?m { ?c c:c_name ?n ; c:c_acctbal ?b ; c:c_mktsegment ?m }", "SELECT c_name AS n, c_acctbal AS b, c_mktsegment AS m FROM customer"),
    "join_fk2": ("SELECT ?k ?name { ?o o:o_custkey ?c ; o:o_orderkey ?k . ?c c:c_name ?name }", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_fk3": (
        "SELECT ?name ?k ?q { ?c c:c_name ?name . ?o o:o_custkey ?c ; o:o_orderkey ?k ; o:o_orderstatus 'F' . ?li l:l_orderkey ?o ; l:l_quantity ?q FILTER(?q > 40) }",
        "SELECT c_name AS name, o_orderkey AS k, l_quantity AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 40",
    ),
    "join_chain5": (
        "SELECT ?rn (COUNT(*) AS ?n) { ?li l:l_suppkey ?s ; l:l_orderkey ?o . ?s s:s_nationkey ?na . ?na n:n_regionkey ?re . ?re r:r_name ?rn . ?o o:o_orderstatus 'P' } GROUP BY ?rn",
        "SELECT r_name AS rn, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY r_name",
    ),
    "join_value": (
        "SELECT ?x ?y { ?a s:s_nationkey ?n ; s:s_name ?x . ?b c:c_nationkey ?n ; c:c_name ?y ; c:c_mktsegment 'BUILDING' }",
        "SELECT s_name AS x, c_name AS y FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "join_theta": (
        "SELECT ?x ?y { ?a n:n_nationkey ?x . ?b n:n_nationkey ?y FILTER(?x < ?y) }",
        "SELECT a.n_nationkey::BIGINT AS x, b.n_nationkey::BIGINT AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey",
    ),
    "join_cross_small": ("SELECT ?x ?y { ?a r:r_name ?x . ?b n:n_name ?y }", "SELECT r_name AS x, n_name AS y FROM region, nation"),
    "optional": (
        "SELECT ?k ?q { ?o o:o_orderkey ?k OPTIONAL { ?li l:l_orderkey ?o ; l:l_quantity ?q } }",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
    ),
    "optional_filter": (
        "SELECT ?k ?p { ?o o:o_orderkey ?k ; o:o_totalprice ?t OPTIONAL { ?li l:l_orderkey ?o ; l:l_extendedprice ?p FILTER(?p * 2 > ?t) } }",
        "SELECT o_orderkey AS k, l_extendedprice AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_extendedprice * 2 > o_totalprice",
    ),
    "optional_chain": (
        "SELECT ?k ?q ?t { ?d d:doc_id ?k OPTIONAL { ?l lb:doc_id ?d ; lb:quality ?q OPTIONAL { ?l2 lb:doc_id ?d ; lb:toxic ?t FILTER(?q = 1) } } }",
        "SELECT d.doc_id AS k, l.quality::BIGINT AS q, CASE WHEN l.quality = 1 THEN l.toxic <> 0 END AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "optional_compatible": (
        "SELECT ?k ?q { ?d d:doc_id ?k OPTIONAL { ?l lb:doc_id ?d ; lb:quality ?q } OPTIONAL { ?m lb:doc_id ?d ; lb:toxic ?t ; lb:quality ?q FILTER(?t) } }",
        "SELECT d.doc_id AS k, l.quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "minus": ("SELECT ?k { ?o o:o_orderkey ?k MINUS { ?li l:l_orderkey ?o } }", "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "minus_disjoint": ("SELECT ?n { ?r r:r_name ?n MINUS { ?x n:n_name ?y } }", "SELECT r_name AS n FROM region"),
    "not_exists": (
        "SELECT ?k { ?o o:o_orderkey ?k FILTER NOT EXISTS { ?li l:l_orderkey ?o ; l:l_quantity ?q FILTER(?q > 30) } }",
        "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)",
    ),
    "exists": (
        "SELECT ?k { ?o o:o_orderkey ?k ; o:o_totalprice ?t FILTER EXISTS { ?li l:l_orderkey ?o ; l:l_extendedprice ?p FILTER(?p > ?t) } }",
        "SELECT o_orderkey AS k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice)",
    ),
    "exists_or": (
        "SELECT ?k { ?o o:o_orderkey ?k ; o:o_totalprice ?t FILTER(?t > 250000 || NOT EXISTS { ?li l:l_orderkey ?o }) }",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 250000 OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    # sets and modifiers
    "union2": ("SELECT ?name { { ?c c:c_name ?name } UNION { ?s s:s_name ?name } }", "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier"),
    "union3": (
        "SELECT ?a ?b { { ?x r:r_name ?a } UNION { ?x n:n_name ?b } UNION { ?x s:s_name ?a ; s:s_acctbal ?v FILTER(?v < 0) } }",
        "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation UNION ALL SELECT s_name, NULL FROM supplier WHERE s_acctbal < 0",
    ),
    "distinct": ("SELECT DISTINCT ?f ?s { ?li l:l_returnflag ?f ; l:l_linestatus ?s }", "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem"),
    "reduced": ("SELECT REDUCED ?f { ?o o:o_orderstatus ?f }", "SELECT o_orderstatus AS f FROM orders"),
    "orderby_limit": ("SELECT ?k ?t { ?o o:o_orderkey ?k ; o:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY t DESC, k LIMIT 20"),
    "orderby_desc_multi": (
        "SELECT ?m ?b ?n { ?c c:c_mktsegment ?m ; c:c_acctbal ?b ; c:c_name ?n } ORDER BY ?m DESC(?b) ?n LIMIT 25",
        "SELECT c_mktsegment AS m, c_acctbal AS b, c_name AS n FROM customer ORDER BY m, b DESC, n LIMIT 25",
    ),
    "offset": ("SELECT ?k { ?o o:o_orderkey ?k } ORDER BY ?k LIMIT 10 OFFSET 100", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 10 OFFSET 100"),
    "orderby_expression": ("SELECT ?n { ?s s:s_name ?n ; s:s_acctbal ?b } ORDER BY (ABS(?b - 5000)) ?n LIMIT 5", "SELECT s_name AS n FROM supplier ORDER BY abs(s_acctbal - 5000), s_name LIMIT 5"),
    # aggregates
    "group_count": ("SELECT ?t (COUNT(*) AS ?n) { ?e e:event_type ?t } GROUP BY ?t", "SELECT event_type AS t, count(*) AS n FROM events GROUP BY t"),
    "group_sum_avg": (
        "SELECT ?f ?s (ROUND(SUM(?q)) AS ?sum_qty) (ROUND(AVG(?q) * 1000) AS ?avg_qty) (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (COUNT(?q) AS ?n) { ?li l:l_returnflag ?f ; l:l_linestatus ?s ; l:l_quantity ?q ; l:l_extendedprice ?p } GROUP BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, floor(sum(l_quantity) + 0.5) AS sum_qty, floor(avg(l_quantity) * 1000 + 0.5) AS avg_qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY f, s",
    ),
    "group_no_key": ("SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?s) { ?p p:p_size ?z }", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s FROM part"),
    "group_expression": ("SELECT ?y (COUNT(*) AS ?n) { ?o o:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY y"),
    "having": ("SELECT ?c (COUNT(*) AS ?n) { ?o o:o_custkey ?c } GROUP BY ?c HAVING(COUNT(*) > 15)", "SELECT 'http://ex/customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "count_distinct": ("SELECT ?s (COUNT(DISTINCT ?c) AS ?n) { ?o o:o_orderstatus ?s ; o:o_custkey ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY s"),
    "group_concat": (
        "SELECT ?rn (GROUP_CONCAT(?nn ; SEPARATOR = '|') AS ?names) { ?n n:n_regionkey ?r ; n:n_name ?nn . ?r r:r_name ?rn } GROUP BY ?rn",
        "SELECT r_name AS rn, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY rn",
    ),
    "sample": ("SELECT ?r (SAMPLE(?x) AS ?one) { ?n n:n_regionkey ?r . ?r r:r_name ?x } GROUP BY ?r", "SELECT 'http://ex/region/' || r_regionkey AS r, r_name AS one FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"),
    # forms and datasets
    "graph_iri": ("SELECT ?s ?n { GRAPH <http://ex/graph/nation> { ?s n:n_name ?n } }", "SELECT 'http://ex/nation/' || n_nationkey AS s, n_name AS n FROM nation"),
    "graph_var_count": (
        "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } FILTER(?g IN (<http://ex/graph/region>, <http://ex/graph/part>, <http://ex/graph/labels>)) } GROUP BY ?g",
        "SELECT 'http://ex/graph/region' AS g, 3 * count(*) AS n FROM region UNION ALL SELECT 'http://ex/graph/part', 7 * count(*) FROM part UNION ALL SELECT 'http://ex/graph/labels', 4 * count(*) FROM labels",
    ),
    "from_clause": ("SELECT (COUNT(*) AS ?n) FROM <http://ex/graph/nation> FROM <http://ex/graph/region> { ?s ?p ?o }", "SELECT 4 * (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM region) AS n"),
    "from_named_only": ("SELECT (COUNT(*) AS ?n) FROM NAMED <http://ex/graph/region> { ?s ?p ?o }", "SELECT 0::BIGINT AS n"),
    "from_hides_graphs": ("SELECT (COUNT(*) AS ?n) FROM <http://ex/graph/nation> { GRAPH <http://ex/graph/nation> { ?s ?p ?o } }", "SELECT 0::BIGINT AS n"),
    "from_and_named": (
        "SELECT ?x ?y FROM <http://ex/graph/nation> FROM NAMED <http://ex/graph/region> { ?n n:n_regionkey ?r ; n:n_name ?x GRAPH ?g { ?r r:r_name ?y } }",
        "SELECT n_name AS x, r_name AS y FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "select_star": ("SELECT * { ?c c:c_name ?name ; c:c_acctbal ?balance }", "SELECT 'http://ex/customer/' || c_custkey AS c, c_name AS name, c_acctbal AS balance FROM customer"),
    "comments_dollar_where": ("# all of them\nSELECT $n # the name\nWHERE { $x s:s_name $n . # not <a> comment\n }", "SELECT s_name AS n FROM supplier"),
    "distinct_order_limit": ("SELECT DISTINCT ?m { ?c c:c_mktsegment ?m ; c:c_name ?n } ORDER BY DESC(?m) LIMIT 3 OFFSET 1", "SELECT DISTINCT c_mktsegment AS m FROM customer ORDER BY m DESC LIMIT 3 OFFSET 1"),
    "join_unbound": (
        "SELECT ?k ?q ?b { { ?d d:doc_id ?k OPTIONAL { ?l lb:doc_id ?d ; lb:quality ?q } } { SELECT ?q ?b { ?p p:p_size ?q ; p:p_brand ?b FILTER(?q < 2) } } FILTER(BOUND(?q)) }",
        "SELECT d.doc_id AS k, p_size::BIGINT AS q, p_brand AS b FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN part ON (l.quality IS NULL OR l.quality = p_size) AND p_size < 2",
    ),
    "minus_unbound": (
        "SELECT ?k ?q { { ?d d:doc_id ?k OPTIONAL { ?l lb:doc_id ?d ; lb:quality ?q } } MINUS { ?p p:p_partkey ?t OPTIONAL { ?p p:p_size ?q FILTER(?q < 5) } } }",
        "SELECT d.doc_id AS k, l.quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size < 5 AND p_size = l.quality)",
    ),
    # subqueries, values, paths
    "subquery_topk": (
        "SELECT ?name ?b { { SELECT ?c ?b { ?c c:c_acctbal ?b ; c:c_custkey ?k } ORDER BY DESC(?b) ?k LIMIT 10 } ?c c:c_name ?name }",
        "SELECT c_name AS name, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    ),
    "subquery_aggregate": (
        "SELECT ?k { ?o o:o_orderkey ?k ; o:o_totalprice ?t { SELECT (MAX(?x) AS ?m) { ?y o:o_totalprice ?x } } FILTER(?t > ?m * 0.99e0) }",
        "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) * 0.99",
    ),
    "values_join": ("SELECT ?k ?s { VALUES ?s { 'P' 'Z' } ?o o:o_orderstatus ?s ; o:o_orderkey ?k }", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('P', 'Z')"),
    "values_undef": (
        "SELECT ?s ?p ?k { ?o o:o_orderstatus ?s ; o:o_orderpriority ?p ; o:o_orderkey ?k VALUES (?s ?p) { ('P' UNDEF) ('F' '1-URGENT') } }",
        "SELECT o_orderstatus AS s, o_orderpriority AS p, o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    ),
    "path_sequence": ("SELECT ?n ?rn { ?c c:c_name ?n ; c:c_nationkey/n:n_regionkey/r:r_name ?rn }", "SELECT c_name AS n, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": ("SELECT ?n ?x { ?r r:r_name ?n ; ^n:n_regionkey ?y . ?y n:n_name ?x }", "SELECT r_name AS n, n_name AS x FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "path_alternative": ("SELECT ?x { ?y c:c_mktsegment|s:s_name ?x }", "SELECT c_mktsegment AS x FROM customer UNION ALL SELECT s_name FROM supplier"),
    "path_plus": (
        "SELECT ?a ?b { ?a (s:s_nationkey|n:n_regionkey)+ ?b }",
        "SELECT 'http://ex/supplier/' || s_suppkey AS a, 'http://ex/nation/' || s_nationkey AS b FROM supplier UNION SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/region/' || n_regionkey FROM nation UNION SELECT 'http://ex/supplier/' || s_suppkey, 'http://ex/region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "path_star_const": (
        "SELECT ?b { <http://ex/supplier/1> (s:s_nationkey|n:n_regionkey)* ?b }",
        "SELECT 'http://ex/supplier/1' AS b UNION SELECT 'http://ex/nation/' || s_nationkey FROM supplier WHERE s_suppkey = 1 UNION SELECT 'http://ex/region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1",
    ),
    "path_negated": (
        "SELECT ?n ?v { ?x r:r_name ?n ; !(r:r_name|a) ?v }",
        "SELECT r_name AS n, r_regionkey::VARCHAR AS v FROM region",
    ),
}


def _fn(expr: str, sql: str, pattern: str = "?x d:doc_id ?k ; d:text ?t ; d:lang ?g ; d:source ?s ; d:n_chars ?n", table: str = "documents", key: str = "doc_id") -> tuple[str, str]:
    return f"SELECT ?k ({expr} AS ?v) {{ {pattern} }}", f"SELECT {key} AS k, {sql} AS v FROM {table}"


_CUST = {"pattern": "?x c:c_custkey ?k ; c:c_name ?name ; c:c_acctbal ?b ; c:c_mktsegment ?m ; c:c_nationkey ?na", "table": "customer", "key": "c_custkey"}
_EVENT = {"pattern": "?x e:event_id ?k ; e:ts ?ts ; e:value ?val ; e:user_id ?u", "table": "events", "key": "event_id"}
#: What SPARQL calls a number's type decides the SQL type of the other side.
SPARQL |= {
    "fn_strlen": _fn("STRLEN(?t)", "length(text)"),
    "fn_substr": _fn("SUBSTR(?t, 5, 12)", "substring(text, 5, 12)"),
    "fn_substr_open": _fn("SUBSTR(?name, 10)", "substring(c_name, 10)", **_CUST),
    "fn_ucase": _fn("UCASE(?m)", "upper(c_mktsegment)", **_CUST),
    "fn_lcase": _fn("LCASE(?name)", "lower(c_name)", **_CUST),
    "fn_concat": _fn("CONCAT(?name, '/', ?m)", "c_name || '/' || c_mktsegment", **_CUST),
    "fn_contains": _fn("CONTAINS(?t, 'and')", "contains(text, 'and')"),
    "fn_strstarts": _fn("STRSTARTS(?t, 'A')", "starts_with(text, 'A')"),
    "fn_strends": _fn("STRENDS(?t, '.')", "ends_with(text, '.')"),
    "fn_regex": _fn("REGEX(?name, '0[1-3]5$')", "regexp_matches(c_name, '0[1-3]5$')", **_CUST),
    "fn_regex_i": _fn("REGEX(?m, '^buil', 'i')", "regexp_matches(c_mktsegment, '^buil', 'i')", **_CUST),
    "fn_replace": _fn("REPLACE(?name, '#0+', ':')", "regexp_replace(c_name, '#0+', ':', 'g')", **_CUST),
    "fn_strbefore": _fn("STRBEFORE(?name, '#')", "split_part(c_name, '#', 1)", **_CUST),
    "fn_strafter": _fn("STRAFTER(?name, '#')", "split_part(c_name, '#', 2)", **_CUST),
    "fn_langmatches": _fn("LANGMATCHES(LANG(?t), 'en')", "lang = 'en'"),
    "fn_lang": _fn("LANG(?t)", "lang"),
    "fn_str": _fn("STR(?na)", "'http://ex/nation/' || c_nationkey", **_CUST),
    "fn_str_number": _fn("STR(?n)", "n_chars::VARCHAR"),
    "fn_sameterm": _fn("sameTerm(?g, ?s)", "lang = source"),
    "fn_abs": _fn("ABS(?b)", "abs(c_acctbal)", **_CUST),
    "fn_ceil": _fn("CEIL(?b)", "ceil(c_acctbal)", **_CUST),
    "fn_floor": _fn("FLOOR(?b)", "floor(c_acctbal)", **_CUST),
    "fn_round": _fn("ROUND(?b)", "floor(c_acctbal + 0.5)", **_CUST),
    "fn_cast": _fn("xsd:integer(?b)", "trunc(c_acctbal)::BIGINT", **_CUST),
    "fn_cast_string": _fn("xsd:string(?k)", "c_custkey::VARCHAR", **_CUST),
    "fn_cast_double": _fn("xsd:double(?n) / 4", "n_chars::DOUBLE / 4"),
    "fn_bound": ("SELECT ?k (BOUND(?q) AS ?v) { ?x d:doc_id ?k OPTIONAL { ?l lb:doc_id ?x ; lb:quality ?q } }", "SELECT d.doc_id AS k, l.doc_id IS NOT NULL AS v FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "fn_dates": (
        "SELECT ?k (YEAR(?ts) AS ?y) (MONTH(?ts) AS ?m) (DAY(?ts) AS ?d) (HOURS(?ts) AS ?h) (MINUTES(?ts) AS ?mi) { ?x e:event_id ?k ; e:ts ?ts }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi FROM events",
    ),
    "fn_hashes": ("SELECT ?k (MD5(?s) AS ?a) (SHA256(?s) AS ?b) { ?x d:doc_id ?k ; d:source ?s }", "SELECT doc_id AS k, md5(source) AS a, sha256(source) AS b FROM documents"),
    "fn_iri_of_page": ("SELECT ?k ?u { ?x pg:page_id ?k ; pg:url ?u FILTER(isIRI(?u)) }", "SELECT page_id AS k, url AS u FROM pages"),
    "conversation_key": (
        "SELECT ?x ?r { ?x cv:role ?r ; cv:turn 1 }",
        "SELECT 'http://ex/conversations/' || conv_id || '-' || turn AS x, role AS r FROM conversations WHERE turn = 1",
    ),
    # the shapes of well-known analytics queries
    "pricing_summary": (
        "SELECT ?f ?s (ROUND(SUM(?q)) AS ?sum_qty) (ROUND(SUM(?p)) AS ?sum_base) (ROUND(SUM(?p * (1 - ?x))) AS ?sum_disc) (COUNT(*) AS ?n) { ?li l:l_returnflag ?f ; l:l_linestatus ?s ; l:l_quantity ?q ; l:l_extendedprice ?p ; l:l_discount ?x ; l:l_shipdate ?d FILTER(?d <= '1998-09-02T00:00:00'^^xsd:dateTime) } GROUP BY ?f ?s ORDER BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, floor(sum(l_quantity) + 0.5) AS sum_qty, floor(sum(l_extendedprice) + 0.5) AS sum_base, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY f, s",
    ),
    "top_customers": (
        "SELECT ?name (ROUND(SUM(?p)) AS ?total) { ?c c:c_name ?name . ?o o:o_custkey ?c ; o:o_orderstatus 'F' . ?li l:l_orderkey ?o ; l:l_extendedprice ?p } GROUP BY ?name ORDER BY DESC(?total) ?name LIMIT 10",
        "SELECT c_name AS name, floor(sum(l_extendedprice) + 0.5) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY c_name ORDER BY total DESC, name LIMIT 10",
    ),
    "local_supplier_volume": (
        "SELECT ?nn (ROUND(SUM(?p * (1 - ?x))) AS ?revenue) { ?c c:c_nationkey ?na . ?o o:o_custkey ?c ; o:o_orderdate ?d . ?li l:l_orderkey ?o ; l:l_suppkey ?s ; l:l_extendedprice ?p ; l:l_discount ?x . ?s s:s_nationkey ?na . ?na n:n_name ?nn ; n:n_regionkey ?r . ?r r:r_name 'ASIA' FILTER(YEAR(?d) = 1996) } GROUP BY ?nn",
        "SELECT n_name AS nn, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996 GROUP BY n_name",
    ),
}

#: The flagship: the query of `entry`.
FLAGSHIP = "top_customers"


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Engine.over_tables(spark, folder).query(PREFIXES + text)


def _triples(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Engine.over_tables(spark, folder).sparql(PREFIXES + text).triples()


_N3 = "'<http://ex/"
_TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"
_INT = "'\"^^<http://www.w3.org/2001/XMLSchema#integer>'"
OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ask_true": (_run("ASK { ?c c:c_mktsegment 'BUILDING' }"), "SELECT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING') AS result"),
    "ask_false": (_run("ASK { ?c c:c_acctbal ?b FILTER(?b > 1e9) }"), "SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1e9) AS result"),
    "construct_nt": (
        _triples("CONSTRUCT { ?c ex:livesIn ?nn . ?c ex:key ?k } { ?c c:c_nationkey ?n ; c:c_custkey ?k . ?n n:n_name ?nn }"),
        f"SELECT {_N3}customer/' || c_custkey || '>' AS s, '<http://ex/livesIn>' AS p, '\"' || n_name || '\"' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {_N3}customer/' || c_custkey || '>', '<http://ex/key>', '\"' || c_custkey || {_INT} FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "construct_where": (
        _triples("CONSTRUCT WHERE { ?n n:n_regionkey ?r }"),
        f"SELECT {_N3}nation/' || n_nationkey || '>' AS s, '<http://ex/nation#n_regionkey>' AS p, {_N3}region/' || n_regionkey || '>' AS o FROM nation",
    ),
    "describe_nt": (
        _triples("DESCRIBE ?r { ?r r:r_name ?n FILTER(?n != 'ASIA') }"),
        f"SELECT {_N3}region/' || r_regionkey || '>' AS s, '<http://ex/region#r_name>' AS p, '\"' || r_name || '\"' AS o FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT {_N3}region/' || r_regionkey || '>', '<http://ex/region#r_regionkey>', '\"' || r_regionkey || {_INT} FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT {_N3}region/' || r_regionkey || '>', {_TYPE}, '<http://ex/Region>' FROM region WHERE r_name <> 'ASIA'",
    ),
    "describe_iri": (
        _triples("DESCRIBE <http://ex/region/1>"),
        f"SELECT '<http://ex/region/1>' AS s, '<http://ex/region#r_name>' AS p, '\"' || r_name || '\"' AS o FROM region WHERE r_regionkey = 1 UNION ALL SELECT '<http://ex/region/1>', '<http://ex/region#r_regionkey>', '\"1' || {_INT} UNION ALL SELECT '<http://ex/region/1>', {_TYPE}, '<http://ex/Region>'",
    ),
}


def _as_quads(spark: SparkSession, folder: str, graphs: str) -> DataFrame:
    """The quads of mapped tables, made by the engine itself, each in the graph of its table."""
    engine = Engine.over_tables(spark, folder)
    triples = engine.sparql(f"SELECT ?s ?p ?o ?g {{ GRAPH ?g {{ ?s ?p ?o }} FILTER(?g IN ({graphs})) }}").terms()
    return triples.select("s", F.col("p.v").alias("p"), "o", "g")


def quads_join(spark: SparkSession, folder: str) -> DataFrame:
    """A join over a real quad table instead of the mapping."""
    names = ", ".join(f"<http://ex/graph/{t}>" for t in ("customer", "nation"))
    quads = _as_quads(spark, folder, names)
    found = Engine.over_quads(quads).sparql(PREFIXES + "SELECT ?name ?nn { GRAPH ?g { ?c c:c_name ?name ; c:c_nationkey ?n } GRAPH ?h { ?n n:n_name ?nn } }")
    return found.native()


def quads_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """Filters and aggregates on term structs, whose types are found row by row."""
    quads = _as_quads(spark, folder, "<http://ex/graph/part>")
    text = "SELECT ?b (COUNT(*) AS ?n) (SUM(?z) AS ?total) { GRAPH ?g { ?p p:p_brand ?b ; p:p_size ?z FILTER(?z > 10) } } GROUP BY ?b"
    r = Engine.over_quads(quads).sparql(PREFIXES + text).native()
    return r.select("b", "n", F.col("total").cast("bigint").alias("total"))


OTHER |= {
    "quads_join": (quads_join, "SELECT c_name AS name, n_name AS nn FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "quads_numeric": (quads_numeric, "SELECT p_brand AS b, count(*) AS n, sum(p_size)::BIGINT AS total FROM part WHERE p_size > 10 GROUP BY p_brand"),
}

OTHER |= IO

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _run(q) for k, (q, _) in SPARQL.items()} | {k: f for k, (f, _) in OTHER.items()}
ORACLE_SQL: dict[str, str] = {k: s for k, (_, s) in SPARQL.items()} | {k: s for k, (_, s) in OTHER.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, folder)
