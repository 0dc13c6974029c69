"""Readers of all formats: the same graph from each, cases by hand, and what is refused."""

import pytest

from quadrille import BNode, IRI, Literal, Quad, TripleTerm
from quadrille.results.compare import isomorphic, same_solutions
from quadrille.sources import iris
from quadrille.sources.files import format_of, parse_text, read_rdf
from quadrille.terms import BOOLEAN, DECIMAL, DOUBLE, INTEGER, REIFIES, from_struct

E = "http://e/"
iri = lambda x: IRI(E + x)

SAME = {
    "turtle": '@prefix : <http://e/> . :a a :T ; :name "x", "y"@fr ; :n 5 ; :knows [ :name "z" ] ; :l ( :b "c" ) .',
    "ntriples": """<http://e/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://e/T> .
<http://e/a> <http://e/name> "x" .
<http://e/a> <http://e/name> "y"@fr . # a comment
<http://e/a> <http://e/n> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .

<http://e/a> <http://e/knows> _:k .
_:k <http://e/name> "z" .
<http://e/a> <http://e/l> _:c1 .
_:c1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> <http://e/b> .
_:c1 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> _:c2 .
_:c2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#first> "c" .
_:c2 <http://www.w3.org/1999/02/22-rdf-syntax-ns#rest> <http://www.w3.org/1999/02/22-rdf-syntax-ns#nil> .
""",
    "jsonld": '{"@context": {"@vocab": "http://e/"}, "@id": "http://e/a", "@type": "T", "name": ["x", {"@value": "y", "@language": "fr"}], "n": 5, "knows": {"name": "z"}, "l": {"@list": [{"@id": "http://e/b"}, "c"]}}',
    "rdfxml": """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://e/" xmlns:e="http://e/"><T rdf:about="http://e/a" e:name="x">
 <name xml:lang="fr">y</name><n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</n><knows><rdf:Description e:name="z"/></knows>
 <l rdf:parseType="Resource"><rdf:first rdf:resource="http://e/b"/><rdf:rest rdf:parseType="Resource"><rdf:first>c</rdf:first><rdf:rest rdf:resource="http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"/></rdf:rest></l></T></rdf:RDF>""",
}
SAME["trig"], SAME["nquads"] = SAME["turtle"], SAME["ntriples"]
SUFFIX = {"turtle": "ttl", "ntriples": "nt", "jsonld": "jsonld", "rdfxml": "rdf", "trig": "trig", "nquads": "nq"}


def collected(df):
    return [Quad(from_struct(tuple(r.s)), IRI(r.p), from_struct(tuple(r.o)), None if r.g is None else from_struct(tuple(r.g))) for r in df.collect()]


@pytest.mark.parametrize("form", SAME)
def test_one_graph_in_all_formats(spark, tmp_path, form):
    want = parse_text(SAME["turtle"], "turtle")
    assert isomorphic(parse_text(SAME[form], form), want)
    path = tmp_path / f"doc.{SUFFIX[form]}"
    path.write_text(SAME[form])
    assert format_of(str(path)) == form
    assert isomorphic(collected(read_rdf(spark, str(path))), want)


def test_labels_of_two_files_stay_apart(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.nt").write_text(f'_:x <http://e/p> "{n}" .\n_:x <http://e/q> "{n}" .\n')
        (tmp_path / f"{n}.ttl").write_text(f'_:x <http://e/p> "{n}" ; <http://e/q> [] .')
    lines, whole = collected(read_rdf(spark, str(tmp_path / "*.nt"), "ntriples")), collected(read_rdf(spark, str(tmp_path / "*.ttl"), "turtle"))
    assert len({q.s for q in lines}) == 2 and len({q.s for q in whole}) == 2
    assert len(lines) == 4 and len({q.o for q in whole if isinstance(q.o, BNode)}) == 2


def test_escapes_and_hard_lines_in_the_line_reader(spark, tmp_path):
    text = "\n".join([
        r'<http://e/s> <http://e/p> "a\tb\n\"q\" \\ é \U0001F600 \' \\\'"  .', r'<http://e/s> <http://e/p> "plain\\nope"@EN-gb .', r"<http://e/é> <http://e/p> <http://e/o> <http://e/g> .",
        r'<http://e/s> <http://e/r> <<( <http://e/a> <http://e/b> "c"@en--ltr )>> .', r'_:b1 <http://e/p> "x"@en--rtl _:g .', "# only a comment", "   ", r'<http://e/s> <http://e/p> "dot . # in"^^<http://e/t>.',
    ])
    (tmp_path / "x.nq").write_text(text + "\n")
    got = collected(read_rdf(spark, str(tmp_path / "x.nq")))
    norm = lambda qs: [Quad(*[x._replace(lang=x.lang.lower()) if isinstance(x, Literal) else x for x in q]) for q in qs]
    assert isomorphic(norm(got), norm(parse_text(text, "nquads")))
    assert any(q.o == Literal('a\tb\n"q" \\ é 😀 \' \\\'') for q in got)


@pytest.mark.parametrize("line", ["<http://e/a> <http://e/b> .", "<a> <http://e/b> <http://e/c> .", '<http://e/a> <http://e/b> "x" "y" .', "<http://e/a> <http://e/b> 5 .", '"x" <http://e/b> <http://e/c> .', "<http://e/a> <http://e/b> <http://e/c> <http://e/g> .", "<http://e/a> _:b <http://e/c> .", "PREFIX : <http://e/>"])
def test_broken_lines_are_errors_in_both_readers(spark, tmp_path, line):
    (tmp_path / "x.nt").write_text(line + "\n")
    with pytest.raises(Exception, match="not a statement"):
        read_rdf(spark, str(tmp_path / "x.nt")).collect()
    with pytest.raises(ValueError):
        parse_text(line, "ntriples")


def test_turtle_by_hand():
    q = parse_text('PREFIX : <http://e/> BASE <http://b/d/> :a :p 42, -1.5, 1e3, true, <x>, <../y>, <#f>, """l"1\nl2""", \'s\', "é\\u00e9" .', "turtle")
    assert [x.o for x in q] == [Literal("42", datatype=INTEGER), Literal("-1.5", datatype=DECIMAL), Literal("1e3", datatype=DOUBLE), Literal("true", datatype=BOOLEAN), IRI("http://b/d/x"), IRI("http://b/y"), IRI("http://b/d/#f"), Literal('l"1\nl2'), Literal("s"), Literal("éé")]


def test_reifiers_and_annotations():
    t = TripleTerm(iri("a"), iri("b"), iri("c"))
    q = parse_text("PREFIX : <http://e/> :a :b :c ~ :r {| :src :d |} . << :a :b :c ~ :q >> :x 1 . :s :t <<( :a :b :c )>> .", "turtle")
    assert Quad(iri("a"), iri("b"), iri("c")) in q and Quad(iri("r"), IRI(REIFIES), t) in q and Quad(iri("r"), iri("src"), iri("d")) in q
    assert Quad(iri("q"), IRI(REIFIES), t) in q and Quad(iri("s"), iri("t"), t) in q and len(q) == 6


def test_trig_by_hand():
    q = parse_text('PREFIX : <http://e/> { :a :b 3.14 } :g { :a :b "} . {" . :c :d :e } GRAPH _:x { :f :g :h } :i :j :k .', "trig")
    assert [x.g for x in q][:3] == [None, iri("g"), iri("g")] and isinstance(q[3].g, BNode) and q[4].g is None and q[0].o.value == "3.14"


def test_rdfxml_by_hand():
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/x">'
    q = parse_text(head + '<e:T rdf:ID="i"><e:k><e:U rdf:nodeID="n"/></e:k><e:c rdf:parseType="Collection"><e:V/><rdf:Description rdf:about="y"/></e:c><e:x rdf:parseType="Literal">a <b/></e:x><rdf:li>1</rdf:li><rdf:li>2</rdf:li></e:T></rdf:RDF>', "rdfxml")
    assert IRI("http://b/x#i") == q[0].s and any(x.o == iri("U") for x in q) and any(x.o == iri("V") for x in q) and any(x.o == IRI("http://b/y") for x in q)
    assert {x.p.value[-2:] for x in q if "_" in x.p.value} == {"_1", "_2"}
    q = parse_text(head + '<rdf:Description rdf:about="s"><e:p rdf:ID="r">v</e:p></rdf:Description></rdf:RDF>', "rdfxml")
    assert len(q) == 5


BROKEN = [
    ("turtle", ":a :b :c ."), ("turtle", "<a> <b> <c>"), ("turtle", '<a> <b> "x'), ("turtle", "<a> <b> [ <c> ."), ("turtle", '<a> "b" <c> .'), ("turtle", "<a> <b> <c d> ."), ("turtle", '<a> <b> "\\uD800" .'), ("turtle", "@prefix x <y> ."),
    ("turtle", '<a> <b> "x"@en--up .'), ("trig", "<g> { <a> <b> <c> "), ("trig", "{ @prefix : <x> . }"), ("jsonld", "{"), ("jsonld", '{"@context": "http://remote"}'), ("jsonld", "5"), ("rdfxml", "<a>"),
    ("rdfxml", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:li/></rdf:RDF>'), ("rdfxml", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:ID="a" rdf:about="b"/></rdf:RDF>'), ("nquads", "<http://a> <http://b> <http://c> <http://d> <http://e> ."),
]


@pytest.mark.parametrize("form,text", BROKEN)
def test_malformed_documents_are_refused(form, text):
    with pytest.raises(ValueError):
        parse_text(text, form)


def test_reference_resolution():
    base = "http://a/b/c/d;p?q"
    for ref, want in {"g": "http://a/b/c/g", "./g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "#s": "http://a/b/c/d;p?q#s", "": base, "..": "http://a/b/", "../../../g": "http://a/g", "g#": "http://a/b/c/g#", "g:h": "g:h"}.items():
        assert iris.resolve(base, ref) == want, ref


def test_isomorphism():
    ring = lambda names: [Quad(BNode(names[i]), iri("p"), BNode(names[(i + 1) % len(names)])) for i in range(len(names))]
    assert isomorphic(ring("abcdef"), ring("fedcba")) and not isomorphic(ring("abcdef"), ring("abc") + ring("def"))
    assert isomorphic([], []) and not isomorphic(ring("ab"), [])
    assert not isomorphic([Quad(iri("a"), iri("p"), BNode("x"), iri("g"))], [Quad(iri("a"), iri("p"), BNode("x"))])
    assert same_solutions([{"a": BNode("x"), "b": BNode("x")}], [{"a": BNode("y"), "b": BNode("y")}])
    assert not same_solutions([{"a": BNode("x"), "b": BNode("x")}], [{"a": BNode("y"), "b": BNode("z")}])


def test_large_files_are_parsed_in_parts(spark, tmp_path, monkeypatch):
    """Parts of a file have the quads of the whole: prefixes that change, statements, brackets and graphs over many lines, dots and braces that end nothing."""
    from quadrille.sources import files

    rows = ["@prefix x: <http://x/0/> ."]
    trig = list(rows)
    for i in range(300):
        rows += [f"@prefix x: <http://x/{i // 50}/> . # a dot . {{" if i % 50 == 0 else "# . }", f'x:a.{i} x:p "a . b # {{ {i}" ,', f"  1.5 , _:b{i % 7} ;", "  x:q [ x:r 2.0 ;", f"    x:s ( {i} x:t ) ] ."]
        trig += [f"GRAPH x:g{i % 5}", "{ x:a x:p [ x:v", f" {i} ] . x:b x:p {i} ; x:q <http://e/{{|}}.> }}", f"x:c x:d {i} . PREFIX x: <http://x/{i // 90}/>"]
    rows[1] = rows[1].replace("{", "(")
    for form, text in (("turtle", "\n".join(rows)), ("trig", "\n".join(trig))):
        name = tmp_path / f"d.{form}"
        name.write_text(text.replace("http://e/{|}.", "http://e/."))
        monkeypatch.setattr(files, "LARGE", 1 << 60)
        want = read_rdf(spark, str(name), form).collect()
        monkeypatch.setattr(files, "LARGE", 0)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            parts, whole = files.read_parts(spark, [str(name)], form)
            assert not whole and parts.rdd.getNumPartitions() > 4
            got = read_rdf(spark, str(name), form).collect()
            # long strings and BASE: whole, as nothing is known of a line by itself
            for odd in ('\nx:l x:p """a\n. {""" .', "\nBASE <http://b/> <c> <d> <e> ."):
                (tmp_path / f"odd.{form}").write_text(name.read_text() + odd)
                assert files.read_parts(spark, [str(tmp_path / f"odd.{form}")], form)[0] is None
                assert read_rdf(spark, str(tmp_path / f"odd.{form}"), form).count() == len(want) + 1
            (tmp_path / f"bad.{form}").write_text(name.read_text() + "\nx:l .")
            with pytest.raises(Exception, match=f"line {text.count(chr(10)) + 2}:"):
                read_rdf(spark, str(tmp_path / f"bad.{form}"), form).count()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        parsed = lambda rs: [Quad(*(None if t is None else IRI(t) if isinstance(t, str) else from_struct(tuple(t)) for t in r)) for r in rs]
        plain = lambda qs: sorted(repr((q.p, q.o if "BNode" not in repr(q.o) else "_", q.s if "BNode" not in repr(q.s) else "_", q.g)) for q in qs)
        assert len(got) == len(want) and plain(parsed(got)) == plain(parsed(want))
