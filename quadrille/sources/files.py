"""RDF files as DataFrames of quads.

N-Triples and N-Quads are split by line and taken apart by expressions in the JVM, so one large file is many tasks. The
other formats have state (prefixes, nesting): a file is parsed in Python, whole or, if it is a large one of Turtle or TriG, in
parts that are cut between statements; files and parts are spread over tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as R
from . import iris, jsonld, rdfxml, turtle

#: Media types and file endings of each format.
MEDIA = {
    "application/n-triples": "ntriples", "text/plain": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/x-turtle": "turtle",
    "application/trig": "trig", "application/rdf+xml": "rdfxml", "application/ld+json": "jsonld",
}
ENDINGS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "trig": "trig", "rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "jsonld": "jsonld", "json": "jsonld"}


def format_of(name: str) -> str:
    """The format that a media type, a format's name or a path's ending stands for."""
    media = name.split(";")[0].strip().lower()
    if media in MEDIA:
        return MEDIA[media]
    if name in set(MEDIA.values()):
        return name
    ending = name.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if ending in ENDINGS:
        return ENDINGS[ending]
    raise ValueError(f"no reader for {name!r}; there are readers for {', '.join(sorted(MEDIA))}")


def parse_text(text: str, form: str, base: str = "", scope: str = "") -> list[R.Quad]:
    """The quads of a document in any format."""
    form = format_of(form)
    if form == "jsonld":
        return jsonld.parse(text, base, scope)
    if form == "rdfxml":
        return rdfxml.parse(text, base, scope)
    return turtle.parse(text, form, base, scope)


_IRI = r"<((?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)>"
_BLANK = r"_:([\p{L}\p{N}_](?:[\p{L}\p{M}\p{N}_.\-·]*[\p{L}\p{M}\p{N}_\-·])?)"
_STRING = r"\"((?:[^\"\\\n\r]|\\[tbnrf\"'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*)\""
_TAG = r"(?:@([A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*)(?:--(ltr|rtl))?|\^\^" + _IRI + ")?"
_LINE = rf"^[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|{_STRING}{_TAG})[ \t]*(?:(?:{_IRI}|{_BLANK})[ \t]*)?\.[ \t]*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    """Escapes resolved by the JSON reader, which has the same ones but for \\' and \\U."""
    json = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    json = F.regexp_replace(json, r"(?<!\\)((?:\\\\)*)\\U0000([0-9A-Fa-f]{4})", r"$1\\u$2")
    json = F.regexp_replace(json, "\t", r"\\t")
    return F.when(F.contains(c, F.lit("\\")), F.element_at(F.from_json(F.concat(F.lit('["'), json, F.lit('"]')), "array<string>"), 1)).otherwise(c)


def read_lines(spark: SparkSession, path: str, form: str = "ntriples") -> DataFrame:
    """Quads of N-Triples or N-Quads files. A line that is neither a statement, a comment nor blank is an error; a
    statement with a triple term or an escape beyond the basic plane is parsed in Python, others in the JVM."""
    lines = spark.read.text(path)
    scope = F.substring(F.sha1(F.input_file_name()), 1, 10)
    lines = lines.select("value", scope.alias("scope")).where(~F.col("value").rlike(r"^[ \t\r]*(#.*)?$"))
    hard = F.contains("value", F.lit("<<(")) | F.col("value").rlike(r"\\U000[1-9A-Fa-f]|\\U0010")
    # one match a line gives all parts: a line holds no line feed, and one that doesn't match stays as it is
    parts = F.split(F.regexp_replace("value", _LINE, "\n".join(f"${i}" for i in range(1, 12))), "\n", -1)
    easy = lines.where(~hard).select("scope", "value", parts.alias("m"))
    m = lambda i: F.get("m", i - 1)
    ok = (F.size("m") == 11) & F.forall(F.array(m(1), m(3), m(4), m(9), m(10)), lambda x: (x == "") | x.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    if form == "ntriples":
        ok = ok & (m(10) == "") & (m(11) == "")
    broken = F.raise_error(F.concat(F.lit("not a statement: "), F.substring("value", 1, 200)))
    label = lambda c: F.concat("scope", F.lit("-"), c)
    node = lambda i, b: F.when(m(b) != "", R.struct(R.K_BNODE, label(m(b)))).otherwise(R.struct(R.K_IRI, _unescaped(m(i))))
    kind = F.when(m(8) != "", R.DIR_LANG_STRING).when(m(7) != "", R.LANG_STRING).when(m(9) != "", _unescaped(m(9))).otherwise(R.STRING)
    literal = R.struct(R.K_LITERAL, _unescaped(m(6)), F.lower(m(7)), m(8), kind)
    is_node = (m(4) != "") | (m(5) != "")
    o = F.when(is_node, node(4, 5)).otherwise(literal)
    g = F.when((m(10) != "") | (m(11) != ""), node(10, 11))
    out = easy.select(F.when(ok, node(1, 2)).otherwise(broken.cast(R.TERM)).alias("s"), _unescaped(m(3)).alias("p"), o.alias("o"), g.alias("g"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [q.row() for t, scope in zip(f["value"], f["scope"]) for q in turtle.parse(t, form, scope=scope + "-")]
            yield _frame(rows)

    # the hard lines are few: one pass over the text each, and nothing is kept of the others
    rest = lines.where(hard).mapInPandas(parse, R.QUADS)
    return out.unionByName(rest)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    as_dict = lambda t: None if t is None else dict(zip(("k", "v", "l", "d", "dt"), t))
    return pd.DataFrame({"s": [as_dict(r[0]) for r in rows], "p": [r[1] for r in rows], "o": [as_dict(r[2]) for r in rows], "g": [as_dict(r[3]) for r in rows]}, dtype=object)


def _scope(file: str) -> str:
    """What is put before blank nodes' labels of a file."""
    return hashlib.sha1(file.encode()).hexdigest()[:10] + "-"


def _frames(quads: Iterator[R.Quad]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for q in quads:
        rows.append(q.row())
        if len(rows) == 20_000:
            yield _frame(rows)
            rows = []
    yield _frame(rows)


def read_whole(spark: SparkSession, path: str | list[str], form: str, base: str = "") -> DataFrame:
    """Quads of files that are parsed whole. Without a base, a file's own place is the base."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text, file in zip(f["value"], f["file"]):
                scope = _scope(file)
                if form in turtle.FORMATS:
                    source: Iterator[R.Quad] = turtle.Parser(text, form, base or file, scope).quads()
                else:
                    source = iter(parse_text(text, form, base or file, scope))
                yield from _frames(source)

    return files.mapInPandas(parse, R.QUADS)


#: Turtle and TriG files from this size on are parsed in parts, of the size that Spark splits text in.
LARGE = 8 << 20
#: What a part has before its first cut or after its last goes to the driver, up to so many characters.
MOST_SEAM = 1 << 20
_AT = "file string, block long"


def _by_part(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each part of a file that a task reads, in their order."""
    rows = ((key, line) for f in frames for key, line in zip(zip(f["file"], f["block"]), f["value"]))
    for key, own in groupby(rows, key=lambda x: x[0]):
        yield key, (line for _, line in own)


def read_parts(spark: SparkSession, paths: list[str], form: str, base: str = "") -> tuple[DataFrame | None, list[str]]:
    """Quads of large Turtle or TriG files, a part of a file a task, and the files that can't be parsed so. One pass finds where parts can be cut and
    which prefixes they declare; statements that lie in two parts are parsed by the driver, the others in a second pass."""
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, block), own in _by_part(frames):
            cuts = turtle.Cuts(form, block == 0)
            for x in own:
                cuts.line(x)
            head, tail = "\n".join(cuts.head), "\n".join(cuts.tail)
            if cuts.first is None or cuts.whole or max(len(head), len(tail)) > MOST_SEAM:
                yield pd.DataFrame([(file, block, None)], columns=["file", "block", "found"])
            else:
                yield pd.DataFrame([(file, block, json.dumps([cuts.count, cuts.first, cuts.last, head, tail, cuts.prefixes]))], columns=["file", "block", "found"])

    parts: dict[str, list[tuple[int, str | None]]] = {}
    for file, block, found in lines.mapInPandas(scan, f"{_AT}, found string").collect():
        parts.setdefault(file, []).append((block, found))
    whole = [file for file, own in parts.items() if any(found is None for _, found in own)]
    starts: dict[tuple[str, int], tuple] = {}
    seams: list[R.Quad] = []
    for file, own in parts.items():
        if file in whole:
            continue
        scope = _scope(file)
        known: dict[str, str] = {}
        text, line = "", 0  # what is open, and the line that it begins in
        before = 0
        for block, found in [*sorted(own), (-1, None)]:
            count, first, last, head, tail, prefixes = json.loads(found) if found else (0, None, None, "", "", {})
            p = turtle.Parser(text + head, form, base or file, scope)
            p.prefixes, p.lines_before, p.part = dict(known), line, f"s{block}."
            seams += p.quads()
            if found:
                known = p.prefixes
                starts[file, block] = (first, last, known, before + first[0])
                known = known | {n: iris.resolve(base or file, turtle.unescape(x[1:-1])) for n, x in prefixes.items()}
                # a part ends with a line
                text, line, before = tail + "\n", before + last[0], before + count

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, block), own in _by_part(frames):
            if (file, block) not in starts:
                continue
            (a, i), (b, j), known, before = starts[file, block]
            kept = [x for n, x in enumerate(own) if a <= n <= b]
            kept[-1] = kept[-1][:j]
            kept[0] = kept[0][i:]
            p = turtle.Parser("\n".join(kept), form, base or file, _scope(file))
            p.prefixes, p.lines_before, p.part = dict(known), before, f"b{block}."
            yield from _frames(p.quads())

    out = lines.mapInPandas(parse, R.QUADS) if starts else None
    if out is not None and seams:
        out = out.unionByName(spark.createDataFrame([q.row() for q in seams], R.QUADS))
    return out, whole


def read_files(spark: SparkSession, path: str, form: str, base: str = "") -> DataFrame:
    """Quads of files of a format with state: small ones are parsed whole, large Turtle and TriG in parts where that can be."""
    if form not in turtle.FORMATS:
        return read_whole(spark, path, form, base)
    place = {name: (at, n) for name, at, n in spark.read.format("binaryFile").load(path).select(F.input_file_name(), "path", "length").collect()}
    large = [at for at, n in place.values() if n >= LARGE and not at.endswith(".gz")]
    if not large:
        return read_whole(spark, path, form, base)
    parts, left = read_parts(spark, large, form, base)
    whole = [place[name][0] for name in left] + [at for at, _ in place.values() if at not in set(large)]
    found = [x for x in (parts, read_whole(spark, whole, form, base) if whole else None) if x is not None]
    return reduce(DataFrame.unionByName, found)


def read_rdf(spark: SparkSession, path: str, form: str | None = None, base: str = "", lenient: bool = False) -> DataFrame:
    """Quads of a file or folder, each once. The format is a name, a media type, or found by the path's ending;
    lenient reads N-Triples as Turtle, which takes more."""
    form = format_of(form or path)
    if form in ("ntriples", "nquads") and not lenient:
        out = read_lines(spark, path, form)
    else:
        out = read_files(spark, path, "turtle" if form == "ntriples" else form, base)
    return out.dropDuplicates(["s", "p", "o", "g"])
