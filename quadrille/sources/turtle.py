"""N-Triples, N-Quads, Turtle and TriG with the RDF 1.2 additions: one token table, one recursive parser.

The line formats are the same grammar with most of it switched off. Triples with triple terms, reifiers and
annotations come out as plain quads."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .. import terms as R
from ..terms import BNode, IRI, Literal, Quad, TripleTerm
from . import iris

FORMATS = ("ntriples", "nquads", "turtle", "trig")

_BASE = "A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
_CHAR = _BASE + "_\\-0-9·̀-ͯ‿-⁀"
_NAME = f"[{_BASE}](?:[{_CHAR}.]*[{_CHAR}])?"
_ESC = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_LOCAL = rf"(?:[{_BASE}_:0-9]|{_ESC})(?:(?:[{_CHAR}.:]|{_ESC})*(?:[{_CHAR}:]|{_ESC}))?"
_UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_ECHAR = rf"""\\[tbnrf"'\\]|{_UCHAR}"""
_TOKEN = re.compile(
    "|".join(
        f"(?P<{k}>{v})"
        for k, v in {
            "skip": r"(?:[ \t\r\n]|#[^\r\n]*)+",
            "open": r"<<\(|<<",
            "close": r"\)>>|>>",
            "iri": rf'<(?:[^\x00-\x20<>"{{}}|^`\\]|{_UCHAR})*>',
            "annot": r"\{\||\|\}",
            "long": rf'"""(?:"{{0,2}}(?:[^"\\]|{_ECHAR}))*"""' + rf"|'''(?:'{{0,2}}(?:[^'\\]|{_ECHAR}))*'''",
            "string": rf'"(?:[^"\\\n\r]|{_ECHAR})*"' + rf"|'(?:[^'\\\n\r]|{_ECHAR})*'",
            "bnode": rf"_:[{_BASE}_0-9](?:[{_CHAR}.]*[{_CHAR}])?",
            "pname": rf"(?:{_NAME})?:(?:{_LOCAL})?",
            "at": r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[A-Za-z]+)?",
            "double": r"[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+",
            "decimal": r"[+-]?\d*\.\d+",
            "integer": r"[+-]?\d+",
            "word": r"[A-Za-z]+",
            "punct": r"\^\^|[{}()\[\];,.~]",
        }.items()
    )
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m[1]
        if len(e) == 1:
            return _PLAIN[e]
        code = int(e[1:], 16)
        if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
            raise ValueError(f"\\{e} is not a character")
        return chr(code)

    return _ESCAPE.sub(one, text) if "\\" in text else text


class Parser:
    """A document's quads. scope is put before blank node labels, so that those of two documents stay apart."""

    def __init__(self, text: str, form: str = "turtle", base: str = "", scope: str = ""):
        if form not in FORMATS:
            raise ValueError(f"not one of {', '.join(FORMATS)}: {form}")
        self.text, self.base, self.scope = text, base, scope
        self.lines, self.graphs = form in ("ntriples", "nquads"), form in ("trig", "nquads")
        self.prefixes: dict[str, str] = {}
        self.made = 0
        self.lines_before, self.part = 0, ""  # of a part of a document: how many lines are before it, and what tells its fresh nodes apart
        self.at = 0
        self.kind = self.value = ""
        self.start = 0
        self.graph: object = None
        self.out: list[Quad] = []
        self.advance()

    def advance(self) -> str:
        """Move to the next token; returns the one before."""
        before = self.value
        while True:
            if self.at >= len(self.text):
                self.kind, self.value, self.start = "end", "", self.at
                return before
            m = _TOKEN.match(self.text, self.at)
            if m is None:
                raise self.fail(f"unexpected {self.text[self.at : self.at + 12]!r}", self.at)
            self.start, self.at = self.at, m.end()
            if m.lastgroup != "skip":
                self.kind, self.value = m.lastgroup, m[0]
                return before

    def fail(self, what: str, at: int | None = None) -> ValueError:
        at = self.start if at is None else at
        return ValueError(f"line {self.lines_before + self.text.count(chr(10), 0, at) + 1}: {what}")

    def got(self, sign: str) -> bool:
        if self.value == sign and self.kind in ("punct", "open", "close", "annot"):
            self.advance()
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.got(sign):
            raise self.fail(f"expected {sign!r}, found {self.value!r}")

    # terms

    def iri(self) -> IRI:
        if self.kind == "iri":
            ref = iris.check(unescape(self.advance()[1:-1]))
            if self.lines:
                if not iris.is_absolute(ref):
                    raise self.fail(f"relative IRI {ref!r}")
                return IRI(ref)
            return IRI(iris.resolve(self.base, ref))
        if self.kind == "pname" and not self.lines:
            prefix, _, local = self.value.partition(":")
            if prefix not in self.prefixes:
                raise self.fail(f"undeclared prefix {prefix!r}")
            self.advance()
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise self.fail(f"expected an IRI, found {self.value!r}")

    def fresh(self) -> BNode:
        self.made += 1
        return BNode(f"{self.scope}.{self.part}{self.made}")

    def literal(self) -> Literal | None:
        kind = self.kind
        if kind == "string" or (kind == "long" and not self.lines):
            if self.lines and self.value[0] == "'":
                raise self.fail("a string in single quotes")
            raw = self.advance()
            q = 3 if kind == "long" else 1
            text = unescape(raw[q:-q])
            if self.kind == "at":
                lang, _, direction = self.advance()[1:].partition("--")
                if direction not in ("", "ltr", "rtl"):
                    raise self.fail(f"direction {direction!r}")
                if len(lang.split("-")[0]) > 8 or any(len(x) > 8 for x in lang.split("-")):
                    raise self.fail(f"language {lang!r}")
                return Literal(text, lang, direction)
            if self.got("^^"):
                kind_iri = self.iri().value
                if kind_iri in (R.LANG_STRING, R.DIR_LANG_STRING):
                    raise self.fail("a language string without a language")
                return Literal(text, datatype=kind_iri)
            return Literal(text)
        if self.lines:
            return None
        if kind in ("integer", "decimal", "double"):
            return Literal(self.advance(), datatype={"integer": R.INTEGER, "decimal": R.DECIMAL, "double": R.DOUBLE}[kind])
        if kind == "word" and self.value in ("true", "false"):
            return Literal(self.advance(), datatype=R.BOOLEAN)
        return None

    def triple_term(self) -> TripleTerm:
        """What follows `<<(`."""
        s = self.subject(plain=True)
        p = self.verb()
        o = self.object(plain=True)
        self.need(")>>")
        return TripleTerm(s, p, o)

    def reified(self) -> object:
        """What follows `<<`: a reifier of a triple that isn't asserted."""
        s = self.reified() if self.got("<<") else self.subject(plain=True)
        p = self.verb()
        o = self.reified() if self.got("<<") else self.object(plain=True)
        me = self.reifier() if self.got("~") else self.fresh()
        self.need(">>")
        self.emit(me, IRI(R.REIFIES), TripleTerm(s, p, o))
        return me

    def reifier(self) -> object:
        return self.subject(plain=True) if self.kind in ("iri", "pname", "bnode") else self.fresh()

    def subject(self, plain: bool = False) -> object:
        """An IRI or blank node; unless plain, also what makes triples of its own."""
        if self.kind == "bnode":
            return BNode(self.scope + self.advance()[2:])
        if not self.lines:
            if self.value == "[" and self.kind == "punct":
                self.advance()
                if plain or self.value == "]":
                    self.need("]")
                    return self.fresh()
                return self.properties_in_brackets()
            if not plain and self.got("("):
                return self.collection()
        return self.iri()

    def object(self, plain: bool = False) -> object:
        if self.got("<<("):
            return self.triple_term()
        if not plain and not self.lines and self.got("<<"):
            return self.reified()
        x = self.literal()
        return self.subject(plain) if x is None else x

    def verb(self) -> IRI:
        if self.kind == "word" and self.value == "a" and not self.lines:
            self.advance()
            return IRI(R.TYPE)
        return self.iri()

    def properties_in_brackets(self) -> BNode:
        me = self.fresh()
        self.properties(me)
        self.need("]")
        return me

    def collection(self) -> object:
        items = []
        while not self.got(")"):
            if self.kind == "end":
                raise self.fail("an open collection")
            items.append(self.object())
        cells = [self.fresh() for _ in items]
        for i, (cell, x) in enumerate(zip(cells, items)):
            self.emit(cell, IRI(R.FIRST), x)
            self.emit(cell, IRI(R.REST), cells[i + 1] if i + 1 < len(cells) else IRI(R.NIL))
        return cells[0] if cells else IRI(R.NIL)

    # statements

    def emit(self, s: object, p: object, o: object) -> None:
        self.out.append(Quad(s, p, o, self.graph))

    def properties(self, me: object) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.object()
                self.emit(me, p, o)
                self.annotations(me, p, o)
                if not self.got(","):
                    break
            if not self.got(";"):
                return
            while self.got(";"):
                pass
            if self.value in (".", "]", "|}", "}") or self.kind == "end":
                return

    def annotations(self, s: object, p: object, o: object) -> None:
        me: object = None
        while True:
            if self.got("~"):
                me = self.reifier()
                self.emit(me, IRI(R.REIFIES), TripleTerm(s, p, o))
            elif self.got("{|"):
                if me is None:
                    me = self.fresh()
                    self.emit(me, IRI(R.REIFIES), TripleTerm(s, p, o))
                self.properties(me)
                self.need("|}")
                me = None
            else:
                return

    def triples(self, me: object = None, loose: bool = False) -> None:
        """A subject, unless given, and its properties; loose: they may be missing."""
        if me is None:
            if self.got("<<"):
                me, loose = self.reified(), True
            else:
                loose = self.value == "[" and self.kind == "punct"
                me = self.subject()
                loose = loose and not (isinstance(me, BNode) and self.text[: self.start].rstrip().endswith("[]"))
        if not (loose and self.value in (".", "}")):
            self.properties(me)

    def directive(self) -> bool:
        if self.lines:
            return False
        old = self.kind == "at" and self.value in ("@prefix", "@base", "@version")
        if not old and not (self.kind == "word" and self.value.upper() in ("PREFIX", "BASE", "VERSION")):
            return False
        word = self.advance().lstrip("@").upper()
        if word == "VERSION":
            if self.kind != "string":
                raise self.fail("expected a version in quotes")
            self.advance()
        elif word == "BASE":
            if self.kind != "iri":
                raise self.fail("expected an IRI")
            self.base = self.iri().value
        else:
            if self.kind != "pname" or not self.value.endswith(":") or self.value.count(":") > 1:
                raise self.fail("expected a prefix")
            name = self.advance()[:-1]
            if self.kind != "iri":
                raise self.fail("expected an IRI")
            self.prefixes[name] = self.iri().value
        if old:
            self.need(".")
        return True

    def block(self, name: object) -> None:
        """The braces of a graph."""
        self.need("{")
        self.graph = name
        while not self.got("}"):
            self.triples()
            if not self.got("."):
                self.need("}")
                break
        self.graph = None

    def statement(self) -> None:
        if self.lines:
            if self.kind == "bnode" or self.kind == "iri":
                s = self.subject()
            else:
                raise self.fail(f"expected a subject, found {self.value!r}")
            p, o = self.iri(), self.object()
            if self.graphs and self.kind in ("iri", "bnode"):
                self.graph = self.subject()
            self.emit(s, p, o)
            self.graph = None
            self.need(".")
            return
        if self.directive():
            return
        if self.graphs:
            if self.kind == "word" and self.value.upper() == "GRAPH":
                self.advance()
                return self.block(self.subject(plain=True))
            if self.value == "{" and self.kind == "punct":
                return self.block(None)
            if self.kind in ("iri", "pname", "bnode") or (self.value == "[" and self.kind == "punct"):
                bracket = self.value == "["
                before = self.made
                me = self.subject()
                if self.value == "{" and self.kind == "punct":
                    if bracket and self.made > before + 1:
                        raise self.fail("a graph has no properties here")
                    return self.block(me)
                filled = bracket and bool(self.out) and self.out[-1].s == me
                self.triples(me, loose=filled)
                return self.need(".")
        self.triples()
        self.need(".")

    def parse(self) -> list[Quad]:
        while self.kind != "end":
            self.statement()
        return self.out

    def quads(self) -> Iterator[Quad]:
        """The quads, statement by statement."""
        while self.kind != "end":
            self.statement()
            yield from self.out
            self.out.clear()


class Cuts:
    """Where the lines of a part of a Turtle or TriG document can be cut: after the statements that end at its outermost level. Every
    line begins a token, so that a part is read without what is before it. whole: that doesn't hold (long strings may
    hold line ends), or terms depend on more than prefixes (BASE)."""

    def __init__(self, form: str, first: bool):
        self.trig, self.depth = form == "trig", 0 if form != "trig" or first else None
        self.count, self.whole = 0, False
        self.first: tuple[int, int] | None = None
        self.last: tuple[int, int] | None = None
        self.prefixes: dict[str, str] = {}  # of all statements before the last cut and after the first, as they are written
        self.since: dict[str, str] = {}
        self.head: list[str] = []
        self.tail: list[str] = []
        self.pending: list[str] | None = None

    def line(self, text: str) -> None:
        self.whole = self.whole or '"""' in text or "'''" in text
        if self.whole:
            return
        begin = 0
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "punct":
                x = m[0]
                if x == "{":
                    self.depth = 1
                elif x == "}" or (x == "." and self.depth == 0):
                    self.depth = 0
                    if self.first is None:
                        self.head.append(text[: m.end()])
                        self.first, self.since = (self.count, m.end()), {}
                    self.last, begin = (self.count, m.end()), m.end()
                    self.prefixes |= self.since
                    self.since, self.tail = {}, []
            elif (kind == "at" and m[0] == "@base") or (kind == "word" and m[0].upper() == "BASE"):
                self.whole = True
                return
            elif (kind == "at" and m[0] == "@prefix") or (kind == "word" and m[0].upper() == "PREFIX"):
                self.pending = []
            elif self.pending is not None and kind in ("pname", "iri"):
                self.pending.append(m[0])
                if len(self.pending) == 2:
                    self.since[self.pending[0][:-1]] = self.pending[1]
                    self.pending = None
        if self.first is None:
            self.head.append(text)
        else:
            self.tail.append(text[begin:])
        self.count += 1


def parse(text: str, form: str = "turtle", base: str = "", scope: str = "") -> list[Quad]:
    """The quads of a document; ValueError with the line where it is malformed."""
    return Parser(text, form, base, scope).parse()


def parse_term(text: str) -> object:
    """A term from its canonical form."""
    p = Parser(text, "ntriples")
    return p.object()
