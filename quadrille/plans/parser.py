"""SPARQL 1.1 query text to algebra: a table of tokens and one method for each rule of the grammar."""

from __future__ import annotations

import re
from itertools import count

from ..terms import BOOLEAN, DECIMAL, DOUBLE, FIRST, INTEGER, NIL, REST, STRING, TYPE, BNode, IRI, Literal
from ..sources.iris import resolve
from . import algebra as A


class SparqlSyntaxError(ValueError):
    """The query text isn't SPARQL; says what was expected and where."""


_BASE = r"A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�𐀀-󯿿"
_CHAR = _BASE + r"_\-0-9·̀-ͯ‿-⁀"
_PREFIX = rf"[{_BASE}](?:[{_CHAR}.]*[{_CHAR}])?"
_ESC = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_LOCAL = rf"(?:[{_BASE}_:0-9]|{_ESC})(?:(?:[{_CHAR}.:]|{_ESC})*(?:[{_CHAR}:]|{_ESC}))?"
_TOKENS = re.compile(
    "|".join(
        f"(?P<{k}>{v})"
        for k, v in {
            "skip": r"(?:\s|#[^\n\r]*)+",
            "iri": r'<[^<>"{}|^`\\\x00-\x20]*>',
            "pname": rf"(?:{_PREFIX})?:(?:{_LOCAL})?",
            "bnode": rf"_:[{_BASE}_0-9](?:[{_CHAR}.]*[{_CHAR}])?",
            "var": rf"[?$][{_BASE}_0-9][{_BASE}_0-9·̀-ͯ‿-⁀]*",
            "lang": r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--[A-Za-z]+)?",
            "double": r"(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+",
            "decimal": r"\d*\.\d+",
            "integer": r"\d+",
            "string": r'"""(?:"{0,2}(?:[^"\\]|\\.))*"""' + r"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''" + r'|"(?:[^"\\\n\r]|\\.)*"' + r"|'(?:[^'\\\n\r]|\\.)*'",
            "word": r"[A-Za-z][A-Za-z0-9_]*",
            "punct": r"\^\^|\|\||&&|!=|<=|>=|[{}()\[\];,.=<>!+\-*/|^?]",
        }.items()
    ),
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
#: Functions and the numbers of arguments they take.
FUNCTIONS = {
    "STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "IRI": (1, 1), "URI": (1, 1), "BNODE": (0, 1),
    "RAND": (0, 0), "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 1), "CONCAT": (0, 99), "STRLEN": (1, 1), "SUBSTR": (2, 3),
    "UCASE": (1, 1), "LCASE": (1, 1), "ENCODE_FOR_URI": (1, 1), "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "STRBEFORE": (2, 2),
    "STRAFTER": (2, 2), "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "HOURS": (1, 1), "MINUTES": (1, 1), "SECONDS": (1, 1), "TIMEZONE": (1, 1),
    "TZ": (1, 1), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0), "MD5": (1, 1), "SHA1": (1, 1), "SHA256": (1, 1), "SHA384": (1, 1),
    "SHA512": (1, 1), "COALESCE": (0, 99), "IF": (3, 3), "STRLANG": (2, 2), "STRDT": (2, 2), "SAMETERM": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1),
    "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "ISNUMERIC": (1, 1), "REGEX": (2, 3), "REPLACE": (3, 4), "ISTRIPLE": (1, 1),
}


def unescape(text: str) -> str:
    """Resolve the escapes of a string or IRI; an escape that the grammar doesn't have is an error."""

    def one(m: re.Match) -> str:
        e = m[1]
        if len(e) > 1:
            code = int(e[1:], 16)
            if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
                raise SparqlSyntaxError(f"\\{e} is not a character")
            return chr(code)
        if e not in _PLAIN:
            raise SparqlSyntaxError(f"unknown escape \\{e}")
        return _PLAIN[e]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class Parser:
    def __init__(self, text: str, base: str = ""):
        self.text, self.base, self.prefixes = text, base, {}
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if m is None:
                raise SparqlSyntaxError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.i = 0
        self.fresh = count()
        self.labels: dict[str, object] = {}
        self.in_template = False

    # tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def fail(self, wanted: str) -> SparqlSyntaxError:
        k, v, at = self.tokens[self.i]
        return SparqlSyntaxError(f"expected {wanted}, found {v or 'the end'!r} at {at}")

    def take(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def is_(self, *options: str) -> bool:
        """Whether the next token is one of these signs or, in any case, words."""
        return (self.kind == "punct" and self.value in options) or (self.kind == "word" and self.value.upper() in options)

    def got(self, *options: str) -> str:
        return self.take().upper() if self.is_(*options) else ""

    def need(self, *options: str) -> str:
        if not self.is_(*options):
            raise self.fail(" or ".join(options))
        return self.take().upper()

    # terms

    def resolve(self, ref: str) -> IRI:
        ref = unescape(ref)
        return IRI(resolve(self.base, ref))

    def iri(self) -> IRI:
        if self.kind == "iri":
            return self.resolve(self.take()[1:-1])
        if self.kind == "pname":
            prefix, _, local = self.take().partition(":")
            if prefix not in self.prefixes:
                self.i -= 1
                raise self.fail("a declared prefix")
            return IRI(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise self.fail("an IRI")

    def var(self) -> A.Var:
        if self.kind != "var":
            raise self.fail("a variable")
        return A.Var(self.take()[1:])

    def string(self) -> str:
        raw = self.take()
        q = 3 if raw[:3] in ('"""', "'''") else 1
        return unescape(raw[q:-q])

    def literal(self) -> Literal | None:
        """A literal, or None where the next token begins none."""
        k = self.kind
        if k == "string":
            text = self.string()
            if self.kind == "lang":
                lang, _, direction = self.take()[1:].partition("--")
                if direction not in ("", "ltr", "rtl"):
                    raise self.fail("ltr or rtl")
                return Literal(text, lang, direction)
            return Literal(text, datatype=self.iri().value) if self.got("^^") else Literal(text)
        if k in ("integer", "decimal", "double"):
            return Literal(self.take(), datatype={"integer": INTEGER, "decimal": DECIMAL, "double": DOUBLE}[k])
        if self.is_("TRUE", "FALSE"):
            return Literal(self.take().lower(), datatype=BOOLEAN)
        if self.is_("+", "-") and self.tokens[self.i + 1][0] in ("integer", "decimal", "double"):
            sign = self.take()
            x = self.literal()
            return x._replace(value=sign + x.value)
        return None

    def blank(self, label: str | None = None) -> object:
        """A blank node: a term in a template, else a variable that no query can name."""
        if label is not None and label in self.labels:
            return self.labels[label]
        name = f"b{next(self.fresh)}"
        node = BNode(name) if self.in_template else A.Var("." + name)
        if label is not None:
            self.labels[label] = node
        return node

    def node(self, triples: list | None = None) -> object:
        """A variable or term; where triples is given, also blank node property lists and collections."""
        if self.kind == "var":
            return self.var()
        if self.kind == "bnode":
            return self.blank(self.take())
        if self.kind in ("iri", "pname"):
            return self.iri()
        if (x := self.literal()) is not None:
            return x
        if triples is not None and self.got("["):
            me = self.blank()
            if not self.got("]"):
                self.properties(me, triples)
                self.need("]")
            return me
        if triples is not None and self.got("("):
            items = []
            while not self.got(")"):
                items.append(self.node(triples))
            head: object = IRI(NIL)
            for x in reversed(items):
                me = self.blank()
                triples += [A.Triple(me, IRI(FIRST), x), A.Triple(me, IRI(REST), head)]
                head = me
            return head
        raise self.fail("a term")

    # triples and paths

    def triples(self) -> list[A.Triple]:
        out: list[A.Triple] = []
        while True:
            compound = self.is_("[", "(")
            me = self.node(out)
            if not (compound and self.is_(".", "}")):
                self.properties(me, out)
            if not self.got(".") or self.kind not in ("var", "iri", "pname", "bnode", "string", "integer", "decimal", "double", "punct", "word"):
                return out
            if (self.kind == "punct" and not self.is_("[", "(", "+", "-")) or (self.kind == "word" and not self.is_("TRUE", "FALSE")):
                return out

    def properties(self, me: object, out: list[A.Triple]) -> None:
        while True:
            p = self.verb()
            while True:
                o = self.node(out)
                out.append(A.Triple(me, p, o))
                if not self.got(","):
                    break
            if not self.got(";"):
                return
            while self.got(";"):
                pass
            if self.is_(".", "]", "}") or self.kind == "end" or self.is_("OPTIONAL", "FILTER", "MINUS", "GRAPH", "BIND", "VALUES", "SERVICE"):
                return

    def verb(self) -> object:
        if self.kind == "var":
            return self.var()
        return self.path() if not self.in_template else self.step()

    def path(self) -> object:
        parts = [self.path_sequence()]
        while self.got("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else A.Alternative(tuple(parts))

    def path_sequence(self) -> object:
        parts = [self.path_inverse()]
        while self.got("/"):
            parts.append(self.path_inverse())
        return parts[0] if len(parts) == 1 else A.Sequence(tuple(parts))

    def path_inverse(self) -> object:
        if self.got("^"):
            return A.Inverse(self.path_inverse())
        p = self.step()
        # `?x` is lexed as a variable, so a lone `?` is always the modifier
        if m := self.got("?", "*", "+"):
            return A.Repeat(p, 0 if m in "?*" else 1, m != "?")
        return p

    def step(self) -> object:
        if self.kind == "word" and self.value == "a":
            self.take()
            return IRI(TYPE)
        if self.got("("):
            p = self.path()
            self.need(")")
            return p
        if self.got("!"):
            many = self.got("(")
            sides: tuple[list, list] = ([], [])
            while not (many and self.is_(")")):
                back = bool(self.got("^"))
                sides[back].append(IRI(TYPE) if self.kind == "word" and self.value == "a" and self.take() else self.iri())
                if not (many and self.got("|")):
                    break
            if many:
                self.need(")")
            return A.NotIn(tuple(sides[0]), tuple(sides[1]))
        return self.iri()

    # groups

    def group(self) -> object:
        self.need("{")
        if self.is_("SELECT"):
            out = A.SubSelect(self.select(sub=True))
            self.need("}")
            return out
        now: object = A.Unit()
        filters: list = []
        join = lambda a, b: b if isinstance(a, A.Unit) else A.Join(a, b)
        while not self.got("}"):
            if self.got("FILTER"):
                filters.append(self.constraint())
            elif self.got("OPTIONAL"):
                inner = self.group()
                # what the inner group filters may see the outer solution
                now = A.LeftJoin(now, inner.pattern, inner.conditions) if isinstance(inner, A.Filter) else A.LeftJoin(now, inner)
            elif self.got("MINUS"):
                now = A.Minus(now, self.group())
            elif self.got("GRAPH"):
                name = self.var() if self.kind == "var" else self.iri()
                now = join(now, A.Graph(name, self.group()))
            elif self.got("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                v = self.var()
                self.need(")")
                if v.name in A.variables(now):
                    raise SparqlSyntaxError(f"?{v.name} is bound before BIND")
                now = A.Extend(now, v, e)
            elif self.got("VALUES"):
                now = join(now, self.values())
            elif self.is_("SERVICE"):
                raise SparqlSyntaxError("SERVICE is not supported: there is no network in a plan")
            elif self.is_("{"):
                part = self.group()
                while self.got("UNION"):
                    part = A.Union(part, self.group())
                now = join(now, part)
            else:
                block = A.BGP(tuple(self.triples()))
                # blocks that only a filter stands between are one basic pattern
                if isinstance(now, A.BGP):
                    now = A.BGP(now.triples + block.triples)
                elif isinstance(now, A.Join) and isinstance(now.right, A.BGP):
                    now = A.Join(now.left, A.BGP(now.right.triples + block.triples))
                else:
                    now = join(now, block)
                if not self.is_("}", "{", "FILTER", "OPTIONAL", "MINUS", "GRAPH", "BIND", "VALUES", "SERVICE"):
                    raise self.fail("'.' or '}'")
                continue
            self.got(".")
        return A.Filter(now, tuple(filters)) if filters else now

    def values(self) -> A.Values:
        many = self.got("(")
        names: list[A.Var] = []
        while self.kind == "var":
            names.append(self.var())
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.got("}"):
            if many:
                self.need("(")
                row = []
                while not self.got(")"):
                    row.append(self.datum())
            else:
                row = [self.datum()]
            if len(row) != len(names):
                raise self.fail(f"{len(names)} values")
            rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    def datum(self) -> object:
        if self.got("UNDEF"):
            return None
        x = self.node()
        if isinstance(x, A.Var):
            raise self.fail("a constant")
        return x

    # expressions, loosest first

    def constraint(self) -> object:
        if self.is_("("):
            return self.bracketed()
        return self.primary()

    def bracketed(self) -> object:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def expression(self) -> object:
        left = self.conjunction()
        while self.got("||"):
            left = A.Call("||", (left, self.conjunction()))
        return left

    def conjunction(self) -> object:
        left = self.relation()
        while self.got("&&"):
            left = A.Call("&&", (left, self.relation()))
        return left

    def relation(self) -> object:
        left = self.sum()
        if op := self.got("=", "!=", "<", ">", "<=", ">="):
            return A.Call(op, (left, self.sum()))
        if self.got("IN"):
            return A.Call("IN", (left, *self.arguments()))
        if self.got("NOT"):
            self.need("IN")
            return A.Call("!", (A.Call("IN", (left, *self.arguments())),))
        return left

    def sum(self) -> object:
        left = self.product()
        while op := self.got("+", "-"):
            left = A.Call(op, (left, self.product()))
        return left

    def product(self) -> object:
        left = self.unary()
        while op := self.got("*", "/"):
            left = A.Call(op, (left, self.unary()))
        return left

    def unary(self) -> object:
        if self.got("!"):
            return A.Call("!", (self.unary(),))
        if self.is_("+", "-") and self.tokens[self.i + 1][0] in ("integer", "decimal", "double"):
            return self.literal()
        if self.got("+"):
            return A.Call("PLUS", (self.unary(),))
        if self.got("-"):
            return A.Call("NEGATE", (self.unary(),))
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out: list = []
        if self.got(")"):
            return out
        while True:
            out.append(self.expression())
            if self.need(",", ")") == ")":
                return out

    def primary(self) -> object:
        if self.is_("("):
            return self.bracketed()
        if self.kind == "var":
            return self.var()
        if self.kind in ("iri", "pname"):
            name = self.iri()
            return A.Call(name.value, tuple(self.arguments())) if self.is_("(") else name
        if self.is_("EXISTS"):
            self.take()
            return A.Exists(self.group(), False)
        if self.got("NOT"):
            self.need("EXISTS")
            return A.Exists(self.group(), True)
        if (x := self.literal()) is not None:
            return x
        name = self.value.upper()
        if self.kind == "word" and name in _AGGREGATES:
            self.take()
            return self.aggregate(name)
        if self.kind == "word" and name in FUNCTIONS:
            self.take()
            args = self.arguments()
            low, high = FUNCTIONS[name]
            if not low <= len(args) <= high:
                raise self.fail(f"{low} to {high} arguments of {name}")
            if name == "BOUND" and not isinstance(args[0], A.Var):
                raise self.fail("a variable in BOUND")
            return A.Call({"URI": "IRI", "ISURI": "ISIRI"}.get(name, name), tuple(args))
        raise self.fail("an expression")

    def aggregate(self, name: str) -> A.Aggregate:
        self.need("(")
        distinct = bool(self.got("DISTINCT"))
        arg = None if name == "COUNT" and self.got("*") else self.expression()
        separator = " "
        if name == "GROUP_CONCAT" and self.got(";"):
            self.need("SEPARATOR")
            self.need("=")
            separator = self.string()
        self.need(")")
        return A.Aggregate(name, arg, distinct, separator)

    # queries

    def query(self) -> A.Query:
        while word := self.got("PREFIX", "BASE"):
            if word == "BASE":
                if self.kind != "iri":
                    raise self.fail("an IRI")
                self.base = self.resolve(self.take()[1:-1]).value
            else:
                if self.kind != "pname" or not self.value.endswith(":"):
                    raise self.fail("a prefix")
                name = self.take()[:-1]
                if self.kind != "iri":
                    raise self.fail("an IRI")
                self.prefixes[name] = self.resolve(self.take()[1:-1]).value
        if self.is_("SELECT"):
            q = self.select()
        elif self.got("ASK"):
            q = self.rest(A.Query("ASK"))
        elif self.got("CONSTRUCT"):
            q = self.construct()
        elif self.got("DESCRIBE"):
            q = A.Query("DESCRIBE")
            if not self.got("*"):
                while self.kind in ("var", "iri", "pname"):
                    q.targets.append(self.var() if self.kind == "var" else self.iri())
                if not q.targets:
                    raise self.fail("a resource")
                q = self.rest(q, need_where=False)
            else:
                q = self.rest(q)
                q.targets = [A.Var(v) for v in A.variables(q.where)]
        else:
            raise self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        if self.kind != "end":
            raise self.fail("the end")
        return q

    def select(self, sub: bool = False) -> A.Query:
        self.need("SELECT")
        q = A.Query("SELECT", distinct=self.got("DISTINCT", "REDUCED") == "DISTINCT")
        if not self.got("*"):
            q.items = []
            while True:
                if self.kind == "var":
                    q.items.append((self.var(), None))
                elif self.got("("):
                    e = self.expression()
                    self.need("AS")
                    q.items.append((self.var(), e))
                    self.need(")")
                else:
                    break
            if not q.items:
                raise self.fail("a variable")
        q = self.rest(q, sub=sub)
        known = set(A.variables(q.where))
        for v, e in q.items or []:
            if e is not None and v.name in known:
                raise SparqlSyntaxError(f"?{v.name} is in scope already")
            known.add(v.name)
        if q.items is None and q.group is not None:
            raise SparqlSyntaxError("SELECT * with GROUP BY")
        if q.group is not None or any(e is not None and A.aggregates(e) for _, e in q.items or []):
            keys = {v.name for v, _ in q.group or [] if v} | {e.name for _, e in q.group or [] if isinstance(e, A.Var)}
            for v, e in q.items or []:
                loose = {v.name} if e is None else _outside(e)
                if loose - keys:
                    raise SparqlSyntaxError(f"?{min(loose - keys)} is neither grouped nor aggregated")
                keys |= {v.name}
        return q

    def construct(self) -> A.Query:
        q = A.Query("CONSTRUCT")
        if self.is_("{"):
            self.in_template, self.labels = True, {}
            self.take()
            triples = [] if self.is_("}") else self.triples()
            self.need("}")
            self.in_template, self.labels = False, {}
            q.template = tuple(triples)
            return self.rest(q)
        q = self.rest(q, short=True)
        if not isinstance(q.where, (A.BGP, A.Unit)) or any(isinstance(t.p, A.PATHS) for t in getattr(q.where, "triples", ())):
            raise SparqlSyntaxError("CONSTRUCT WHERE takes plain triples")
        q.template = getattr(q.where, "triples", ())
        return q

    def rest(self, q: A.Query, sub: bool = False, need_where: bool = True, short: bool = False) -> A.Query:
        while not sub and self.got("FROM"):
            (q.from_named if self.got("NAMED") else q.from_default).append(self.iri())
        if self.got("WHERE") or self.is_("{") or need_where:
            q.where = self.group()
        if self.got("GROUP"):
            self.need("BY")
            q.group = []
            while True:
                if self.kind == "var":
                    q.group.append((None, self.var()))
                elif self.got("("):
                    e = self.expression()
                    v = self.var() if self.got("AS") else None
                    self.need(")")
                    q.group.append((v, e))
                elif self.kind in ("iri", "pname") or (self.kind == "word" and self.value.upper() in FUNCTIONS):
                    q.group.append((None, self.primary()))
                else:
                    break
            if not q.group:
                raise self.fail("a grouping")
        if self.got("HAVING"):
            q.having.append(self.constraint())
            while self.is_("(") or (self.kind == "word" and self.value.upper() in FUNCTIONS | dict.fromkeys(_AGGREGATES)):
                q.having.append(self.constraint())
        if self.got("ORDER"):
            self.need("BY")
            while True:
                if way := self.got("ASC", "DESC"):
                    q.order.append((self.bracketed(), way == "DESC"))
                elif self.kind == "var":
                    q.order.append((self.var(), False))
                elif self.is_("(") or self.kind in ("iri", "pname") or (self.kind == "word" and self.value.upper() in FUNCTIONS | dict.fromkeys(_AGGREGATES)):
                    q.order.append((self.constraint(), False))
                else:
                    break
            if not q.order:
                raise self.fail("an order")
        while word := self.got("LIMIT", "OFFSET"):
            if self.kind != "integer":
                raise self.fail("a number")
            setattr(q, word.lower(), int(self.take()))
        if self.got("VALUES"):
            v = self.values()
            q.where = v if isinstance(q.where, A.Unit) else A.Join(q.where, v)
        return q


def _outside(e: object) -> set[str]:
    """Variables of an expression that stand outside aggregates."""
    if isinstance(e, A.Aggregate):
        return set()
    if isinstance(e, A.Call):
        return set().union(*map(_outside, e.args)) if e.args else set()
    return A.used(e)


def parse(text: str, base: str = "") -> A.Query:
    """The query in the text."""
    return Parser(text, base).query()
