"""Relational tables as RDF, without writing a quad: a direct mapping of parquet columns to predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.values import Template

EX = "http://ex/"


@dataclass(frozen=True)
class Column:
    """A column as a predicate's object. kind: a static kind, 'iri', 'fk' or 'lang' (with the language's column)."""

    name: str
    kind: str
    target: str = ""  # of 'fk': the table; of 'lang': the language's column


@dataclass(frozen=True)
class Mapped:
    """A table whose rows are subjects: `key` is unique in it, so a subject has one value of each predicate."""

    name: str
    key: tuple[Column, ...]
    columns: tuple[Column, ...]
    hashed: bool = False

    @property
    def template(self) -> Template:
        return Template(f"{EX}{self.name}/", tuple(c.kind for c in self.key), self.hashed)

    @property
    def rdf_class(self) -> str:
        return EX + self.name.capitalize()

    @property
    def graph(self) -> str:
        return f"{EX}graph/{self.name}"

    def predicate(self, c: Column) -> str:
        return f"{EX}{self.name}#{c.name}"


def _table(name: str, key: str, columns: str, hashed: bool = False) -> Mapped:
    """columns: name:kind or name:kind:target, in one string."""
    cols = tuple(Column(*x.split(":")) for x in columns.split())
    raw = {c.name: Column(c.name, "int" if c.kind == "fk" else c.kind) for c in cols}
    return Mapped(name, tuple(raw[k] for k in key.split()), cols, hashed)


_LINE = "l_orderkey:fk:orders l_partkey:fk:part l_suppkey:fk:supplier l_linenumber:int l_quantity:dbl l_extendedprice:dbl l_discount:dbl l_tax:dbl l_returnflag:str l_linestatus:str l_shipdate:dt"
TABLES = {
    t.name: t
    for t in (
        _table("region", "r_regionkey", "r_regionkey:int r_name:str"),
        _table("nation", "n_nationkey", "n_nationkey:int n_name:str n_regionkey:fk:region"),
        _table("customer", "c_custkey", "c_custkey:int c_name:str c_nationkey:fk:nation c_acctbal:dbl c_mktsegment:str"),
        _table("supplier", "s_suppkey", "s_suppkey:int s_name:str s_nationkey:fk:nation s_acctbal:dbl"),
        _table("part", "p_partkey", "p_partkey:int p_name:str p_brand:str p_type:str p_size:int p_retailprice:dbl"),
        _table("orders", "o_orderkey", "o_orderkey:int o_custkey:fk:customer o_orderstatus:str o_totalprice:dbl o_orderdate:dt o_orderpriority:str"),
        # only the whole row is unique
        _table("lineitem", " ".join(x.split(":")[0] for x in _LINE.split()), _LINE, hashed=True),
        _table("events", "event_id", "event_id:int ts:dt user_id:int event_type:str value:dbl props:str"),
        _table("documents", "doc_id", "doc_id:int text:lang:lang lang:str source:str n_chars:int"),
        _table("pages", "page_id", "page_id:int url:iri html:str"),
        _table("benchmark", "item_id", "item_id:int text:str"),
        _table("labels", "doc_id", "doc_id:fk:documents quality:int toxic:bool"),
        _table("conversations", "conv_id turn", "conv_id:int turn:int role:str text:str"),
    )
}


@dataclass
class Mapping:
    """Tables by name, and where each predicate, class and graph is found."""

    tables: dict[str, Mapped] = field(default_factory=lambda: dict(TABLES))

    def __post_init__(self) -> None:
        self.predicates = {t.predicate(c): (t, c) for t in self.tables.values() for c in t.columns}
        self.classes = {t.rdf_class: t for t in self.tables.values()}
        self.graphs = {t.graph: t for t in self.tables.values()}

    def subject_table(self, iri: str) -> Mapped | None:
        return next((t for t in self.tables.values() if iri.startswith(t.template.prefix)), None)
