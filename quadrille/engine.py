"""The engine: SPARQL text in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms as R
from .functions import values as V
from .operators.relation import Relation
from .plans import algebra as A
from .plans.compiler import Compiler
from .plans.parser import parse
from .sources.graphs import MappedGraph, QuadGraph


@dataclass
class SparqlResult:
    """A query's result. kind is SELECT, ASK, CONSTRUCT or DESCRIBE; variables are in order (s, p, o of a graph)."""

    kind: str
    variables: list[str]
    relation: Relation

    def native(self) -> DataFrame:
        """Plain columns: numbers, booleans, timestamps and strings where the plan knows the type, IRIs and forms as strings."""
        if self.kind == "ASK":
            return self._ask()
        return self.relation.df.select(*[V.native(self.relation.value(v)).alias(v) for v in self.variables])

    def terms(self) -> DataFrame:
        """One term struct for each variable."""
        return self.relation.df.select(*[V.to_term(self.relation.value(v)).alias(v) for v in self.variables])

    def triples(self) -> DataFrame:
        """A graph's triples in canonical N-Triples form, a column for each part."""
        df = self.terms()
        return df.select(*[R.n3_column(F.col(n)).alias(n) for n in "spo"])

    def _ask(self) -> DataFrame:
        return self.relation.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def boolean(self) -> bool:
        """The answer of ASK."""
        return self._ask().first()[0]

    def bindings(self) -> list[dict[str, object]]:
        """Solutions as Python terms, without unbound variables. For small results: all of it comes to the driver."""
        return [{v: R.from_struct(tuple(t)) for v, t in zip(self.variables, row) if t is not None} for row in self.terms().collect()]

    def serialize(self, media: str = "application/sparql-results+json") -> str:
        """The whole result as text in a format of results.write; for small results."""
        from .results.write import serialize

        return serialize(self, media)

    def write(self, path: str, form: str) -> None:
        """Write a result of any size, from the executors: 'csv', 'tsv', 'ntriples' or 'parquet' of terms."""
        from .results.write import write

        write(self, path, form)


class Engine:
    """SPARQL over a table of quads, or over relational tables under a mapping."""

    def __init__(self, spark: SparkSession, graph: MappedGraph | QuadGraph):
        self.spark, self.graph = spark, graph

    @classmethod
    def over_tables(cls, spark: SparkSession, folder: str, mapping=None) -> Engine:  # noqa: ANN001
        return cls(spark, MappedGraph(spark, folder, mapping))

    @classmethod
    def over_quads(cls, quads: DataFrame) -> Engine:
        return cls(quads.sparkSession, QuadGraph(quads))

    @classmethod
    def over_files(cls, spark: SparkSession, path: str, form: str | None = None, base: str = "") -> Engine:
        from .sources.files import read_rdf

        return cls.over_quads(read_rdf(spark, path, form, base))

    def sparql(self, text: str, base: str = "") -> SparqlResult:
        q = parse(text, base)
        source = self.graph.dataset(q.from_default, q.from_named)
        c = Compiler(self.spark, source)
        if q.form == "SELECT":
            return SparqlResult("SELECT", A.projected(q), c.select(q))
        if q.form == "ASK":
            return SparqlResult("ASK", [], c.modified(q))
        return SparqlResult(q.form, list("spo"), c.construct(q) if q.form == "CONSTRUCT" else c.describe(q))

    def query(self, text: str) -> DataFrame:
        """Shorthand for sparql(text).native()."""
        return self.sparql(text).native()

    def explain(self, text: str, mode: str = "formatted") -> str:
        df = self.sparql(text).native()
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
