"""Quadrille: RDF quads and SPARQL 1.1 as Spark DataFrame plans."""

from .engine import Engine, SparqlResult
from .store import QuadStore
from .terms import BNode, IRI, Literal, Quad, TripleTerm

__all__ = ["BNode", "Engine", "IRI", "Literal", "Quad", "QuadStore", "SparqlResult", "TripleTerm"]
