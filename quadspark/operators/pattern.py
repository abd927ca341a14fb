"""Quad patterns: a term for each bound position, None for a wildcard.

A pattern is a conjunction of equalities on columns, so Catalyst pushes it into the scan: over
Parquet quads it becomes PushedFilters, over mapped tables it removes the branches that cannot match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.functions.terms import DEFAULT_GRAPH

POSITIONS = ["g", "s", "p", "o"]
#: Names for the default graph that patterns may use.
DEFAULT_ALIASES = {DEFAULT_GRAPH, "", "default"}


def graph_name(g: str | None) -> str | None:
    return DEFAULT_GRAPH if g in DEFAULT_ALIASES else g


def condition(g: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None) -> Column:
    """True of the quads that match."""
    bound = {"g": graph_name(g), "s": s, "p": p, "o": o}
    return reduce(Column.__and__, [F.col(c) == F.lit(t) for c, t in bound.items() if t is not None], F.lit(True))


def find(quads: DataFrame, g: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Quads equal to the pattern in every bound position. A term that is unknown, or known in
    another position only, matches nothing; four wildcards match all."""
    return quads.where(condition(g, s, p, o)).select(*POSITIONS)


def find_default(quads: DataFrame, s=None, p=None, o=None) -> DataFrame:
    return find(quads, DEFAULT_GRAPH, s, p, o)


def find_named(quads: DataFrame, g: str, s=None, p=None, o=None) -> DataFrame:
    """In one named graph."""
    return find(quads, g, s, p, o)


def find_any_named(quads: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """In every graph but the default."""
    return find(quads.where(F.col("g") != DEFAULT_GRAPH), None, s, p, o)


def union_graph(quads: DataFrame) -> DataFrame:
    """The triples of all named graphs, each once."""
    return quads.where(F.col("g") != DEFAULT_GRAPH).select("s", "p", "o").distinct()


def contains(quads: DataFrame, g=None, s=None, p=None, o=None) -> bool:
    """Whether any quad matches; stops at the first."""
    return not find(quads, g, s, p, o).limit(1).isEmpty()


def list_nodes(quads: DataFrame, position: str) -> DataFrame:
    """Distinct terms of a position."""
    return quads.select(position).distinct()


def list_graphs(quads: DataFrame) -> DataFrame:
    """Names of the graphs, without the default."""
    return quads.where(F.col("g") != DEFAULT_GRAPH).select("g").distinct()


def as_triples(quads: DataFrame) -> DataFrame:
    return quads.select("s", "p", "o")
