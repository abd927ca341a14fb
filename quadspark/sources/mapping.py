"""Relational tables as quads, in the way of the W3C Direct Mapping.

Of table T with key k and column c: graph ``<urn:g:T>``, subject ``<urn:T/k>``, predicate
``<urn:T#c>``, object a literal, or ``<urn:U/v>`` for a reference to table U. Null values give no
quad. Each (table, column) is a branch of a union with a constant predicate and graph, so a pattern
that binds either is planned as a scan of the branches it can match, with their two columns alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions import terms as t


@dataclass(frozen=True)
class Table:
    """``columns``: each with 'string', 'integer', 'double', 'dateTime', '@column' for a literal
    tagged with that column's language, or '/table' for a reference."""

    name: str
    key: str
    columns: dict[str, str]
    default_graph: bool = False

    @property
    def graph(self) -> str:
        return t.DEFAULT_GRAPH if self.default_graph else f"<urn:g:{self.name}>"


#: The mapped tables: region is the default graph.
CATALOG = [
    Table("region", "r_regionkey", {"r_name": "string"}, default_graph=True),
    Table("nation", "n_nationkey", {"n_name": "string", "n_regionkey": "/region"}),
    Table("customer", "c_custkey", {"c_name": "string", "c_nationkey": "/nation", "c_acctbal": "double", "c_mktsegment": "string"}),
    Table("supplier", "s_suppkey", {"s_name": "string", "s_nationkey": "/nation", "s_acctbal": "double"}),
    Table("part", "p_partkey", {"p_name": "string", "p_brand": "string", "p_size": "integer", "p_retailprice": "double"}),
    Table("orders", "o_orderkey", {"o_custkey": "/customer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "dateTime"}),
]
TEXTS = [Table("documents", "doc_id", {"text": "@lang", "source": "string", "n_chars": "integer"})]


def object_of(column: str, how: str) -> Column:
    c = F.col(column)
    if how.startswith("/"):
        return t.iri(F.concat(F.lit(f"urn:{how[1:]}/"), c.cast("string")))
    if how.startswith("@"):
        return t.literal(c, lang=F.col(how[1:]))
    if how == "dateTime":
        return t.literal(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), "dateTime")
    return t.literal(c, None if how == "string" else how)


def branch(rows: DataFrame, table: Table, column: str) -> DataFrame:
    how = table.columns[column]
    own = rows.where(F.col(column).isNotNull() & F.col(table.key).isNotNull())
    return own.select(
        F.lit(table.graph).alias("g"),
        t.iri(F.concat(F.lit(f"urn:{table.name}/"), F.col(table.key).cast("string"))).alias("s"),
        F.lit(f"<urn:{table.name}#{column}>").alias("p"),
        object_of(column, how).alias("o"),
    )


def quads(spark: SparkSession, sf_dir: str, tables: list[Table] | None = None) -> DataFrame:
    """All quads of the tables. Keys are unique, so no quad comes twice."""
    out = []
    for table in CATALOG if tables is None else tables:
        rows = spark.read.parquet(f"{sf_dir}/{table.name}.parquet")
        out += [branch(rows, table, c) for c in table.columns]
    return reduce(DataFrame.unionByName, out)


def _key_of(term: str, table: str) -> str | None:
    """The key in a subject's IRI, None if it is no subject of this table."""
    head = f"<urn:{table}/"
    return term[len(head) : -1] if term.startswith(head) and term.endswith(">") else None


def _equals(rows: DataFrame, column: str, text: str) -> Column:
    """Whether a column reads as this text, as a comparison of the column's own type that a scan can take."""
    kind = rows.schema[column].dataType
    return (F.col(column) == F.lit(text).try_cast(kind)) & (F.col(column).cast("string") == F.lit(text))


def find(spark: SparkSession, sf_dir: str, g: str | None = None, s: str | None = None, p: str | None = None, o: str | None = None, tables: list[Table] | None = None) -> DataFrame:
    """The tables' quads that match a pattern, planned from it: only tables and columns that can match are
    read, each table once, and bound subjects, references and plain texts become comparisons with columns,
    which reach the scan."""
    out = []
    for table in CATALOG if tables is None else tables:
        columns = {c: how for c, how in table.columns.items() if p is None or p == f"<urn:{table.name}#{c}>"}
        if o is not None:
            columns = {c: how for c, how in columns.items() if (_key_of(o, how[1:]) is not None if how.startswith("/") else o.startswith('"'))}
        key = None if s is None else _key_of(s, table.name)
        if not columns or (g is not None and g != table.graph) or (s is not None and key is None):
            continue
        rows = spark.read.parquet(f"{sf_dir}/{table.name}.parquet")
        if key is not None:
            rows = rows.where(_equals(rows, table.key, key))
        if len(columns) == 1:
            ((c, how),) = columns.items()
            if o is not None and how.startswith("/"):
                rows = rows.where(_equals(rows, c, _key_of(o, how[1:])))
            elif o is not None and how == "string" and "\\" not in o:
                rows = rows.where(F.col(c) == F.lit(o[1:-1]))
            found = branch(rows, table, c)
        else:
            subject = t.iri(F.concat(F.lit(f"urn:{table.name}/"), F.col(table.key).cast("string"))).alias("s")
            each = F.array(*[F.struct(F.lit(f"<urn:{table.name}#{c}>").alias("p"), object_of(c, how).alias("o")) for c, how in columns.items()])
            found = rows.where(F.col(table.key).isNotNull()).select(F.lit(table.graph).alias("g"), subject, F.inline(each)).where("o is not null")
        out.append(found.where(F.col("o") == F.lit(o)) if o is not None else found)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "g string, s string, p string, o string")
