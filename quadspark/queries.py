"""The registered queries of the quad engine, each with the same rows in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.dataset import Dataset
from quadspark.functions import terms as t
from quadspark.operators import bitmap as bm
from quadspark.operators import dictionary as dc
from quadspark.operators import index as ix
from quadspark.operators import pattern as pt
from quadspark.operators import store as st
from quadspark.plans import bgp
from quadspark.plans.lineage import shared_dir
from quadspark.sources import mapping as mp
from quadspark.sources import nquads as nq

Query = Callable[[SparkSession, str], DataFrame]

NATION_NAME, NATION_REGION = "<urn:nation#n_name>", "<urn:nation#n_regionkey>"
SEGMENT, CUSTOMER_NATION = "<urn:customer#c_mktsegment>", "<urn:customer#c_nationkey>"
STATUS, BUYER, SIZE = "<urn:orders#o_orderstatus>", "<urn:orders#o_custkey>", "<urn:part#p_size>"
#: One quad's terms, for the sixteen shapes of a pattern.
SHAPE = {"g": "<urn:g:customer>", "s": "<urn:customer/3>", "p": CUSTOMER_NATION, "o": None}

Spec = tuple[Query, str]
SPECS: dict[str, Spec] = {}


# -- the tables as quads, in SQL ----------------------------------------------------------------
def _sql_escape(c: str) -> str:
    return f"replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"


def _sql_object(column: str, how: str) -> str:
    if how.startswith("/"):
        return f"'<urn:{how[1:]}/' || {column} || '>'"
    if how == "dateTime":
        return f"'\"' || strftime({column}, '%Y-%m-%dT%H:%M:%S') || '\"^^<{t.XSD}dateTime>'"
    quoted = f"'\"' || {_sql_escape(f'CAST({column} AS VARCHAR)')} || '\"'"
    if how.startswith("@"):
        return f"{quoted} || CASE WHEN coalesce({how[1:]}, '') = '' THEN '' ELSE '@' || {how[1:]} END"
    return quoted if how == "string" else f"{quoted} || '^^<{t.XSD}{how}>'"


def _sql_quads(tables: list[mp.Table]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{x.graph}' AS g, '<urn:{x.name}/' || {x.key} || '>' AS s, '<urn:{x.name}#{c}>' AS p, {_sql_object(c, how)} AS o FROM {x.name} WHERE {c} IS NOT NULL AND {x.key} IS NOT NULL"
        for x in tables
        for c, how in x.columns.items()
    )


Q = f"Q AS MATERIALIZED (\n  {_sql_quads(mp.CATALOG)}\n)"
QT = f"Q AS (\n  {_sql_quads(mp.TEXTS)}\n)"
TERMS = "T AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT unnest([g, s, p, o]) AS term FROM Q))"
ENC = """E AS MATERIALIZED (SELECT tg.term_id AS g_id, ts.term_id AS s_id, tp.term_id AS p_id, tt.term_id AS o_id FROM Q JOIN T tg ON tg.term = g JOIN T ts ON ts.term = s JOIN T tp ON tp.term = p JOIN T tt ON tt.term = o),
I AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY g_id, s_id, p_id, o_id) - 1 AS quad_id FROM E)"""


def _mask(c: str) -> str:
    return f"CASE WHEN {c} % 64 = 63 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << ({c} % 64)::INT END"


def _decimal_key(lex: str) -> str:
    """The key of a lexical form, in SQL."""
    pat = r"'^([+-]?)(\d+\.?\d*|\.\d+)(?:[eE]([+-]?\d+))?$'"
    mant = f"regexp_extract({lex}, {pat}, 2)"
    frac = f"split_part({mant}, '.', 2)"
    digits = f"regexp_replace(split_part({mant}, '.', 1) || {frac}, '^0+', '')"
    core = f"regexp_replace({digits}, '0+$', '')"
    power = f"coalesce(TRY_CAST(regexp_extract({lex}, {pat}, 3) AS BIGINT), 0)"
    return f"""CASE WHEN regexp_matches({lex}, {pat}) THEN CASE WHEN {core} = '' THEN '0' ELSE
      CASE WHEN regexp_extract({lex}, {pat}, 1) = '-' THEN '-' ELSE '' END || {core} || 'E' || CAST({power} - length({frac}) + length({digits}) - length({core}) AS VARCHAR) END END"""


def quads(spark: SparkSession, d: str) -> DataFrame:
    return mp.quads(spark, d)


def texts(spark: SparkSession, d: str) -> DataFrame:
    return mp.quads(spark, d, mp.TEXTS)


def coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary of the tables' quads, and those encoded with ids; both are stored."""
    q = quads(spark, d)
    dictionary = dc.build(q)
    return dictionary, dc.with_quad_ids(dc.encode(q, dictionary))


def add(name: str, sql: str):
    def keep(f: Query) -> Query:
        SPECS[name] = (f, sql)
        return f

    return keep


# -- patterns -----------------------------------------------------------------------------------
def _shape(bound: tuple[str, ...]) -> Spec:
    terms = {c: ("<urn:nation/3>" if c == "o" else SHAPE[c]) for c in bound}
    if set(bound) >= {"s", "o"}:  # the object that this subject has
        terms["s"], terms["o"] = "<urn:nation/3>", "<urn:region/1>"
        terms |= {"g": "<urn:g:nation>"} if "g" in bound else {}
        terms |= {"p": NATION_REGION} if "p" in bound else {}
    where = " AND ".join(f"{c} = '{x}'" for c, x in terms.items()) or "true"
    return (lambda s, d: mp.find(s, d, **terms)), f"WITH {Q} SELECT g, s, p, o FROM Q WHERE {where}"


for _bound in product([False, True], repeat=4):
    _positions = tuple(c for c, x in zip(pt.POSITIONS, _bound) if x)
    SPECS[f"find_{''.join(_positions) or 'all'}"] = _shape(_positions)


@add("find_unknown_term", f"WITH {Q} SELECT count(*) AS n FROM Q WHERE s = '<urn:nowhere>' AND p = '{NATION_NAME}'")
def find_unknown_term(s, d):
    return st.size(pt.find(quads(s, d), s="<urn:nowhere>", p=NATION_NAME))


@add("find_wrong_position", f"WITH {Q} SELECT count(*) AS n FROM Q WHERE s = '{NATION_NAME}' AND g = '<urn:g:nation>'")
def find_wrong_position(s, d):
    return st.size(pt.find(quads(s, d), g="<urn:g:nation>", s=NATION_NAME))


@add("find_default", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE g = '{t.DEFAULT_GRAPH}'")
def find_default(s, d):
    return pt.find_default(quads(s, d))


@add("find_named", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE g = '<urn:g:customer>' AND p = '{SEGMENT}'")
def find_named(s, d):
    return pt.find_named(quads(s, d), "<urn:g:customer>", p=SEGMENT)


@add("find_any_named", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE g <> '{t.DEFAULT_GRAPH}' AND o = '<urn:nation/7>'")
def find_any_named(s, d):
    return pt.find_any_named(quads(s, d), o="<urn:nation/7>")


@add("union_graph", f"WITH {Q} SELECT DISTINCT s, p, o FROM Q WHERE g <> '{t.DEFAULT_GRAPH}'")
def union_graph(s, d):
    return pt.union_graph(quads(s, d))


@add("graph_find_sp", f"WITH {Q} SELECT s, p, o FROM Q WHERE g = '<urn:g:customer>' AND s = '<urn:customer/5>' AND p = '{SEGMENT}'")
def graph_find_sp(s, d):
    return pt.as_triples(pt.find(quads(s, d), "<urn:g:customer>", "<urn:customer/5>", SEGMENT))


@add("contains_pattern", f"WITH {Q} SELECT name, (SELECT count(*) > 0 FROM Q WHERE p = pred) AS found FROM (VALUES ('known', '{STATUS}'), ('unknown', '<urn:none>')) v(name, pred)")
def contains_pattern(s, d):
    q = quads(s, d)
    return s.createDataFrame([("known", pt.contains(q, p=STATUS)), ("unknown", pt.contains(q, p="<urn:none>"))], "name string, found boolean")


for _c, _name in (("s", "subjects"), ("p", "predicates"), ("o", "objects")):
    SPECS[f"list_{_name}"] = (lambda s, d, c=_c: pt.list_nodes(quads(s, d), c), f"WITH {Q} SELECT DISTINCT {_c} FROM Q")


@add("list_graphs", f"WITH {Q} SELECT DISTINCT g FROM Q WHERE g <> '{t.DEFAULT_GRAPH}'")
def list_graphs(s, d):
    return pt.list_graphs(quads(s, d))


@add("dataset_size", f"WITH {Q} SELECT count(*) AS n FROM Q")
def dataset_size(s, d):
    return st.size(quads(s, d))


@add("graph_size", f"WITH {Q} SELECT g, least(count(*), 2147483647)::BIGINT AS n FROM Q GROUP BY g")
def graph_size(s, d):
    return st.graph_sizes(quads(s, d))


# -- changes ------------------------------------------------------------------------------------
#: Lines without a unique key: their quads repeat, and registering makes them a set.
LINES = [mp.Table("lineitem", "l_orderkey", {"l_returnflag": "string", "l_linenumber": "integer", "l_shipdate": "dateTime"})]


@add("register_dedup", f"WITH {Q}, N AS ({_sql_quads(LINES)}) SELECT g, s, p, o FROM Q UNION SELECT g, s, p, o FROM N")
def register_dedup(s, d):
    return st.register(quads(s, d), mp.quads(s, d, LINES))


@add("register_delta", f"WITH {Q}, N AS ({_sql_quads(LINES)} UNION ALL SELECT * FROM Q WHERE p = '{STATUS}') SELECT g, s, p, o FROM N EXCEPT SELECT g, s, p, o FROM Q")
def register_delta(s, d):
    q = quads(s, d)
    return st.additions(q, mp.quads(s, d, LINES).unionByName(pt.find(q, p=STATUS)))


@add("graph_add", f"WITH {Q} SELECT s, p, o FROM Q WHERE g = '<urn:g:nation>' UNION SELECT s, p, o FROM Q WHERE g = '<urn:g:supplier>'")
def graph_add(s, d):
    q = quads(s, d)
    into = pt.find(q, "<urn:g:supplier>").withColumn("g", F.lit("<urn:g:nation>"))
    return pt.as_triples(pt.find(st.register(q, into), "<urn:g:nation>"))


@add("delete_quads", f"WITH {Q} SELECT g, s, p, o FROM Q EXCEPT SELECT g, s, p, o FROM Q WHERE p = '{STATUS}' AND o = '\"F\"'")
def delete_quads(s, d):
    q = quads(s, d)
    return st.delete(q, pt.find(q, p=STATUS, o='"F"'))


@add("graph_delete", f"WITH {Q} SELECT s, p, o FROM Q WHERE g = '<urn:g:customer>' AND NOT (p = '{SEGMENT}')")
def graph_delete(s, d):
    q = quads(s, d)
    return pt.as_triples(pt.find(st.delete(q, pt.find(q, "<urn:g:customer>", p=SEGMENT)), "<urn:g:customer>"))


@add("remove_pattern", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE NOT (p = '{BUYER}')")
def remove_pattern(s, d):
    return st.remove_pattern(quads(s, d), p=BUYER)


@add("clear_graph", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE g <> '<urn:g:orders>'")
def clear_graph(s, d):
    return st.clear_graph(quads(s, d), "<urn:g:orders>")


@add(
    "txn_overlay_read",
    f"""WITH {Q}, D AS (SELECT * FROM Q WHERE p = '{SEGMENT}'), A AS (SELECT g, s, p, '"' || s || '"' AS o FROM D UNION ALL SELECT * FROM Q WHERE p = '{SEGMENT}' AND o = '"BUILDING"')
    (SELECT g, s, p, o FROM Q EXCEPT SELECT g, s, p, o FROM D) UNION SELECT g, s, p, o FROM A""",
)
def txn_overlay_read(s, d):
    q = quads(s, d)
    gone = pt.find(q, p=SEGMENT)
    adds = gone.withColumn("o", F.concat(F.lit('"'), "s", F.lit('"'))).unionByName(pt.find(q, p=SEGMENT, o='"BUILDING"'))
    return st.overlay(q, adds, gone)


@add(
    "longlist_upsert",
    """SELECT c_custkey AS id, c_name AS payload FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, CAST(count(*) AS VARCHAR) FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""",
)
def longlist_upsert(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("payload"))
    new = s.read.parquet(f"{d}/orders.parquet").where("o_custkey is not null").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("string").alias("payload"))
    return st.upsert(rows, new)


@add("longlist_remove", "SELECT count(*) AS live, max(c_custkey) + 1 AS next FROM customer WHERE c_nationkey <> 3")
def longlist_remove(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    rows = c.select(F.col("c_custkey").alias("id"))
    return st.list_sizes(st.remove(rows, c.where("c_nationkey = 3 or c_nationkey is null").select(F.col("c_custkey").alias("id"))))


@add(
    "longlist_append",
    "SELECT c_custkey AS id, c_name AS payload FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name FROM supplier",
)
def longlist_append(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("payload"))
    return st.append(rows, s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("payload")), ["payload"])


# -- dictionary ---------------------------------------------------------------------------------
@add("term_dictionary", f"WITH {Q}, {TERMS} SELECT term, term_id FROM T")
def term_dictionary(s, d):
    return dc.build(quads(s, d))


@add("term_lookup", f"WITH {Q}, {TERMS}, A AS (SELECT '<urn:nation/' || n_nationkey || '>' AS term FROM nation UNION ALL SELECT '<urn:x/' || r_regionkey || '>' FROM region) SELECT A.term, coalesce(T.term_id, -1) AS term_id FROM A LEFT JOIN T ON A.term = T.term")
def term_lookup(s, d):
    known = s.read.parquet(f"{d}/nation.parquet").select(t.iri(F.concat(F.lit("urn:nation/"), F.col("n_nationkey").cast("string"))).alias("term"))
    not_known = s.read.parquet(f"{d}/region.parquet").select(t.iri(F.concat(F.lit("urn:x/"), F.col("r_regionkey").cast("string"))).alias("term"))
    return dc.lookup(dc.build(quads(s, d)), known.unionByName(not_known))


@add(
    "term_canonical",
    f"""WITH {Q}, T AS (SELECT DISTINCT unnest([s, p, o]) AS term FROM Q)
    SELECT CASE WHEN term LIKE '<%' THEN 'iri' ELSE 'literal' END AS kind,
           CASE WHEN term LIKE '"%' THEN regexp_extract(term, '\\^\\^<([^>]*)>$', 1) ELSE '' END AS datatype, count(*) AS n, min(term) AS first_term FROM T GROUP BY 1, 2""",
)
def term_canonical(s, d):
    every = quads(s, d).select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
    return every.groupBy(t.kind(F.col("term")).alias("kind"), t.datatype(F.col("term")).alias("datatype")).agg(F.count("*").alias("n"), F.min("term").alias("first_term"))


_REGISTER = f"""WITH {Q}, {TERMS}, V AS (SELECT DISTINCT '<urn:nation/' || n_nationkey || '>' AS term FROM nation UNION SELECT '<urn:new/' || p_partkey || '>' FROM part),
  N AS (SELECT term, row_number() OVER (ORDER BY term) - 1 + (SELECT max(term_id) + 1 FROM T) AS term_id FROM V WHERE term NOT IN (SELECT term FROM T))
"""


def _values(s, d):
    a = s.read.parquet(f"{d}/nation.parquet").select(t.iri(F.concat(F.lit("urn:nation/"), F.col("n_nationkey").cast("string"))).alias("term"))
    return a.unionByName(s.read.parquet(f"{d}/part.parquet").select(t.iri(F.concat(F.lit("urn:new/"), F.col("p_partkey").cast("string"))).alias("term")))


@add("store_register_result", _REGISTER + "SELECT V.term, T.term IS NOT NULL AS existed, coalesce(T.term_id, N.term_id) AS term_id, T.term IS NULL AS was_added FROM V LEFT JOIN T ON V.term = T.term LEFT JOIN N ON V.term = N.term")
def store_register_result(s, d):
    return dc.register_result(dc.build(quads(s, d)), _values(s, d))


@add("store_delete_result", _REGISTER + "SELECT V.term, T.term IS NOT NULL AS existed, coalesce(T.term_id, -1) AS term_id FROM V LEFT JOIN T ON V.term = T.term")
def store_delete_result(s, d):
    return dc.delete_result(dc.build(quads(s, d)), _values(s, d))


@add("store_contains", _REGISTER + "SELECT V.term FROM V WHERE term IN (SELECT term FROM T)")
def store_contains(s, d):
    return dc.contains(dc.build(quads(s, d)), _values(s, d))


@add("encode_quads", f"WITH {Q}, {TERMS}, {ENC} SELECT g_id, s_id, p_id, o_id FROM E")
def encode_quads(s, d):
    q = quads(s, d)
    return dc.encode(q, dc.build(q))


@add("decode_quads", f"WITH {Q}, {TERMS}, {ENC} SELECT quad_id, tg.term AS g, ts.term AS s, tp.term AS p, tt.term AS o FROM I JOIN T tg ON tg.term_id = g_id JOIN T ts ON ts.term_id = s_id JOIN T tp ON tp.term_id = p_id JOIN T tt ON tt.term_id = o_id")
def decode_quads(s, d):
    dictionary, e = coded(s, d)
    return dc.decode(e, dictionary)


@add("decode_triples", f"WITH {Q} SELECT s, p, o FROM Q")
def decode_triples(s, d):
    dictionary, e = coded(s, d)
    return dc.decode(e.drop("quad_id"), dictionary, ["s", "p", "o"])


@add("quad_by_id", f"WITH {Q}, {TERMS}, {ENC} SELECT quad_id, g_id, s_id, p_id, o_id FROM I WHERE quad_id IN (SELECT n_nationkey * 7 FROM nation UNION SELECT 100000000)")
def quad_by_id(s, d):
    _, e = coded(s, d)
    ids = s.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") * 7).cast("bigint").alias("quad_id")).unionByName(s.range(1).select(F.lit(100000000).cast("bigint").alias("quad_id")))
    return dc.quads_by_id(e, ids).select("quad_id", *dc.ENCODED)


@add("quads_ordered", f"WITH {Q} SELECT g, s, p, o, row_number() OVER (ORDER BY g, s, p, o) - 1 AS id FROM Q")
def quads_ordered(s, d):
    from quadspark.plans.numbering import numbered

    return numbered(quads(s, d), pt.POSITIONS)


# -- bitmaps ------------------------------------------------------------------------------------
_IDS = "B AS (SELECT o_orderpriority AS name, o_orderkey AS id FROM orders WHERE o_orderpriority IS NOT NULL UNION ALL SELECT 'status ' || o_orderstatus, o_orderkey FROM orders)"
_PAGED = f"{_IDS}, P AS (SELECT name, id // 64 AS page, bit_or({_mask('id')}) AS bits FROM B GROUP BY 1, 2)"


def _ids(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    a = o.where("o_orderpriority is not null").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("id"))
    return a.unionByName(o.select(F.concat(F.lit("status "), "o_orderstatus").alias("name"), F.col("o_orderkey").alias("id")))


def _maps(s, d, *names):
    m = bm.build(_ids(s, d))
    return m.where(F.col("name").isin(*names)) if names else m


@add("bitmap_build", f"WITH {_PAGED} SELECT name, page, bits FROM P")
def bitmap_build(s, d):
    return _maps(s, d)


@add("bitmap_and", f"WITH {_PAGED} SELECT page, bit_and(bits) AS bits FROM P WHERE name IN ('1-URGENT', 'status F') GROUP BY page HAVING count(*) = 2 AND bit_and(bits) <> 0")
def bitmap_and(s, d):
    return bm.intersection(_maps(s, d, "1-URGENT", "status F"), 2)


@add("bitmap_or", f"WITH {_PAGED} SELECT page, bit_or(bits) AS bits FROM P WHERE name IN ('1-URGENT', '2-HIGH', 'status F') GROUP BY page")
def bitmap_or(s, d):
    return bm.union(_maps(s, d, "1-URGENT", "2-HIGH", "status F"))


@add("bitmap_xor", f"WITH {_PAGED} SELECT page, bit_xor(bits) AS bits FROM P WHERE name IN ('1-URGENT', 'status F') GROUP BY page HAVING bit_xor(bits) <> 0")
def bitmap_xor(s, d):
    return bm.xor(_maps(s, d, "1-URGENT", "status F"))


@add("bitmap_clear", f"WITH {_IDS} SELECT name, id // 64 AS page, bit_or({_mask('id')}) AS bits FROM B WHERE id % 3 <> 0 GROUP BY 1, 2")
def bitmap_clear(s, d):
    return bm.clear(_maps(s, d), _ids(s, d).where("id % 3 = 0"))


@add("bitmap_contains", f"WITH {_IDS}, A AS (SELECT DISTINCT name, c_custkey AS id FROM B, customer WHERE name IN ('1-URGENT', 'status F')) SELECT A.name, A.id, B.id IS NOT NULL AS held FROM A LEFT JOIN B ON A.name = B.name AND A.id = B.id")
def bitmap_contains(s, d):
    keys = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("status F"))).alias("name"))
    return bm.contains(_maps(s, d, "1-URGENT", "status F"), keys)


@add("bitmap_lowest", f"WITH {_IDS} SELECT name, min(id) AS lowest FROM B GROUP BY 1 UNION ALL SELECT 'nothing', -1")
def bitmap_lowest(s, d):
    m = _maps(s, d)
    return bm.lowest(m, m.select("name").unionByName(s.range(1).select(F.lit("nothing").alias("name"))))


@add("bitmap_iterate", f"WITH {_IDS} SELECT DISTINCT name, id FROM B")
def bitmap_iterate(s, d):
    return bm.iterate(_maps(s, d))


@add("bitmap_pages", f"WITH {_IDS} SELECT name, count(DISTINCT id // 64) AS n_pages, min(id // 64) AS first_page, max(id // 64) AS last_page, count(DISTINCT id) AS n_ids FROM B GROUP BY 1")
def bitmap_pages(s, d):
    return bm.pages(_maps(s, d))


@add("bitmap_higher_page", f"WITH {_IDS} SELECT name, min(id // 64) AS page FROM B WHERE id // 64 > 10 GROUP BY 1")
def bitmap_higher_page(s, d):
    return bm.higher_page(_maps(s, d), 10)


@add(
    "postings",
    f"WITH {Q}, {TERMS}, {ENC}, L AS (SELECT 'g' AS pos, g_id AS term_id, quad_id FROM I UNION ALL SELECT 's', s_id, quad_id FROM I UNION ALL SELECT 'p', p_id, quad_id FROM I UNION ALL SELECT 'o', o_id, quad_id FROM I) "
    f"SELECT pos, term_id, quad_id // 64 AS page, bit_or({_mask('quad_id')}) AS bits FROM L GROUP BY 1, 2, 3",
)
def postings(s, d):
    return bm.posting_lists(coded(s, d)[1])


@add("find_via_bitmap", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE g = '<urn:g:customer>' AND p = '{CUSTOMER_NATION}' AND o = '<urn:nation/7>'")
def find_via_bitmap(s, d):
    dictionary, e = coded(s, d)
    terms = {"g": "<urn:g:customer>", "p": CUSTOMER_NATION, "o": "<urn:nation/7>"}
    known = {r["term"]: r["term_id"] for r in dictionary.where(F.col("term").isin(list(terms.values()))).collect()}
    hits = bm.find(e, bm.posting_lists(e), {c: known.get(x, -1) for c, x in terms.items()})
    return dc.decode(hits.drop("quad_id"), dictionary)


# -- indexes ------------------------------------------------------------------------------------
@add("lang_index", f"WITH {QT}, T AS (SELECT DISTINCT o FROM Q) SELECT regexp_extract(o, '(?s)^\".*\"@([A-Za-z0-9-]+)$', 1) AS item, count(*) AS n FROM T WHERE regexp_matches(o, '(?s)^\".*\"@([A-Za-z0-9-]+)$') GROUP BY 1")
def lang_index(s, d):
    return ix.by_lang(dc.build(texts(s, d))).groupBy("item").agg(F.count("*").alias("n"))


@add("lang_index_get", f"WITH {QT} SELECT s, md5(o) AS text_md5 FROM Q WHERE o LIKE '%\"@fr'")
def lang_index_get(s, d):
    return ix.find_by_lang(texts(s, d), "fr").select("s", F.md5("o").alias("text_md5"))


_NUMBERS = f"K AS (SELECT DISTINCT o, {_decimal_key('''regexp_extract(o, '^\"([^\"]*)\"', 1)''')} AS item FROM Q WHERE regexp_matches(o, '^\"[^\"]*\"(\\^\\^<{t.XSD}(integer|double)>)?$'))"


@add("number_index", f"WITH {Q}, {_NUMBERS} SELECT item, count(*) AS n FROM K WHERE item IS NOT NULL GROUP BY 1")
def number_index(s, d):
    return ix.by_number(dc.build(quads(s, d))).groupBy("item").agg(F.count("*").alias("n"))


@add("number_index_get", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE p = '{SIZE}' AND o = '\"10\"^^<{t.XSD}integer>'")
def number_index_get(s, d):
    return pt.find(ix.find_by_number(quads(s, d), "1e1"), p=SIZE)


@add(
    "number_parse",
    f"""WITH L AS (SELECT CAST(l_quantity AS VARCHAR) AS lex FROM lineitem UNION SELECT CAST(l_extendedprice AS VARCHAR) FROM lineitem UNION SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem
      UNION SELECT l_linenumber || 'e' || (l_linenumber - 3) FROM lineitem UNION SELECT '-0' || l_discount FROM lineitem UNION SELECT l_returnflag FROM lineitem)
    SELECT lex, {_decimal_key('lex')} AS num_key FROM L""",
)
def number_parse(s, d):
    c = s.read.parquet(f"{d}/lineitem.parquet")
    n = F.col("l_linenumber")
    forms = [F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), n.cast("string"), F.concat(n.cast("string"), F.lit("e"), (n - 3).cast("string")), F.concat(F.lit("-0"), F.col("l_discount").cast("string")), F.col("l_returnflag")]
    lex = c.select(F.explode(F.array(*forms)).alias("lex")).distinct()
    return lex.select("lex", t.decimal_key(F.col("lex")).alias("num_key"))


@add("index_size", f"WITH {QT} SELECT count(DISTINCT lang) AS n FROM documents WHERE lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
def index_size(s, d):
    return ix.size(ix.by_lang(dc.build(texts(s, d))))


@add("index_delete", "SELECT o_orderstatus AS item, o_orderkey AS id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0) AND o_orderstatus IS NOT NULL")
def index_delete(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").where("o_orderstatus is not null")
    rows = lambda x: x.select(F.col("o_orderstatus").alias("item"), F.col("o_orderkey").alias("id"))
    return ix.delete(rows(o), rows(o.where("o_orderstatus = 'F' and o_custkey % 2 = 0")))


@add("index_register", "SELECT DISTINCT o_orderstatus AS item, o_orderkey AS id FROM orders WHERE o_orderstatus IS NOT NULL UNION SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL")
def index_register(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    a = o.where("o_orderstatus is not null").select(F.col("o_orderstatus").alias("item"), F.col("o_orderkey").alias("id"))
    return ix.register(a, a.unionByName(o.where("o_orderpriority is not null").select(F.col("o_orderpriority").alias("item"), F.col("o_orderkey").alias("id"))))


@add("page_size", "SELECT p_partkey AS n, ceil(sqrt(p_partkey))::BIGINT AS page_size FROM part")
def page_size(s, d):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"), dc.page_sizes(F.col("p_partkey")).alias("page_size"))


# -- text, and the algebra over patterns --------------------------------------------------------
@add("nquads_lines", f"WITH {Q} SELECT s || ' ' || p || ' ' || o || CASE WHEN g = '{t.DEFAULT_GRAPH}' THEN ' .' ELSE ' ' || g || ' .' END AS value FROM Q")
def nquads_lines(s, d):
    return nq.lines(quads(s, d))


@add("nquads_round_trip", f"WITH {QT} SELECT g, s, p, md5(o) AS o_md5 FROM Q")
def nquads_round_trip(s, d):
    return nq.parsed(nq.lines(texts(s, d))).select("g", "s", "p", F.md5("o").alias("o_md5"))


@add("bgp_join", f"WITH {Q} SELECT a.o AS segment, r.o AS region, count(*) AS n FROM Q a JOIN Q b ON a.s = b.s AND b.p = '{CUSTOMER_NATION}' JOIN Q c ON c.s = b.o AND c.p = '{NATION_REGION}' JOIN Q r ON r.s = c.o AND r.p = '<urn:region#r_name>' WHERE a.p = '{SEGMENT}' GROUP BY 1, 2")
def bgp_join(s, d):
    found = bgp.bgp(quads(s, d), [(None, "?c", SEGMENT, "?segment"), (None, "?c", CUSTOMER_NATION, "?n"), (None, "?n", NATION_REGION, "?r"), (None, "?r", "<urn:region#r_name>", "?region")])
    return bgp.counted(found, ["segment", "region"])


@add("bgp_optional_minus", f"WITH {Q}, N AS (SELECT s AS n, o AS name FROM Q WHERE p = '{NATION_NAME}' AND s NOT IN (SELECT s FROM Q WHERE p = '{NATION_REGION}' AND o = '<urn:region/1>')) SELECT n, name, count(x.s) AS suppliers FROM N LEFT JOIN Q x ON x.o = N.n AND x.p = '<urn:supplier#s_nationkey>' GROUP BY 1, 2")
def bgp_optional_minus(s, d):
    q = quads(s, d)
    nations = bgp.minus(bgp.solutions(q, (None, "?n", NATION_NAME, "?name")), bgp.solutions(q, (None, "?n", NATION_REGION, "<urn:region/1>")))
    got = bgp.optional(nations, bgp.solutions(q, (None, "?x", "<urn:supplier#s_nationkey>", "?n")))
    return got.groupBy("n", "name").agg(F.count("x").alias("suppliers"))


@add("bgp_optional_disjoint", f"WITH {Q} SELECT r, name, CAST(NULL AS VARCHAR) AS missing FROM (SELECT s AS r, o AS name FROM Q WHERE p = '<urn:region#r_name>')")
def bgp_optional_disjoint(s, d):
    q = quads(s, d)
    return bgp.optional(bgp.solutions(q, (None, "?r", "<urn:region#r_name>", "?name")), bgp.solutions(q, (None, None, "<urn:none>", "?missing")))


@add(
    "nquads_escapes",
    """SELECT '<urn:x-quadspark:default>' AS g, '<urn:part/' || p_partkey || '>' AS s, '<urn:caf' || chr(233) || '>' AS p,
    '"caf' || chr(233) || ' ' || chr(128512) || chr(9) || chr(8) || chr(12) || chr(39) || '\\"\\n' || p_brand || '"@en' AS o FROM part WHERE p_brand IS NOT NULL""",
)
def nquads_escapes(s, d):
    part = s.read.parquet(f"{d}/part.parquet").where("p_brand is not null")
    text = F.concat(F.lit('"caf\\u00e9 \\U0001F600\\t\\b\\f\\\'\\"\\n'), "p_brand", F.lit('"@en .'))
    lines = part.select(F.concat(F.lit("<urn:part/"), F.col("p_partkey").cast("string"), F.lit("> <urn:caf\\u00E9> "), text).alias("value"))
    return nq.parsed(lines).select("g", "s", "p", "o")


@add("find_by_stored_number", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE o IN ('\"10\"', '\"10\"^^<{t.XSD}integer>', '\"10.0\"^^<{t.XSD}double>')")
def find_by_stored_number(s, d):
    dictionary, e = coded(s, d)
    return dc.decode(ix.find_by_index(e.drop("quad_id"), ix.by_number(dictionary), "1E1"), dictionary)


# -- datasets, end to end -------------------------------------------------------------------------
def _store(s: SparkSession) -> Dataset:
    return Dataset(s, f"{shared_dir(s)}/stores/{uuid.uuid4().hex}")


@add("dataset_delete_and_find", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE NOT (p = '{SEGMENT}') AND g <> '<urn:g:orders>' UNION ALL SELECT g, s, p, o FROM Q WHERE p = '{SEGMENT}' AND o = '\"BUILDING\"'")
def dataset_delete_and_find(s, d):
    q, store = quads(s, d), _store(s)
    store.add_all(q)
    store.remove(p=SEGMENT)
    store.clear("<urn:g:orders>")
    store.add_all(pt.find(q, p=SEGMENT, o='"BUILDING"'))
    return store.find()


@add("dataset_promote", f"WITH {Q} SELECT s, p, o FROM Q WHERE g = '<urn:g:nation>' AND p = '{NATION_NAME}' UNION ALL SELECT '<urn:new>', '<urn:p>', '\"x\"'")
def dataset_promote(s, d):
    store = _store(s)
    store.add_all(quads(s, d))
    store.begin()
    if not store.promote():
        raise RuntimeError("nobody else has committed")
    store.graph("<urn:g:nation>").remove(p=NATION_REGION)
    store.graph("<urn:g:nation>").add("<urn:new>", "<urn:p>", '"x"')
    store.commit()
    return store.graph("<urn:g:nation>").find()


@add("dataset_compact", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE NOT (p = '{BUYER}')")
def dataset_compact(s, d):
    store = _store(s)
    store.add_all(quads(s, d))
    store.remove(p=BUYER)
    store.compact()
    store.vacuum(older_than=0)
    return store.find()


@add("dataset_set_graph", f"WITH {Q} SELECT g, s, p, o FROM Q WHERE g <> '<urn:g:nation>' UNION ALL SELECT '<urn:g:nation>', s, p, o FROM Q WHERE g = '<urn:g:supplier>'")
def dataset_set_graph(s, d):
    q, store = quads(s, d), _store(s)
    store.add_all(q)
    store.set_graph("<urn:g:nation>", pt.as_triples(pt.find(q, "<urn:g:supplier>")))
    return store.find()


# -- the driver's view --------------------------------------------------------------------------
def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments by region, by a basic graph pattern."""
    return bgp_join(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in SPECS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SPECS.items()}
