import pytest

from oracle import differs
from quadspark import queries

SPECS = queries.SPECS


@pytest.mark.parametrize("name", SPECS)
def test_query_equals_its_sql(spark, sf, name):
    query, sql = SPECS[name]
    assert differs(spark, sf, query, sql) is None


@pytest.mark.parametrize("name", ["decode_quads", "postings", "find_via_bitmap", "term_lookup"])
def test_dictionary_queries_name_every_mapped_table(name):
    assert queries.Q in SPECS[name][1]


def test_decoded_quads_are_of_every_graph(spark, sf):
    assert {r.g for r in SPECS["decode_quads"][0](spark, sf).select("g").distinct().collect()} == {x.graph for x in queries.mp.CATALOG}


def test_graphs_and_predicates_are_not_shuffled(spark, sf):
    q = queries.quads(spark, sf)
    for df in (queries.dc.encode(q, queries.dc.build(q)), SPECS["decode_quads"][0](spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g" not in plan and "hashpartitioning(p" not in plan


def test_shuffles_carry_few_terms_and_tables_are_columnar(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = queries.quads(spark, sf)
        encoded, decoded = (df._jdf.queryExecution().executedPlan().toString() for df in (queries.dc.encode(q, queries.dc.build(q)), SPECS["decode_quads"][0](spark, sf)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = lambda plan: [x.split("Join [")[1][0:2] for x in plan.splitlines() if "Join [" in x and "Join [_p" not in x]
    assert joins(decoded) == ["p_", "g_", "o_", "s_"]  # the last join comes first in a plan
    assert "hashpartitioning(_hash" in encoded and encoded.index("SortMergeJoin") < encoded.index("BroadcastHashJoin [p#")
    assert "FileScan parquet [s_id" in decoded or "FileScan parquet [g_id" in decoded


@pytest.mark.parametrize("terms", [{"s": "<urn:nation/3>"}, {"s": "<urn:nation/03>"}, {"o": "<urn:nation/7>"}, {"s": "<urn:x/3>"}, {"p": queries.SEGMENT, "o": '"BUILDING"'}, {"o": '"BUILDING"'}, {"g": "<urn:g:none>"}, {"s": "<urn:part/1>", "o": "<urn:part/1>"}])
def test_planned_patterns_equal_filtered_quads(spark, sf, terms):
    rows = lambda df: sorted(tuple(r) for r in df.select("g", "s", "p", "o").collect())
    assert rows(queries.mp.find(spark, sf, **terms)) == rows(queries.pt.find(queries.quads(spark, sf), **terms))


def test_bound_subjects_reach_the_scan(spark, sf):
    plan = queries.mp.find(spark, sf, s="<urn:customer/5>")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,5)" in plan and plan.count("FileScan") == 1


def test_entry_has_rows(spark, sf):
    assert queries.entry(spark, sf).count() > 0
