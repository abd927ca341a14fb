"""Contract cases of bitmaps, indexes, numeric literals, transactions and graphs."""

import threading

import pytest
from pyspark.sql import functions as F

from quadspark.dataset import Dataset, Graph
from quadspark.functions import bits as b
from quadspark.functions import terms as t
from quadspark.operators import bitmap as bm
from quadspark.operators import dictionary as dc
from quadspark.operators import index as ix
from quadspark.operators import pattern as pt
from quadspark.operators import store as st
from quadspark.plans import bgp
from quadspark.plans.numbering import numbered, packed
from quadspark.sources import nquads as nq
from quadspark.sources.snapshots import SCHEMA, Conflict, Snapshots
from quadspark.streaming.ingest import register_stream
from quadspark.txn import Mode, Promote, Txn, TxnError, Type, and_then

LAST, MAX = 64 * 4294967295, b.MAX_ID


# -- bitmaps ------------------------------------------------------------------------------------
def maps(spark, **sets):
    rows = [(n, i) for n, ids in sets.items() for i in ids]
    return bm.build(spark.createDataFrame(rows, "name string, id long"))


def ids(rows):
    named = rows if "name" in rows.columns else rows.withColumn("name", F.lit("x"))
    return sorted(r.id for r in bm.iterate(named).collect())


def test_bitmap_algebra(spark):
    a, c = [1, 64, MAX], [1, 65, LAST, MAX]
    assert ids(bm.intersection(maps(spark, a=a, c=c), 2)) == [1, MAX]
    assert ids(bm.intersection(maps(spark, a=a), 2)) == [] and ids(bm.intersection(maps(spark, a=[1], c=[70]), 2)) == []
    assert ids(bm.union(maps(spark, a=[1, MAX], c=[64, LAST]))) == [1, 64, LAST, MAX]
    assert ids(bm.union(maps(spark, a=a, c=[64, LAST]))) == [1, 64, LAST, MAX]
    assert ids(bm.xor(maps(spark, a=a, c=c))) == [64, 65, LAST]
    assert ids(bm.xor(maps(spark, a=[*a, 192], c=c))) == [64, 65, 192, LAST]
    assert ids(bm.xor(maps(spark, a=[1, 64, 192], c=c))) == [64, 65, 192, LAST, MAX]
    assert ids(bm.xor(maps(spark, a=[1, 64, 192], c=[1, 64, 192]))) == []


def test_bitmap_pages_lowest_and_clear(spark):
    one = lambda x: spark.createDataFrame([("a", x)], "name string, id long")
    for n, k in ((1, 1), (2, 2), (3, 3), (4, 3)):
        assert bm.pages(maps(spark, a=[1, 64, LAST, MAX][:n])).first().n_pages == k
    m, lowest, pages = maps(spark, a=[1, 64, LAST, MAX]), [], []
    for x in (1, 64, LAST, MAX):
        lowest.append(bm.lowest(m, one(1)).first().lowest)
        m = bm.clear(m, one(x))
        pages.append(m.count())
    assert lowest == [1, 64, LAST, MAX] and pages == [2, 1, 1, 0] and bm.lowest(m, one(1)).first().lowest == -1
    held = {r.id: r.held for r in bm.contains(maps(spark, a=[1, 64, MAX]), spark.createDataFrame([("a", i) for i in (0, 1, 63, 64, MAX)], "name string, id long")).collect()}
    assert held == {0: False, 1: True, 63: False, 64: True, MAX: True}
    assert bm.higher_page(maps(spark, a=[1, 64, MAX]), 1).first().page == 4294967295
    for bad in (MAX + 1, -1):
        with pytest.raises(Exception, match="out of range"):
            bm.build(one(bad)).collect()


@pytest.mark.parametrize(
    "expr,want",
    [
        (lambda: b.word_set(F.lit(3), F.lit(2)), 7), (lambda: b.word_clear(F.lit(15), F.lit(2)), 11), (lambda: b.word_logical(F.lit(0xD), F.lit(3), lambda x, y: x.bitwiseOR(y)), 15),
        (lambda: b.word_logical(F.lit(4), F.lit(3), lambda x, y: x.bitwiseOR(y)), 7), (lambda: b.word_logical(F.lit(0xF), F.lit(3), lambda x, y: x.bitwiseAND(y)), 3), (lambda: b.word_logical(F.lit(4), F.lit(3), lambda x, y: x.bitwiseAND(y)), 0),
    ],
)
def test_words(spark, expr, want):
    assert spark.range(1).select(expr().alias("x")).first().x == want


# -- indexes and numbers ------------------------------------------------------------------------
def test_index(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "item string, id long")
    i = ix.register(frame(), frame(("one", 1), ("two", 2), ("three", 3), ("two", 2)))
    assert ix.size(i).first().n == 3 and [r.id for r in ix.get(i, "two").collect()] == [2] and ix.get(i, "none").count() == 0
    i = ix.delete(i, frame(("two", 2), ("none", 9)))
    assert ix.size(i).first().n == 2 and ix.get(i, "two").count() == 0 and ix.get(i, "one").count() == 1
    with pytest.raises(Exception, match="out of range"):
        ix.register(frame(), frame(("x", 2**31 - 1))).collect()


def test_numeric_literals_meet_by_value(spark):
    groups = [
        [("2147483647", "int"), ("2147483647", "long"), ("2147483647.0", "decimal"), ("2147483647", None), ("2.147483647E9", "double")],
        [("9223372036854775807", "long"), ("9223372036854775807", "integer"), ("+9223372036854775807.000", "decimal")],
        [("1.7976931348623157E308", "double"), ("1.7976931348623157E308", None)],
        [("10", "int"), ("10.0", "decimal"), ("1E1", "double"), ("010.00", None), ("10", "float")],
        [("3.14", "double"), ("3.14", "decimal"), ("3.14", None)], [("3.14", "float")], [("-12.50", "decimal"), ("-125e-1", None)], [("0", "int"), ("-0.00", "decimal"), ("0E5", None)], [("1682936023743", "unsignedLong")],
    ]
    rows = [(g, lex, dt) for g, own in enumerate(groups) for lex, dt in own]
    term = lambda lex, dt: f'"{lex}"' + (f"^^<{t.XSD}{dt}>" if dt else "")
    df = spark.createDataFrame([(g, term(lex, dt)) for g, lex, dt in rows], "g int, term string").withColumn("key", t.number_key(F.col("term")))
    by = {}
    for r in df.collect():
        assert r.key is not None, r
        by.setdefault(r.g, set()).add(r.key)
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(groups)
    odd = ['"wow"', '" 1"', '"1d"', '"1"@en', f'"NaN"^^<{t.XSD}double>', f'"INF"^^<{t.XSD}float>', f'"2020-01-01"^^<{t.XSD}date>', "<urn:1>", "_:1", '""', '"."', '"1e"']
    assert {r.k for r in spark.createDataFrame([(x,) for x in odd], "x string").select(t.number_key(F.col("x")).alias("k")).collect()} == {None}


# -- transactions -------------------------------------------------------------------------------
def counted():
    n = [0, 0, 0, 0]

    def up(i):
        return lambda *_: n.__setitem__(i, n[i] + 1)

    return Txn(up(0), up(1), up(2), up(3)), n


def test_automatic_transactions():
    x, n = counted()
    for want in ([1, 1, 0, 0], [2, 2, 0, 0]):
        with x.within(Mode.WRITE):
            pass
        assert n == want
    x.begin(Type.READ)
    with x.within(Mode.READ):
        pass
    with pytest.raises(TxnError), x.within(Mode.WRITE):
        pass
    x.end()
    assert n == [3, 2, 0, 1]
    x.begin(Type.WRITE)
    with x.within(Mode.READ):
        pass
    x.commit()
    assert n == [4, 3, 0, 1]
    with pytest.raises(KeyError), x.within(Mode.WRITE):
        raise KeyError
    assert n == [5, 3, 1, 1] and not x.is_active()


def test_commit_abort_end():
    x, n = counted()
    x.begin(Type.READ), x.commit(), x.begin(Type.WRITE), x.commit()
    assert n == [2, 1, 0, 1]
    x, n = counted()
    x.begin(Type.READ), x.abort(), x.begin(Type.WRITE), x.abort()
    assert n == [2, 0, 1, 1]
    for call in (x.abort, x.commit, x.promote):
        with pytest.raises(TxnError):
            call()
    x, n = counted()
    x.begin(Type.READ), x.end(), x.begin(Type.WRITE)
    with pytest.raises(TxnError):
        x.end()
    assert n == [2, 0, 1, 1]
    x.begin(Type.WRITE), x.commit(), x.end()
    assert n == [3, 1, 1, 1]
    x.begin(Type.READ)
    with pytest.raises(TxnError):
        x.begin(Type.READ)


def test_promotion():
    x, _ = counted()
    x.begin()
    assert x.type is Type.READ_PROMOTE and x.promote() and x.promote() and x.mode is Mode.WRITE
    x.commit()
    x.begin(Type.READ)
    assert not x.promote()
    x.end()
    for kind, want in ((Type.READ_PROMOTE, False), (Type.READ_COMMITTED_PROMOTE, True)):
        x.begin(kind)

        def other():
            with x.within(Mode.WRITE):
                pass

        th = threading.Thread(target=other)
        th.start(), th.join()
        assert x.promote() is want
        x.abort()


def test_promotion_by_an_explicit_mode():
    x, _ = counted()
    for kind, how, want in ((Type.READ_PROMOTE, Promote.READ_COMMITTED, True), (Type.READ_COMMITTED_PROMOTE, Promote.ISOLATED, False), (Type.READ, Promote.READ_COMMITTED, False)):
        x.begin(kind)
        th = threading.Thread(target=lambda: [None for _ in [0] for _ in [x.begin(Type.WRITE), x.commit()]])
        th.start(), th.join()
        assert x.promote(how) is want
        x.abort()
        assert x.id is None


def test_a_failing_promotion_leaves_no_lock():
    calls = iter([0, 0, OSError(), 0, 0])

    def generation():
        got = next(calls)
        if isinstance(got, Exception):
            raise got
        return got

    x = Txn(generation=generation)
    x.begin()
    with pytest.raises(OSError):
        x.promote()
    assert x.mode is Mode.READ
    x.end()
    assert x._writer.acquire(blocking=False)


def test_failures_leave_no_lock():
    def fail(*_):
        raise OSError

    x = Txn(begin=fail)
    for _ in range(2):
        with pytest.raises(OSError):
            x.begin(Type.WRITE)
    x = Txn(commit=fail)
    for _ in range(2):
        x.begin(Type.WRITE)
        with pytest.raises(OSError):
            x.commit()
    out = []
    and_then(lambda: out.append(1), lambda: out.append(2))()
    assert out == [1, 2]


# -- graphs and datasets ------------------------------------------------------------------------
TITLE = "<http://purl.org/dc/elements/1.1/title>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_triple_graph(spark, tmp_path):
    with Dataset(spark, str(tmp_path / "one")) as d:
        g = d.default_graph()
        g.add("_:b", TITLE, '"Test"')
        assert g.find(None, TITLE, '"test"').count() == 0 and g.find(None, TITLE, '"Test"').count() == 1 and rows(g.find()) == [("_:b", TITLE, '"Test"')]
        assert g.size() == 1 and g.contains(p=TITLE) and not d.is_empty()


def test_dataset(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "many"))
    assert d.is_empty() and d.supports_transactions()
    d.begin(Type.WRITE)
    for text in ("<x>", '"x"', '"x"@en', f'"x"^^<{t.XSD}string>'):
        d.add("<g1>", "<s>", "<p>", text)
        d.add("<g1>", "<s>", "<p>", text)
    d.add_to_default_graph("<s>", "<p>", "<o>")
    d.add_to_named_graph("<g2>", "<s>", "<p>", "<x>")
    assert d.size() == 6 and d.is_in_transaction()
    d.commit()
    assert d.size() == 6 and d.graph("<g1>").size() == 4 and d.graph("default").size() == 1 and d.graph("").name == t.DEFAULT_GRAPH
    assert rows(d.graph_nodes()) == [("<g1>",), ("<g2>",)] and d.union_graph().count() == 4
    assert d.find_in_any_named_graph("<s>", None, "<x>").count() == 2 and d.find_in_default_graph().count() == 1 and d.find_in_named_graph("<g2>").count() == 1
    # a reader keeps its generation while a writer commits
    d.begin(Type.READ)
    th = threading.Thread(target=lambda: d.delete("<g2>", "<s>", "<p>", "<x>"))
    th.start(), th.join()
    assert d.size() == 6
    d.end()
    assert d.size() == 5 and not d.contains("<g2>")
    # delete, then insert again, and drop
    d.begin(Type.WRITE)
    d.delete(None, "<s>", "<p>", "<o>")
    assert d.size() == 4
    d.add(None, "<s>", "<p>", "<o>")
    d.delete("<none>", "<s>", "<p>", "<o>")
    assert d.size() == 5
    d.abort()
    assert d.size() == 5
    d.remove(g="<g1>", o='"x"')
    d.clear("default")
    assert d.size() == 3
    g = Graph(d, "<g3>")
    g.add_all(spark.createDataFrame([("<a>", "<b>", "<c>")] * 2, "s string, p string, o string"))
    g.begin(), g.delete("<a>", "<b>", "<c>"), g.abort()
    assert g.size() == 1
    d.set_prefix("ex", "http://example.org/")
    assert d.expand("ex:a") == "<http://example.org/a>" and rows(d.prefixes()) == [("ex", "http://example.org/")]


def test_snapshots_refuse_the_second_writer(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "snap"))
    q = spark.createDataFrame([("<g>", "<s>", "<p>", "<o>")], SCHEMA)
    assert s.generation() == 0 and s.read().count() == 0 and s.commit(q, 0) == 1
    with pytest.raises(Conflict):
        s.commit(q, 0)
    assert s.commit(q.withColumn("o", F.lit("<z>")), 1, appended=True) == 2 and s.size() == 2 and s.size(1) == 1
    plan = pt.find(s.read(), p="<p>", o="<z>")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p,<p>)" in plan and "EqualTo(o,<z>)" in plan


@pytest.mark.parametrize("left", ["", '{"folders": [["ad'])
def test_an_unreadable_entry_locks_nothing(spark, tmp_path, left):
    s = Snapshots(spark, str(tmp_path / "cut"))
    q = spark.createDataFrame([("<g>", "<s>", "<p>", "<o>")], SCHEMA)
    s.commit(q, 0)
    (tmp_path / "cut/log/2").write_text(left)  # a writer died here
    for k in (1, 2, 3):
        s = Snapshots(spark, str(tmp_path / "cut"))
        assert s.generation() == k and s.commit(q.withColumn("o", F.lit(f"<o{k}>")), k, appended=True) == k + 1
    assert s.size() == 4
    with pytest.raises(Conflict):
        s.commit(q, 1)


def test_a_writer_that_dies_before_it_publishes_changes_nothing(spark, tmp_path, monkeypatch):
    d = Dataset(spark, str(tmp_path / "dies"))
    d.add("<g>", "<s>", "<p>", "<o>")

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(d.snapshots, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        d.add("<g>", "<s>", "<p>", "<z>")
    monkeypatch.undo()
    assert d.size() == 1
    d.add("<g>", "<s>", "<p>", "<w>")
    assert d.size() == 2
    d.compact()
    assert d.vacuum(older_than=0) >= 3 and Dataset(spark, str(tmp_path / "dies")).size() == 2 and d.snapshots.folders() == 1


def test_deleting_writes_what_is_deleted(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "del"), compact_at=6)
    d.add_all(spark.range(2000).select(F.lit("<g>").alias("g"), F.format_string("<s%d>", "id").alias("s"), F.lit("<p>").alias("p"), F.lit("<o>").alias("o")))
    d.begin(Type.WRITE)
    d.delete("<g>", "<s5>", "<p>", "<o>")
    d.delete("<g>", "<s6>", "<p>", "<o>")
    d.delete("<g>", "<unknown>", "<p>", "<o>")
    d.add("<g>", "<s6>", "<p>", "<o>")
    d.add("<g>", "<new>", "<p>", "<o>")
    d.commit()
    kinds = d.snapshots._folders(2)
    assert [k for k, _ in kinds] == ["add", "del", "add"] and d.snapshots._scan([kinds[1][1]]).count() == 1 and d.snapshots._scan([kinds[2][1]]).count() == 1
    assert d.size() == 2000 and not d.contains(s="<s5>") and d.contains(s="<s6>")
    d.add("<g>", "<s5>", "<p>", "<o>")  # added again after its deletion
    d.remove(s="<new>")
    assert d.size() == 2000 and d.contains(s="<s5>") and d.snapshots.size(1) == 2000 and d.snapshots.folders() == 5
    d.remove(s="<s7>")
    d.remove(s="<s8>")  # beyond six folders they are compacted
    assert d.snapshots.folders() == 1 and d.size() == 1998


def test_deleting_by_a_pattern_writes_no_quads(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "pat"))
    quads = spark.range(100).select(F.format_string("<g%d>", F.col("id") % 2).alias("g"), F.format_string("<s%d>", "id").alias("s"), F.lit("<p>").alias("p"), F.lit("<o>").alias("o"))
    d.add_all(quads.unionByName(quads))
    d.clear("<g1>")
    d.remove(s="<s4>", p="<p>")
    assert [k for k, _ in d.snapshots._folders(3)] == ["add", "pat", "pat"] and len(list((tmp_path / "pat/data").iterdir())) == 1
    assert d.size() == d.quads().distinct().count() == 49 and d.snapshots.size(2) == 50 and not d.contains(s="<s4>")
    plan = d.quads()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Not(EqualTo(g,<g1>))" in plan
    d.delete("<g0>", "<s6>", "<p>", "<o>")
    d.add("<g1>", "<s1>", "<p>", "<o>")  # again after its pattern
    again = Dataset(spark, str(tmp_path / "pat"))
    assert again.size() == 49 and again.contains(s="<s1>") and not again.contains(s="<s6>")
    again.compact()
    again.vacuum(older_than=0)
    assert again.snapshots.folders() == 1 and again.size() == 49


def test_patterns_among_other_changes_hold_in_their_order(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "order"))
    d.add_all(spark.createDataFrame([(None, "<a>", "<p>", "<o>"), ("<g>", "<b>", "<p>", "<o>"), ("<g>", "<c>", "<q>", "<o>")], SCHEMA))
    for deleting in (False, True):
        d.begin(Type.WRITE)
        d.add_all(spark.createDataFrame([("<g>", "<early>", "<p>", "<o>"), (None, "<kept>", "<q>", "<o>")], SCHEMA))
        d.remove(p="<p>")
        d.add("<g>", "<b>", "<p>", "<o>")
        d.add(None, "<a>", "<r>", "<o>")
        if deleting:
            d.delete("<g>", "<b>", "<p>", "<o>")
            d.delete("<g>", "<c>", "<q>", "<o>")
        d.remove(s="<a>")
        d.add(None, "<late>", "<r>", "<o>")
        seen = rows(d.quads())
        d.commit()
        left = [] if deleting else [("<g>", "<b>", "<p>", "<o>"), ("<g>", "<c>", "<q>", "<o>")]
        assert seen == rows(d.quads()) == sorted([*left, (t.DEFAULT_GRAPH, "<kept>", "<q>", "<o>"), (t.DEFAULT_GRAPH, "<late>", "<r>", "<o>")])


def test_whole_graphs(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "graphs"))
    triples = spark.createDataFrame([("<a>", "<b>", "<c>"), ("<a>", "<b>", "<d>")], "s string, p string, o string")
    d.add_graph("<g>", triples)
    d.set_graph("<g>", triples.where("o = '<d>'"))
    assert rows(d.graph("<g>").find()) == [("<a>", "<b>", "<d>")] and d.contains_graph("<g>") and not d.contains_graph("<h>") and d.contains_graph("default")
    d.remove_graph("<g>")
    assert d.is_empty()


def test_sixteen_shapes_unknown_terms_and_bitmap_agreement(spark):
    quads = [(g, s, p, o) for g in ("<g1>", "<g2>") for s in ("<a>", "<b>") for p in ("<p>", "<q>") for o in ("<a>", '"x"')]
    q = spark.createDataFrame(quads, SCHEMA)
    dictionary = dc.build(q)
    e = dc.with_quad_ids(dc.encode(q, dictionary))
    postings = bm.posting_lists(e)
    known = {r.term: r.term_id for r in dictionary.collect()}
    for k in range(16):
        bound = {c: x for i, (c, x) in enumerate(zip("gspo", ("<g1>", "<b>", "<q>", '"x"'))) if k >> i & 1}
        want = sorted(x for x in quads if all(x["gspo".index(c)] == v for c, v in bound.items()))
        assert rows(pt.find(q, **bound)) == want
        hits = bm.find(e, postings, {c: known[v] for c, v in bound.items()})
        assert rows(dc.decode(hits.drop("quad_id"), dictionary)) == want
    assert pt.find(q, s="<none>", p="<q>").count() == 0 and pt.find(q, s="<p>").count() == 0
    assert bm.find(e, postings, {"s": -1, "p": known["<q>"]}).count() == 0 and bm.find(e, postings, {"s": known["<p>"]}).count() == 0


def test_store_operations(spark):
    q = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    one, two = ("<g>", "<s>", "<p>", "<o>"), (t.DEFAULT_GRAPH, "<s>", "<p>", "<o>")
    assert rows(st.register(q(one), q(one, (None, "<s>", "<p>", "<o>"), ("<g>", None, "<p>", "<o>")))) == sorted([one, two])
    assert rows(st.additions(q(one), q(one, two, two))) == [two]
    assert rows(st.delete(q(one, two), q((None, "<s>", "<p>", "<o>"), ("<x>", "<y>", "<z>", "<w>")))) == [one]
    assert rows(st.overlay(q(one), q(one), q(one))) == [one]
    values = spark.createDataFrame([(3, "c"), (9, "z")], "id long, v string")
    assert rows(st.append(values, spark.createDataFrame([("b",), ("a",)], "v string"), ["v"])) == [(3, "c"), (9, "z"), (10, "a"), (11, "b")]
    assert rows(st.upsert(values, values.where("id = 3").withColumn("v", F.lit("C")))) == [(3, "C"), (9, "z")]
    assert tuple(st.list_sizes(st.remove(values, values.where("id = 3"))).first()) == (1, 10)
    assert [dc.page_size(n) for n in (0, 1, 2, 4, 5, 10**12 + 1)] == [0, 1, 2, 2, 3, 1000001]
    with pytest.raises(ValueError):
        dc.page_size(2**63)
    big = [0, 1, 2, 4, 5, 10**12 + 1, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1, (2**30) ** 2 + 1]
    got = spark.createDataFrame([(n,) for n in big], "n long").select("n", dc.page_sizes(F.col("n")).alias("size")).collect()
    assert all(r.size == dc.page_size(r.n) for r in got) and len(got) == len(big)
    for bad in (-1, st.MAX_ID + 1):
        with pytest.raises(Exception, match="out of range"):
            st.upsert(values, spark.createDataFrame([(bad, "x")], "id long, v string")).collect()
    assert st.upsert(values, spark.createDataFrame([(st.MAX_ID, "x")], "id long, v string")).count() == 3


def test_dictionary_never_reuses_ids(spark):
    terms = lambda *x: spark.createDataFrame([(y,) for y in x], "term string")
    d = numbered(terms("<c>", "<a>", "<b>"), ["term"], "term_id")
    assert rows(d) == [("<a>", 0), ("<b>", 1), ("<c>", 2)]
    assert rows(dc.grown(d, terms("<0>", "<b>", "<z>"))) == [("<0>", 3), ("<a>", 0), ("<b>", 1), ("<c>", 2), ("<z>", 4)]
    assert rows(dc.register_result(d, terms("<b>", "<0>"))) == [("<0>", False, 3, True), ("<b>", True, 1, False)]
    assert rows(dc.delete_result(d, terms("<b>", "<0>"))) == [("<0>", False, -1), ("<b>", True, 1)]
    assert rows(dc.by_id(d, spark.createDataFrame([(1,), (77,)], "term_id long"))) == [(1, "<b>")]
    assert numbered(terms(), ["term"]).count() == 0


def test_packed_sort_keys_keep_the_order(spark):
    big = 2**40
    given = [(a, b, c) for a in (0, 1, big) for b in (0, 3, 2**20) for c in (7, 2, big)]
    for more, keys in (([], 2), ([(2**62, 2, 2)], 3), ([(-1, 2, 2)], 3), ([(None, 2, 2)], 3)):
        want = sorted([*given, *more], key=lambda x: (x[0] is not None, x))
        df = spark.createDataFrame(want[::-1], "a long, b long, c long").repartition(3)
        assert len(packed(df, ["a", "b", "c"])) == keys
        assert [tuple(r)[:3] for r in numbered(df, ["a", "b", "c"]).orderBy("id").collect()] == want
    zeros = spark.createDataFrame([(0, 0, "x")] * 3, "a int, b int, c string")
    assert len(packed(zeros, ["a", "b", "c"])) == 2 and [r.id for r in numbered(zeros, ["a", "b", "c"]).orderBy("id").collect()] == [0, 1, 2]
    assert packed(zeros, ["c", "a"]) == ["c", "a"] and packed(zeros.limit(0), ["a", "b"]) == ["a", "b"]


def test_nquads(spark, tmp_path):
    texts = ['plain', 'quote " and \\ back', "line\nbreak\r", 'tricky" .', "é日本", "", '"', "\\"]
    q = spark.createDataFrame([("<g>", f"<s{i}>", "<p>", x) for i, x in enumerate(texts)], "g string, s string, p string, x string")
    q = q.select("g", "s", "p", t.literal(F.col("x")).alias("o")).unionByName(q.select(F.lit(t.DEFAULT_GRAPH).alias("g"), F.lit("_:b").alias("s"), "p", t.literal(F.col("x"), lang=F.lit("en-GB")).alias("o"))).unionByName(
        q.select("g", "s", "p", t.literal(F.col("x"), "integer").alias("o"))
    )
    path = str(tmp_path / "nq")
    nq.write(q, path)
    assert rows(nq.read(spark, path)) == rows(q.distinct())
    assert sorted(r.x for r in q.where("g = '<g>'").select(t.lexical(F.col("o")).alias("x")).collect()) == sorted(texts * 2)
    lines = ['<s> <p> "a" .', '_:b <p> <o> <g> . # note', "", "# only a note", "<s> <p> .", '"s" <p> <o> .', '<s> <p> "a" "b" .', '<s> <p> "\\u0041\\tb" .']
    got = nq.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(got) == 6 and sum(r.bad is not None for r in got) >= 2 and got[0].g == t.DEFAULT_GRAPH and got[1].g == "<g>"
    (tmp_path / "bad.nq").write_text("no quad\n")
    with pytest.raises(Exception, match="not a quad"):
        nq.read(spark, str(tmp_path / "bad.nq")).collect()
    assert nq.read(spark, str(tmp_path / "bad.nq"), strict=False).count() == 0


def test_nquads_escapes_are_decoded(spark):
    line = lambda o: f"<s> <p> {o} <g> ."
    good = {'"caf\\u00e9"': '"café"', '"\\U0001F600\\uD83D\\uDE00"@en': '"😀😀"@en', '"a\\b\\f\\t\\\'"': '"a\b\f\t\'"', '"\\\\u0041"': '"\\\\u0041"', '"q\\"\\\\\\n\\r"': '"q\\"\\\\\\n\\r"', "<http://x/caf\\u00E9>": "<http://x/café>",
            '"\\u0022 \\u005c \\u000a"': '"\\" \\\\ \\n"', '"\\u006E"^^<http://x/\\u0041>': '"n"^^<http://x/A>', '"a\x01b"': '"a\x01b"', '"plain"': '"plain"', '"tab\there"': '"tab\there"'}
    got = nq.parsed(spark.createDataFrame([(line(o),) for o in good], "value string")).collect()
    assert [(r.bad, r.o) for r in got] == [(None, o) for o in good.values()] and {(r.g, r.s, r.p) for r in got} == {("<g>", "<s>", "<p>")}
    bad = [line('"\\x"'), line('"\\u12"'), line('"\\U00110000"'), line("<a b>"), line("<a\\n>"), "\x02<s>\x01<p>\x01<o>\x01", "<s> <p> <o> <g> <h> ."]
    assert all(r.bad is not None and r.s is None for r in nq.parsed(spark.createDataFrame([(x,) for x in bad], "value string")).collect())
    assert spark.range(1).select(t.lexical(F.lit('"caf\\u00e9\\n"')).alias("x")).first().x == "café\n"


def test_optional_without_shared_or_with_unbound_variables(spark):
    a = spark.createDataFrame([("<1>", "<x>"), ("<2>", None)], "a string, b string")
    none = spark.createDataFrame([], "c string")
    assert rows(bgp.optional(a.where("b is not null"), none)) == [("<1>", "<x>", None)]
    assert bgp.optional(a, spark.createDataFrame([("<c>",), ("<d>",)], "c string")).count() == 4
    c = spark.createDataFrame([("<x>", "<p>"), ("<y>", "<q>"), (None, "<r>")], "b string, c string")
    show = lambda df: sorted(map(str, (tuple(r) for r in df.select("a", "b", "c").collect())))
    want = [("<1>", "<x>", "<p>"), ("<1>", "<x>", "<r>"), ("<2>", "<x>", "<p>"), ("<2>", "<y>", "<q>"), ("<2>", None, "<r>")]
    assert show(bgp.join(a, c, unbound=["b"])) == sorted(map(str, want)) == show(bgp.optional(a, c, unbound=["b"]))
    assert show(bgp.optional(a, c.where("b = '<y>'"), unbound=["b"])) == sorted(map(str, [("<1>", "<x>", None), ("<2>", "<y>", "<q>")]))


def test_patterns_are_joined_where_they_share_variables():
    first, far, between = (None, "?a", "<p>", "?b"), (None, "?c", "<q>", "?d"), (None, "?b", "<r>", "?c")
    assert bgp.connected([first, far, between]) == [first, between, far] and bgp.connected([first, far]) == [first, far]


def test_stored_indexes_answer_lookups(spark):
    q = spark.createDataFrame([("<g>", f"<s{i}>", "<p>", o) for i, o in enumerate(['"10"', f'"10.0"^^<{t.XSD}decimal>', '"ten"@en', '"zehn"@de', "<10>", '"11"'])], SCHEMA)
    d = dc.build(q)
    e = dc.encode(q, d)
    assert {r.s for r in dc.decode(ix.find_by_index(e, ix.by_number(d), "1E1"), d).collect()} == {"<s0>", "<s1>"} == {r.s for r in ix.find_by_number(q, "1e1").collect()}
    assert {r.s for r in dc.decode(ix.find_by_index(e, ix.by_lang(d), "de"), d).collect()} == {"<s3>"}


def test_graph_patterns(spark):
    q = spark.createDataFrame([("<g>", "<a>", "<knows>", "<b>"), ("<g>", "<b>", "<knows>", "<b>"), ("<g>", "<b>", "<name>", '"B"')], SCHEMA)
    assert rows(bgp.bgp(q, [(None, "?x", "<knows>", "?y"), (None, "?y", "<name>", "?n")]).select("x", "n")) == [("<a>", '"B"'), ("<b>", '"B"')]
    assert rows(bgp.solutions(q, (None, "?x", "<knows>", "?x"))) == [("<b>",)]
    people, named = bgp.solutions(q, (None, "?x", "<knows>", None)), bgp.solutions(q, (None, "?x", "<name>", "?n"))
    assert rows(bgp.optional(people, named).select("x", "n")) == [("<a>", None), ("<b>", '"B"')] and rows(bgp.minus(people, named)) == [("<a>",)]
    assert bgp.union(people, named).count() == 3 and bgp.having(people, F.col("x") == "<a>").count() == 1


def test_stream_registers_each_quad_once(spark, tmp_path):
    spark.createDataFrame([("<g>", "<s>", "<p>", "<o>")] * 3, SCHEMA).write.parquet(str(tmp_path / "in"))
    d = Dataset(spark, str(tmp_path / "store"))
    for k in range(2):  # the second stream delivers the same quads again
        s = register_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), d, str(tmp_path / f"check{k}"), availableNow=True)
        s.awaitTermination(120)
    assert d.size() == 1
