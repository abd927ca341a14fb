"""A dataset of graphs over a transactional quad store, and views of its graphs."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.functions.terms import DEFAULT_GRAPH
from quadspark.operators import pattern as pt
from quadspark.operators import store as st
from quadspark.sources.snapshots import SCHEMA, Pattern, Snapshots
from quadspark.txn import Mode, Promote, Txn, TxnError, Type

Row = tuple[str, str, str, str]


class Dataset:
    """Quads in snapshots below ``path``. Single quads are buffered on the driver until commit;
    tables are added and removed as DataFrames. A commit writes what it changes; one that makes a
    generation of more than ``compact_at`` folders is followed by one that compacts them."""

    def __init__(self, spark: SparkSession, path: str, compact_at: int = 64):
        self.spark = spark
        self.snapshots = Snapshots(spark, path)
        self.txn = Txn(begin=self._begin, commit=self._commit, abort=self._forget, end=self._forget, generation=self.snapshots.generation, name=path)
        self.compact_at = compact_at
        self._prefixes: dict[str, str] = {}
        self._own = threading.local()

    def __enter__(self) -> "Dataset":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.txn.is_active():
            self.txn.abort()

    # -- transaction
    # the changes of a transaction are those of its thread; other threads never see them
    @property
    def _changes(self) -> list[tuple[bool, DataFrame | Pattern]]:
        """Quads that are added or deleted, and patterns whose quads are deleted."""
        return self._own.__dict__.setdefault("changes", [])

    @property
    def _buffer(self) -> dict[Row, bool]:
        return self._own.__dict__.setdefault("buffer", {})

    def _forget(self) -> None:
        self._own.__dict__.clear()

    def _begin(self, mode: Mode) -> None:
        if mode is Mode.WRITE:
            self._forget()

    def begin(self, kind: Type = Type.READ_PROMOTE) -> None:
        self.txn.begin(kind)

    def promote(self, how: Promote | None = None) -> bool:
        return self.txn.promote(how)

    def commit(self) -> None:
        self.txn.commit()

    def abort(self) -> None:
        self.txn.abort()

    def end(self) -> None:
        self.txn.end()

    def supports_transactions(self) -> bool:
        return True

    def is_in_transaction(self) -> bool:
        return self.txn.is_active()

    def transaction_mode(self) -> Mode | None:
        return self.txn.mode

    def transaction_type(self) -> Type | None:
        return self.txn.type

    def _flush(self) -> None:
        for adding in (False, True):
            rows = [r for r, add in self._buffer.items() if add == adding]
            if rows:
                self._changes.append((adding, self.spark.createDataFrame(rows, SCHEMA)))
        self._buffer.clear()

    def _commit(self) -> None:
        self._flush()
        since = self.txn.pinned
        if self._changes:
            self.snapshots.commit(since=since, appended=True, **self._net(since))
            if self.snapshots.folders(since + 1) > self.compact_at:
                self.snapshots.compact(since + 1)
        self._forget()

    def _net(self, since: int) -> dict:
        """What to commit: patterns whose quads go from the snapshot, quads that are new to what is left of
        it, and quads of that which go. Of several changes of one quad the last holds."""
        patterns = {n: x for n, (_, x) in enumerate(self._changes) if isinstance(x, dict)}
        each = []
        for n, (add, x) in enumerate(self._changes):
            if n not in patterns:
                later = [p for k, p in patterns.items() if k > n]
                each.append((n, add, reduce(lambda q, p: st.remove_pattern(q, **p), later, st.normalised(x))))
        net = {"quads": None, "patterns": list(patterns.values())}
        if not each:
            return net
        was = reduce(lambda q, p: st.remove_pattern(q, **p), net["patterns"], self.snapshots.read(since))
        if all(add for _, add, _ in each):
            new = reduce(DataFrame.unionByName, [x for *_, x in each])
            if not self.snapshots.folders(since):
                return net | {"quads": new, "repeated": True}
            return net | {"quads": st.additions(was, new)}
        if not any(add for _, add, _ in each):
            gone = reduce(DataFrame.unionByName, [x for *_, x in each]).dropDuplicates(pt.POSITIONS)
            return net | {"deleted": gone.join(was, pt.POSITIONS, "left_semi")}
        marked = [x.withColumns({"_n": F.lit(n), "_add": F.lit(add)}) for n, add, x in each]
        last = reduce(DataFrame.unionByName, marked).groupBy(*pt.POSITIONS).agg(F.max_by("_add", "_n").alias("_add"))
        added, gone = (last.where(x).select(*pt.POSITIONS) for x in ("_add", "not _add"))
        return net | {"quads": added.join(was, pt.POSITIONS, "left_anti"), "deleted": gone.join(was, pt.POSITIONS, "left_semi")}

    def _seen(self) -> DataFrame:
        """The pinned snapshot with this transaction's changes in their order."""
        now = self.snapshots.read(self.txn.pinned)
        if self.txn.mode is Mode.WRITE:
            self._flush()
            for add, x in self._changes:
                now = st.register(now, x) if add else st.remove_pattern(now, **x) if isinstance(x, dict) else st.delete(now, x)
        return now

    # -- quads
    def compact(self) -> None:
        """The same quads in one folder, as a generation of its own."""
        with self.txn.within(Mode.WRITE):
            if self._changes or self._buffer:
                raise TxnError("a transaction that has changed quads cannot compact them")
            self.snapshots.compact(self.txn.pinned)

    def vacuum(self, keep: int = 1, older_than: float = 24 * 3600) -> int:
        """Remove old generations and what no kept one names; see Snapshots.vacuum."""
        return self.snapshots.vacuum(keep, older_than)

    def quads(self) -> DataFrame:
        """All quads, as this transaction sees them."""
        with self.txn.within(Mode.READ):
            return self._seen()

    def add(self, g: str | None, s: str, p: str, o: str) -> None:
        with self.txn.within(Mode.WRITE):
            row = (pt.graph_name(g or DEFAULT_GRAPH), s, p, o)
            self._buffer.pop(row, None)
            self._buffer[row] = True

    def delete(self, g: str | None, s: str, p: str, o: str) -> None:
        with self.txn.within(Mode.WRITE):
            row = (pt.graph_name(g or DEFAULT_GRAPH), s, p, o)
            self._buffer.pop(row, None)
            self._buffer[row] = False

    def add_all(self, quads: DataFrame) -> None:
        with self.txn.within(Mode.WRITE):
            self._flush()
            self._changes.append((True, quads))

    def delete_all(self, quads: DataFrame) -> None:
        with self.txn.within(Mode.WRITE):
            self._flush()
            self._changes.append((False, quads))

    def remove(self, g=None, s=None, p=None, o=None) -> None:
        """Delete all quads that match. The pattern is committed, not the quads."""
        with self.txn.within(Mode.WRITE):
            self._flush()
            bound = {"g": pt.graph_name(g), "s": s, "p": p, "o": o}
            self._changes.append((False, {c: x for c, x in bound.items() if x is not None}))

    def clear(self, g: str) -> None:
        self.remove(g=g)

    def add_to_default_graph(self, s: str, p: str, o: str) -> None:
        self.add(DEFAULT_GRAPH, s, p, o)

    def add_to_named_graph(self, g: str, s: str, p: str, o: str) -> None:
        self.add(g, s, p, o)

    def delete_from_default_graph(self, s: str, p: str, o: str) -> None:
        self.delete(DEFAULT_GRAPH, s, p, o)

    def delete_from_named_graph(self, g: str, s: str, p: str, o: str) -> None:
        self.delete(g, s, p, o)

    def add_graph(self, g: str, triples: DataFrame) -> None:
        """Add a whole graph (s, p, o) under this name to what the graph holds."""
        self.add_all(triples.select(F.lit(pt.graph_name(g)).alias("g"), "s", "p", "o"))

    def set_graph(self, g: str, triples: DataFrame) -> None:
        """The graph of this name holds these triples and no others."""
        with self.txn.within(Mode.WRITE):
            self.remove(g=g)
            self.add_graph(g, triples)

    def remove_graph(self, g: str) -> None:
        self.remove(g=g)

    def contains_graph(self, g: str) -> bool:
        """Whether a graph has triples; the default graph is always there."""
        return pt.graph_name(g) == DEFAULT_GRAPH or self.contains(g=g)

    def find(self, g=None, s=None, p=None, o=None) -> DataFrame:
        return pt.find(self.quads(), g, s, p, o)

    def find_in_default_graph(self, s=None, p=None, o=None) -> DataFrame:
        return pt.find_default(self.quads(), s, p, o)

    def find_in_named_graph(self, g: str, s=None, p=None, o=None) -> DataFrame:
        return pt.find_named(self.quads(), g, s, p, o)

    def find_in_any_named_graph(self, s=None, p=None, o=None) -> DataFrame:
        return pt.find_any_named(self.quads(), s, p, o)

    def contains(self, g=None, s=None, p=None, o=None) -> bool:
        return pt.contains(self.quads(), g, s, p, o)

    def is_empty(self) -> bool:
        return not self.contains()

    def size(self) -> int:
        return self.quads().count()

    def graph_nodes(self) -> DataFrame:
        return pt.list_graphs(self.quads())

    def nodes(self, position: str) -> DataFrame:
        return pt.list_nodes(self.quads(), position)

    # -- views
    def default_graph(self) -> "Graph":
        return Graph(self, DEFAULT_GRAPH)

    def graph(self, name: str) -> "Graph":
        """A view of a graph; all names of the default graph give that one."""
        return Graph(self, pt.graph_name(name))

    def union_graph(self) -> DataFrame:
        return pt.union_graph(self.quads())

    # -- prefixes, which are no part of transactions
    def set_prefix(self, prefix: str, iri: str) -> None:
        self._prefixes[prefix] = iri

    def prefixes(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._prefixes.items()), "prefix string, iri string")

    def expand(self, name: str) -> str:
        """A prefixed name as an IRI term."""
        prefix, _, local = name.partition(":")
        return f"<{self._prefixes[prefix]}{local}>"


class Graph:
    """The triples of one graph of a dataset."""

    def __init__(self, dataset: Dataset, name: str = DEFAULT_GRAPH):
        self.dataset, self.name = dataset, name

    def find(self, s=None, p=None, o=None) -> DataFrame:
        return pt.as_triples(pt.find(self.dataset.quads(), self.name, s, p, o))

    def contains(self, s=None, p=None, o=None) -> bool:
        return self.dataset.contains(self.name, s, p, o)

    def size(self) -> int:
        """Triples of this graph, 2 ** 31 - 1 at most."""
        return min(self.find().count(), 2**31 - 1)

    def add(self, s: str, p: str, o: str) -> None:
        self.dataset.add(self.name, s, p, o)

    def delete(self, s: str, p: str, o: str) -> None:
        self.dataset.delete(self.name, s, p, o)

    def add_all(self, triples: DataFrame) -> None:
        self.dataset.add_all(triples.select(F.lit(self.name).alias("g"), "s", "p", "o"))

    def remove(self, s=None, p=None, o=None) -> None:
        self.dataset.remove(self.name, s, p, o)

    def clear(self) -> None:
        self.dataset.clear(self.name)

    def begin(self) -> None:
        """A graph's transactions write."""
        self.dataset.begin(Type.WRITE)

    def commit(self) -> None:
        self.dataset.commit()

    def abort(self) -> None:
        self.dataset.abort()
