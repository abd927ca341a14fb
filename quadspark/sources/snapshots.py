"""Generations of a quad store as immutable Parquet folders and a log of commits.

``log/N`` names generation N's folders in their order: added quads, and deleted ones. A deleting folder
takes its quads from those added before it, by an anti-join at reading, so a commit writes what it
changes and nothing else. Quads deleted by a pattern are not written: the log has the pattern, and what
was added before it is filtered at reading. A commit publishes a whole file under its name or fails: a crash at any moment
leaves the old generation, and a writer that lost the race gets a Conflict. An entry that can't be read
(cut by a full disk, say) counts as absent and is put aside by the next commit. ``compact`` rewrites a
generation as one folder, ``vacuum`` removes what no kept generation names. Folders are sorted by
predicate, so that Parquet's statistics prune patterns.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadspark.operators.pattern import POSITIONS, condition

SCHEMA = "g string, s string, p string, o string"

#: The terms of a pattern's bound positions.
Pattern = dict[str, str]
#: A folder's kind ("add" or "del") and its path below the store, or "pat" and a pattern whose quads go.
Entry = tuple[str, str | Pattern]


class Conflict(Exception):
    """Another writer has committed this generation."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._known: dict[int, list[Entry]] = {0: []}

    # -- the log
    def _log(self) -> list[int]:
        """Numbers of all entries, readable or not, the newest first."""
        log = self._path(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        return sorted((int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(log)) if n.isdigit()), reverse=True)

    def _entry(self, name: str) -> list[Entry] | None:
        """The folders of an entry; None if there is none, or none that can be read."""
        at = self._path(f"{self.path}/log/{name}")
        try:
            stream = self._fs.open(at)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            return [(kind, path) for kind, path in json.loads(text)["folders"]]
        except Exception as e:
            if self._fs.exists(at) and not isinstance(e, (ValueError, KeyError, TypeError)) and "Checksum" not in str(e):
                raise
            return None

    def generation(self) -> int:
        """The newest generation; 0 for a new store."""
        return next((n for n in self._log() if n in self._known or self._folders(n, None) is not None), 0)

    def _folders(self, generation: int, missing: str | None = "no generation {}") -> list[Entry] | None:
        if generation not in self._known:
            found = self._entry(str(generation))
            if found is None:
                if missing is None:
                    return None
                raise FileNotFoundError(missing.format(generation))
            self._known[generation] = found
        return self._known[generation]

    def _publish(self, generation: int, folders: list[Entry]) -> None:
        """Give a written file its name, which nothing had before: one atomic step."""
        name, own = str(generation), f"new-{uuid.uuid4().hex}"
        temporary, to = self._path(f"{self.path}/log/{own}"), self._path(f"{self.path}/log/{name}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        if self._fs.exists(to) and self._entry(name) is None:
            aside = self._path(f"{self.path}/log/unreadable-{name}-{uuid.uuid4().hex}")
            self._fs.rename(to, aside)
            if self._entry(aside.getName()) is not None:  # another writer has replaced it meanwhile
                self._named(aside, to)
        try:
            taken = not self._named(temporary, to)
        finally:
            self._fs.delete(temporary, False)
        if taken:
            raise Conflict(f"generation {generation} exists")
        self._known[generation] = folders

    def _named(self, source, to) -> bool:
        """Rename without overwriting; False if the name is taken. A local rename would overwrite, so
        there the file gets a second name, a link, and loses the first."""
        if self._fs.getUri().getScheme() == "file":
            files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
            try:
                files.createLink(*(paths.get(self._fs.makeQualified(x).toUri()) for x in (to, source)))
            except Exception:
                if self._fs.exists(to):
                    return False
                raise
            self._fs.delete(source, False)
            return True
        return self._fs.rename(source, to)

    # -- quads
    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self, generation: int | None = None) -> DataFrame:
        """The quads of a generation, the newest by default: what was added after the last deleting folder
        is scanned as it is, the rest anti-joined once, with the deletions that came later. Patterns are
        filters on the scans of what was added before them."""
        folders = self._folders(self.generation() if generation is None else generation)
        runs = [(kind, [what for _, what in own]) for kind, own in groupby(folders, key=lambda f: f[0])]
        last = max((n for n, (kind, _) in enumerate(runs) if kind == "del"), default=-1)

        def added(n: int) -> DataFrame:
            later = [~condition(**x) for kind, own in runs[n:] if kind == "pat" for x in own]
            return reduce(DataFrame.where, later, self._scan(runs[n][1]))

        rows = [added(n) for n, (kind, _) in enumerate(runs) if kind == "add" and n > last]
        old = [added(n).withColumn("_at", F.lit(n)) for n, (kind, _) in enumerate(runs) if kind == "add" and n < last]
        gone = [self._scan(paths).withColumn("_from", F.lit(n)) for n, (kind, paths) in enumerate(runs) if kind == "del"]
        if old:
            latest = reduce(DataFrame.unionByName, gone).groupBy(*POSITIONS).agg(F.max("_from").alias("_from"))
            same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"d.{c}") for c in POSITIONS])
            was = reduce(DataFrame.unionByName, old).alias("a")
            rows.append(was.join(latest.alias("d"), same & (F.col("d._from") > F.col("a._at")), "left_anti").select(*POSITIONS))
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], SCHEMA)

    def _write(self, quads: DataFrame, repeated: bool = False) -> str:
        name = f"data/{uuid.uuid4().hex}"
        # the number of parts is left to the planner, so that small changes make few files
        parts = quads.select(*POSITIONS).repartitionByRange("p", "s")
        if repeated:  # equal quads are in one part, so they are found without another shuffle
            parts = parts.dropDuplicates(POSITIONS)
        parts.sortWithinPartitions("p", "s", "o").write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, quads: DataFrame | None, since: int, appended: bool = False, deleted: DataFrame | None = None, patterns: Iterable[Pattern] = (), repeated: bool = False) -> int:
        """Publish the generation after ``since``: ``quads`` in its place, or ``appended`` to it, which
        it must not hold, after those of ``patterns`` and ``deleted`` are gone from it. Quads that may be
        ``repeated`` are written once."""
        folders = list(self._folders(since)) if appended else []
        if folders:
            folders += [("pat", x) for x in patterns]
        if deleted is not None and folders:
            folders.append(("del", self._write(deleted)))
        if quads is not None:
            folders.append(("add", self._write(quads, repeated)))
        self._publish(since + 1, folders)
        return since + 1

    def size(self, generation: int | None = None) -> int:
        return self.read(generation).agg(F.count("*")).first()[0]

    # -- upkeep
    def folders(self, generation: int | None = None) -> int:
        """How many folders a generation is made of."""
        return len(self._folders(self.generation() if generation is None else generation))

    def compact(self, since: int | None = None) -> int:
        """The same quads as one folder, as the next generation."""
        since = self.generation() if since is None else since
        return self.commit(self.read(since), since)

    def vacuum(self, keep: int = 1, older_than: float = 24 * 3600) -> int:
        """Remove all generations but the newest ``keep``, and folders that none of these names and that
        are older than so many seconds, which no writer can be about to commit; how many folders went.
        Readers of removed generations fail."""
        readable = [n for n in self._log() if self._folders(n, None) is not None]
        named = {path for n in readable[: max(1, keep)] for kind, path in self._folders(n) if kind != "pat"}
        for n in readable[max(1, keep) :]:
            self._fs.delete(self._path(f"{self.path}/log/{n}"), False)
            self._known.pop(n, None)
        before, went = (time.time() - older_than) * 1000, 0
        data = self._path(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in named and s.getModificationTime() <= before:
                went += self._fs.delete(s.getPath(), True)
        self._known.setdefault(0, [])
        return went
