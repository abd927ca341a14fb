"""Basic graph patterns and the algebra around them; an extension.

A pattern is (g, s, p, o) of terms, None, and variables like ``?x``. Solutions are DataFrames with a
column for each variable; joins are on shared variables, so Catalyst chooses order and strategy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadspark.operators.pattern import POSITIONS, condition

Pattern = tuple[str | None, str | None, str | None, str | None]


def is_variable(x: str | None) -> bool:
    return isinstance(x, str) and x.startswith("?")


def solutions(quads: DataFrame, pattern: Pattern) -> DataFrame:
    """The bindings of one pattern, each once; a variable in two positions binds equal terms. Quads
    are a set, so only wildcards can make bindings repeat, and only then they are made distinct."""
    bound = {c: (None if is_variable(x) else x) for c, x in zip(POSITIONS, pattern)}
    rows = quads.where(condition(**bound))
    at: dict[str, str] = {}
    for c, x in zip(POSITIONS, pattern):
        if is_variable(x):
            if x in at:
                rows = rows.where(F.col(c) == F.col(at[x]))
            at.setdefault(x, c)
    found = rows.select(*[F.col(c).alias(x[1:]) for x, c in at.items()])
    return found.distinct() if None in pattern else found


def join(left: DataFrame, right: DataFrame, how: str = "inner", unbound: Sequence[str] = ()) -> DataFrame:
    """On shared variables; without any, all combinations, which are the result then. ``unbound`` names
    variables that OPTIONAL or UNION may have left null: null agrees with everything, and takes the other
    side's value. Each way in which these are bound is a join on equal terms of its own."""
    shared = [c for c in left.columns if c in right.columns]
    loose = [c for c in shared if c in unbound]
    if not loose:
        return left.join(right, shared, how) if shared else left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    cases = []
    for case in product(("both", "left", "right"), repeat=len(loose)):
        l, r = left, right
        for c, known in zip(loose, case):
            l = l.where(F.col(c).isNull() if known == "right" else F.col(c).isNotNull())
            r = r.where(F.col(c).isNull()) if known == "left" else r.where(F.col(c).isNotNull()) if known == "both" else r
        l = l.drop(*[c for c, known in zip(loose, case) if known == "right"])
        r = r.drop(*[c for c, known in zip(loose, case) if known == "left"])
        cases.append(join(l, r).select(*left.columns, *[c for c in right.columns if c not in shared]))
    both = reduce(DataFrame.unionByName, cases)
    if how == "inner":
        return both
    # a row of ``left`` without a partner stays; which have one is asked with the row as it was
    own = left.withColumns({f"_was_{c}": F.col(c) for c in left.columns})
    had = join(own, right, "inner", unbound).select(*[F.col(f"_was_{c}").alias(c) for c in left.columns]).distinct()
    same = reduce(Column.__and__, [left[c].eqNullSafe(had[c]) for c in left.columns])
    return both.unionByName(left.join(had, same, "left_anti"), allowMissingColumns=True)


def connected(patterns: list[Pattern]) -> list[Pattern]:
    """The patterns in an order in which each shares a variable with those before, where there is one:
    the first stays first, and of those that can follow the one with the most terms and shared variables."""
    left, out = list(patterns), []
    seen: set[str] = set()

    def worth(p: Pattern) -> tuple[bool, int]:
        own = set(filter(is_variable, p))
        return bool(own & seen), len(own & seen) + sum(x is not None and not is_variable(x) for x in p)

    while left:
        best = max(left, key=worth) if out else left[0]
        left.remove(best)
        out.append(best)
        seen |= set(filter(is_variable, best))
    return out


def bgp(quads: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The bindings that satisfy all patterns; patterns without a common variable make all combinations
    only if no other pattern connects them."""
    return reduce(join, [solutions(quads, p) for p in connected(patterns)])


def optional(left: DataFrame, right: DataFrame, unbound: Sequence[str] = ()) -> DataFrame:
    return join(left, right, "left", unbound)


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Without solutions that agree with one of ``right``; nothing goes if no variable is shared."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "left_anti") if shared else left


def having(rows: DataFrame, test: Column) -> DataFrame:
    return rows.where(test)


def counted(rows: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))
