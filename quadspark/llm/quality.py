"""Quality rules: text statistics, and a decision list learned from labelled ones.

The statistics are one pass over the texts. The list is learned by sequential covering on a bounded
sample of labelled rows: a rule (a conjunction of thresholds) is grown on two thirds of what is left
by FOIL's gain, pruned on the other third, taken while it is precise there, and what it covers is
removed. The result is an ordered Spark conditional expression over the statistics' columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadspark.llm.shared import carried, raw_texts, restored, sliced

#: Labelled rows that the rules are learned from at most.
MAX_LABELLED = 20_000
WINDOW = 8
#: Bytes of text whose statistics are taken together.
BLOCK = 1 << 20


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


#: Fixed values of the statistics: white space, symbols.
SPACE = _bytes_in(b" \t\n\v\f\r")
SYMBOLS = _bytes_in(b"#*$%&|<>")
CODE_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)
COUNTED = {
    "n_symbols": SYMBOLS,
    "n_upper": _bytes_in(bytes(range(65, 91))),
    "n_lower": _bytes_in(bytes(range(97, 123))),
    "n_digits": _bytes_in(b"0123456789"),
    "n_marks": _bytes_in(b"!?"),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks"]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:ends[i]]."""
    out = np.zeros(len(starts), np.int64)
    some = ends > starts
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], dtype=np.int64)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def repeated_words(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """By document, the words that stand in windows found twice or more in that document. ``words``
    are 64-bit hashes, those of document i at starts[i]:ends[i]."""
    n = len(words) - width + 1
    out = np.zeros(len(starts), np.int64)
    if n <= 0:
        return out
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    mixed = _mixed(words)
    key = _mixed(doc[at].astype(np.uint64) + np.uint64(1))
    for i in range(width):
        key = _mixed(key + mixed[at + i])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return out + np.bincount(doc[covered], minlength=len(starts))


def text_stats(raws: list[bytes]) -> list[np.ndarray]:
    """Arrays in the order of STATS for these UTF-8 texts."""
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    ends = np.cumsum(size)
    starts = ends - size
    buf = np.frombuffer(b"".join(raws), np.uint8)
    got = {name: _sums(table[buf], starts, ends) for name, table in COUNTED.items()}
    got["word_chars"] = _sums(CODE_POINT[buf], starts, ends) - _sums(SPACE[buf], starts, ends)
    words = [r.split() for r in raws]
    n = np.fromiter(map(len, words), np.int64, len(raws))
    hashes = np.fromiter(map(hash, chain.from_iterable(words)), np.int64, int(n.sum())).view(np.uint64)
    last = np.cumsum(n)
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raws]
    got["n_words"] = n
    got["n_lines"] = np.fromiter(map(len, lines), np.int64, len(raws))
    got["n_dup_lines"] = got["n_lines"] - np.fromiter((len(set(x)) for x in lines), np.int64, len(raws))
    got["n_distinct_words"] = np.fromiter((len(set(w)) for w in words), np.int64, len(raws))
    got["n_repeat_words"] = repeated_words(hashes, last - n, last)
    return [got[name] for name in STATS]


def blocks(raws: list[bytes], most: int = BLOCK):
    """The texts in runs of about ``most`` bytes; a longer text is a run of its own."""
    run: list[bytes] = []
    size = 0
    for r in raws:
        if run and size + len(r) > most:
            yield run
            run, size = [], 0
        run.append(r)
        size += len(r)
    if run:
        yield run


def with_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and the columns STATS, by one pass without a shuffle.

    Null and empty texts have no words: all statistics 0. A column of the input that is named like
    a statistic is replaced if it is not among ``keep``; naming it there is an error.
    """
    keep = [c for c in docs.columns if c not in STATS] if keep is None else keep
    if clash := set(keep) & set(STATS):
        raise ValueError(f"columns named like statistics: {sorted(clash)}")
    own, fields = carried(docs, keep, text_col)
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in STATS)])

    def run(batches):
        for b in sliced(batches, 1024):
            parts = [text_stats(r) for r in blocks(raw_texts(b, keep, text_col))]
            cols = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(STATS)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in cols)], names=out.names)

    return restored(own.mapInArrow(run, out), keep)


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def features() -> dict[str, Column]:
    """What the rules can test, from the statistics."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "upper_share": F.col("n_upper") / letters,
        "digits_per_word": F.col("n_digits") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "word_length": F.col("word_chars") / words,
        "words_per_line": F.col("n_words") / lines,
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = features()[self.feature]
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def _cuts(v: np.ndarray, most: int = 64) -> np.ndarray:
    u = np.unique(v)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most)))


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    """Add the condition of the highest gain until the rule covers no good row."""
    rule: Rule = ()
    hit = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int(bad[hit].sum()), int((~bad)[hit].sum())
        if not p0 or not n0:
            break
        best, most_gain = None, 1e-9
        for name in x:
            for t in _cuts(x[name][hit]):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    h = hit & c.holds(x)
                    p, n = int(bad[h].sum()), int((~bad)[h].sum())
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0
                    if gain > most_gain:
                        best, most_gain = c, gain
        if best is None:
            break
        rule, hit = (*rule, best), hit & best.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The rule without those last conditions whose loss raises its worth on these rows, and how
    many bad and good rows it covers there."""
    best = (-2.0, rule, 0, 0)
    for k in range(len(rule), 0, -1):
        h = covers(rule[:k], x, len(bad))
        p, n = int(bad[h].sum()), int((~bad)[h].sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p, n)
    return best[1:]


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 5, most: int = 24) -> list[Rule]:
    """An ordered list of rules for rejection. ``least``: bad rows that a rule covers in all; a
    rule under ``precision`` on the pruning rows ends the list. Without labelled rows of both kinds
    there are no rules."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    while len(rules) < most:
        part = {k: v[left] for k, v in x.items()}
        b = bad[left]
        if b.sum() < least or b.all():
            break
        test = np.arange(len(left)) % 3 == 0
        own, other = ({k: v[m] for k, v in part.items()} for m in (~test, test))
        rule = grow(own, b[~test])
        if not rule:
            break
        rule, p, n = prune(rule, other, b[test])
        hit = covers(rule, part, len(b))
        if p + n == 0 or p < precision * (p + n) or b[hit].sum() < max(least, precision * hit.sum()):
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, **options) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality: 0 is bad) of ``docs``. At most ``most`` labelled documents,
    those of the smallest hashes, are used. Null labels are left out; no labels give no rules. Of several
    labels of a document the largest holds; of rows that share a doc_id those of the smallest statistics."""
    spark = docs.sparkSession
    each = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    # about twice as many as needed pass the cut, so that tasks have few to rank
    n, place = each.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = each.where(place <= int(2 * most / max(1, n) * (1 << 40))) if n > 2 * most else each
    chosen = near.orderBy(place, "doc_id").limit(most).select("doc_id", (F.col("quality") == 0).cast("int").alias("_bad"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = with_stats(own, keep=["doc_id", "_bad"]).where(~base_failed())
    rows = rows.select("doc_id", "_bad", *[c.alias(f"f_{n}") for n, c in features().items()])
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*rows.columns[1:])).alias("_r")).select("_r.*").toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(list(rows.columns), kind="stable").reset_index(drop=True)
    return learn_rules({n: rows[f"f_{n}"].to_numpy(float) for n in features()}, rows["_bad"].to_numpy() == 1, **options)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over statistics: true keeps."""
    kept = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        kept = kept.when(test, F.lit(False))
    return kept.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], **options) -> DataFrame:
    """``keep`` columns of every document with STATS, base_failed and kept."""
    rules = fit_rules(docs, labels, **options)
    return with_stats(docs, keep=keep).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))
