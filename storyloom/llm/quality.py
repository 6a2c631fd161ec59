"""Quality classifier: a sparse ensemble of rules over text statistics.

One pass in numpy measures every text. A random forest of shallow trees is grown on labelled statistics; every
path from a root to a node is a conjunctive rule; a logistic regression with an L1 penalty keeps the rules that
count. The kept rules are compiled into one Spark column expression, so scoring is a projection without Python.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import map_texts, utf8

#: Distinct (label, statistics) rows that a fit uses, about: those with the smallest hash. A documented bound of the fit.
SAMPLE = 50_000
TREES, DEPTH = 24, 3
PENALTY = 1e-3
THRESHOLD = 0.3
SEED = 7
#: Bytes of a text that are in arrays at once, more if a single word is longer.
_WINDOW = 1 << 20

STATISTICS = (
    "bytes", "words", "lines", "word_bytes", "upper", "letters", "digits", "spaces", "symbols", "exclaims", "stops", "wide",
    "repeated_words", "short_words", "odd_words", "words_per_line",
)
_UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL, _EXCLAIM, _STOP, _WIDE, _LINE = range(9)


def _classes() -> np.ndarray:
    """For each byte value, which classes it is of: one row of zeros and ones a class."""
    of = np.zeros((9, 256), np.uint8)
    of[_UPPER, 65:91] = 1
    of[_LETTER, 65:91] = of[_LETTER, 97:123] = 1
    of[_DIGIT, 48:58] = 1
    of[_SPACE, [32, *range(9, 14)]] = 1
    of[_SYMBOL, [ord(c) for c in "#$%&*|<>=^~\\_@+/{}[]"]] = 1
    of[_EXCLAIM, [ord(c) for c in "!?"]] = 1
    of[_STOP, [ord(c) for c in ".,;:"]] = 1
    of[_WIDE, 128:] = 1
    of[_LINE, 10] = 1
    return of


def _windows(data: np.ndarray, space: np.ndarray, offsets: np.ndarray):
    """(first row, offsets from the window's start, window) of whole texts, or of parts of a long text cut after white space."""
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _WINDOW, side="right")) - 1)
        at, end = int(offsets[row]), int(offsets[stop])
        if stop > row + 1 or end - at <= _WINDOW:
            yield row, offsets[row : stop + 1] - at, data[at:end], False
        else:
            begin = at
            while begin < end:
                cut = end
                if end - begin > _WINDOW:
                    ahead = np.flatnonzero(space[begin + _WINDOW - 1 : end][: _WINDOW])
                    cut = begin + _WINDOW + int(ahead[0]) if len(ahead) else min(end, begin + 2 * _WINDOW)
                yield row, np.array([0, cut - begin]), data[begin:cut], begin > at
                begin = cut
        row = stop


class Measurer:
    """Statistics of a batch of texts, by byte classes and word hashes."""

    def __init__(self):
        self.of = _classes()
        self.powers = np.zeros(0, np.uint64)

    def _word_hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A polynomial hash of each word, from prefix sums: equal words have equal hashes wherever they stand."""
        if len(self.powers) < len(data):
            # Odd base, so its powers have inverses modulo 2^64.
            base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
            self.powers, self.inverses = np.full(len(data) + 1, base, np.uint64), np.full(len(data) + 1, inverse, np.uint64)
            for factors in (self.powers, self.inverses):
                factors[0] = 1
                np.multiply.accumulate(factors, out=factors)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])])
        return (total[end] - total[start]) * self.inverses[start]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Per text: the byte classes, then words, repeated, short and odd words."""
        data, offsets = utf8(texts)
        space = self.of[_SPACE][data].view(bool)
        found = np.zeros((len(texts), 13), np.int64)
        last = None
        for row, edges, part, more in _windows(data, space, offsets):
            if not len(part):
                continue
            n = len(edges) - 1
            sums = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[edges])
            for c in range(9):
                found[row : row + n, c] += sums(self.of[c][part])
            blank = self.of[_SPACE][part].view(bool)
            inner = np.zeros(len(part), bool)
            inner[1:] = ~blank[1:] & ~blank[:-1]
            begins = edges[:-1][edges[:-1] < len(part)]
            inner[begins] = False
            start = np.flatnonzero(~blank & ~inner)
            # A word ends at white space, at the end of its text, or at the end of the window.
            stop = np.zeros(len(part) + 1, bool)
            stop[1:-1] = blank[1:] & ~blank[:-1]
            stop[edges[1:]] |= ~blank[edges[1:] - 1] & (edges[1:] > 0)
            end = np.flatnonzero(stop)
            of_row = np.searchsorted(edges, start, side="right") - 1
            hashes = self._word_hashes(part, start, end)
            again = np.zeros(len(start), bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (of_row[1:] == of_row[:-1])
            if more and len(start) and last is not None:
                again[0] = hashes[0] == last
            if len(hashes):
                last = hashes[-1]
            elif not more:
                last = None
            symbols = np.concatenate([[0], np.cumsum(self.of[_SYMBOL][part] | self.of[_EXCLAIM][part], dtype=np.int64)])
            odd = symbols[end] > symbols[start]
            for c, marks in enumerate((np.ones(len(start), bool), again, end - start <= 3, odd), 9):
                found[row : row + n, c] += np.bincount(of_row[marks], minlength=n)
        return found

    def statistics(self, texts: pa.Array) -> np.ndarray:
        size = np.diff(utf8(texts)[1])
        c = self.counts(texts)
        words, lines = c[:, 9], c[:, _LINE] + 1
        share = lambda n, of: n / np.maximum(of, 1)
        columns = [
            size, words, lines, share(size - c[:, _SPACE], words), share(c[:, _UPPER], c[:, _LETTER]), share(c[:, _LETTER], size), share(c[:, _DIGIT], size), share(c[:, _SPACE], size),
            share(c[:, _SYMBOL], size), share(c[:, _EXCLAIM], size), share(c[:, _STOP], size), share(c[:, _WIDE], size),
            share(c[:, 10], words), share(c[:, 11], words), share(c[:, 12], words), share(words, lines),
        ]
        return np.stack(columns, 1).astype(np.float64)


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``stats``, an array of ``STATISTICS``, of every row; a null text counts as an empty one."""

    def worker():
        measure = Measurer()

        def run(texts, _):
            values = measure.statistics(texts)
            offsets = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))]

        return run

    return map_texts(docs, keep, text, [("stats", T.ArrayType(T.DoubleType()))], worker)


#: A rule: (statistic, greater than or None, at most or None), ... all of which hold.
Rule = tuple[tuple[int, float | None, float | None], ...]


def path_rules(tree: str) -> set[Rule]:
    """The rules of all nodes below the root, from the text that Spark prints of a tree."""
    rules, path = set(), []
    for line in tree.splitlines():
        test = re.match(r"( +)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not test:
            continue
        # A branch stands one space deeper than the branch above it.
        del path[len(test[1]) - 2 :]
        path.append((int(test[2]), test[3], float(test[4])))
        held = {}
        for feature, side, value in path:
            above, upto = held.get(feature, (None, None))
            held[feature] = (above, value if upto is None else min(upto, value)) if side == "<=" else (value if above is None else max(above, value), upto)
        rules.add(tuple((f, *held[f]) for f in sorted(held)))
    return rules


def rule_column(rule: Rule, stats: str = "stats") -> Column:
    """The rule as a Spark condition over the array of statistics."""
    tests = []
    for feature, above, upto in rule:
        value = F.col(stats)[feature]
        tests += ([value > above] if above is not None else []) + ([value <= upto] if upto is not None else [])
    held = tests[0]
    for t in tests[1:]:
        held = held & t
    return held


@dataclasses.dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules and a bias: the log-odds of quality 1."""

    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def column(self, stats: str = "stats") -> Column:
        """The probability of quality 1 as a column expression."""
        terms = [F.when(rule_column(rule, stats), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        terms.append(F.lit(self.bias))
        while len(terms) > 1:  # a balanced sum, which keeps the expression shallow
            terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + ([terms[-1]] if len(terms) % 2 else [])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))

    def describe(self) -> list[str]:
        """One line a rule, the heaviest first."""
        lines = []
        for rule, weight in sorted(self.rules, key=lambda r: (-abs(r[1]), str(r[0]))):
            parts = [f"{STATISTICS[f]}{'' if a is None else f' > {a:.4g}'}{'' if b is None else f' <= {b:.4g}'}" for f, a, b in rule]
            lines.append(f"{weight:+.3f} if {' and '.join(parts)}")
        return lines


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Fit on rows ``stats``, ``label`` (0 or 1) and ``weight``.

    Equal rows count as one of their summed weight; of those about ``sample`` are used, the ones with the smallest
    hash. With one class only there is no rule and the score is a smoothed share; without rows it is one half.
    """
    rows = labelled.where("label in (0, 1) and weight > 0").groupBy("label", "stats").agg(F.sum("weight").cast("double").alias("weight"))
    rows = materialize(rows.select(F.col("label").cast("double").alias("label"), "stats", "weight"), "labelled")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("ones"), F.sum(F.col("weight") * (1 - F.col("label"))).alias("zeros")).first()
    ones, zeros = size.ones or 0.0, size.zeros or 0.0
    constant = RuleEnsemble((), float(np.log((ones + 1) / (zeros + 1))))
    if not ones or not zeros:
        return constant
    if size.n > sample:
        rows = rows.where(F.xxhash64("label", "stats") <= int(sample / size.n * (1 << 64)) - (1 << 63))
    # The bound keeps this in a few tasks, whatever the corpus.
    rows = rows.repartition(4, F.xxhash64("label", "stats")).sortWithinPartitions("label", "stats")
    rows = materialize(rows, "sample")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, seed=SEED)
    grown = forest.fit(rows.select("label", "weight", array_to_vector("stats").alias("features")))
    rules = sorted(set().union(*(path_rules(t.toDebugString) for t in grown.trees)), key=str)
    if not rules:
        return constant
    held = F.array(*[rule_column(r).cast("double") for r in rules])
    lasso = LogisticRegression(featuresCol="held", labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-5)
    fitted = lasso.fit(rows.select("label", "weight", array_to_vector(held).alias("held")))
    weights = fitted.coefficients.toArray()
    return RuleEnsemble(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(fitted.intercept))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (probability of quality 1) and ``predicted`` of every row.

    ``held_out`` is a condition on the id; labels of such rows are not learnt from. An id's labels are counted
    first, so one labelled twice weighs both and a hot id never multiplies rows; labels other than 0 and 1, and
    rows with a null id, teach nothing. A null text counts as an empty one. Repeated rows give repeated results;
    other columns are not read. See ``train`` for tables without labels or with one class.
    """
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(held_out, F.lit(False)).alias("__held"), F.col(text).alias("__source"))
    stats = materialize(text_statistics(rows, ["__id", "__held"], "__source"), "statistics")
    marks = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label in (0, 1)")
    marks = marks.groupBy("__id", "label").agg(F.count("*").cast("double").alias("weight"))
    learnt = stats.where("not __held").join(marks, "__id").select("stats", "label", "weight")
    model = train(learnt, **fit)
    score = model.column()
    return stats.select(F.col("__id").alias(doc_id), F.col("__held").alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).alias("predicted"))
