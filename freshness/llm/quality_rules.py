"""Quality rules: text statistics and a decision list learned from labelled ones.

`text_statistics` measures whole texts. `learn_rules` grows and prunes
conjunctions of thresholds by sequential covering: a condition is added while it
gains information on the grow rows, trailing conditions are dropped while that helps on the
prune rows, covered rows leave, and the next rule is sought. The list becomes one
ordered Spark conditional expression.

Edge cases: null and empty texts have zero statistics; no labels, or labels of
one kind, give an empty list, which keeps every document; repeated labels count each; other
columns are kept, and a column named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshness.llm.text import distinct, hashed, labelled_texts, raw, with_fields

WINDOW = 5
MAX_LABELLED = 20_000  # label rows that the list is learned from
_BLANKS = bytes([9, 10, 11, 12, 13, 32])
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_MARKS = b"!?"
_DIGITS = b"0123456789"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct"]

# ratios that rules may test, as functions of the counts
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "digits_per_char": ("n_digits", "word_chars"),
    "upper_per_letter": ("n_upper", "n_letters"),
    "repeated_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
}


def repeated_words(words: int, windows: np.ndarray, width: int = WINDOW) -> int:
    """Words inside any window of `width` words that occurs twice or more, given the windows' hashes."""
    if len(distinct(windows)) == len(windows):
        return 0
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    edges = np.zeros(words + 1, np.int64)
    edges[: len(windows)] += again
    edges[width : width + len(windows)] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure_all(texts: list[bytes]) -> Iterator[tuple[int, ...]]:
    """The counts of each text, in the order of `COUNTS`."""
    for text, (words, windows) in zip(texts, hashed(texts, WINDOW)):
        lines = [line for line in text.split(b"\n") if line.strip()]
        size = len(text)
        left = lambda drop: size - len(text.translate(None, drop))  # noqa: E731, B023
        yield (
            len(words), len(text.translate(None, _BLANKS + _CONTINUATION)), left(_SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(len(words), windows), len(lines), left(_UPPER), left(_LETTERS), left(_MARKS), left(_DIGITS), len(distinct(words)),
        )


def statistics_of(texts: pa.Array) -> pa.Array:
    rows = list(measure_all(raw(texts)))
    columns = zip(*rows) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=COUNTS)


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` plus the columns of `COUNTS`."""
    return with_fields(docs, F.arrow_udf(statistics_of, ", ".join(f"{c} long" for c in COUNTS))(F.col(text_col).cast("string")), COUNTS)


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    """Too few words, or too many inside repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def feature(name: str) -> Column:
    """A ratio as a column; 0 where its divisor is 0."""
    over, under = FEATURES[name]
    value = F.col(over).cast("double")
    return value if under is None else F.when(F.col(under) > 0, value / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def mask(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.threshold if self.above else data[self.feature] < self.threshold

    def column(self) -> Column:
        value = feature(self.feature)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int = 0
    precision: float = 0.0

    def mask(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.mask(data) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects the document, and a document that none covers is kept."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def rule_number(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def keeps(self) -> Column:
        return self.rule_number() == 0

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, r.conditions))}  ({r.covered} rows, {r.precision:.3f} bad)" for r in self.rules)


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds midway between distinct values, at quantiles if there are many."""
    distinct = np.unique(values)
    if len(distinct) > most:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, most), method="nearest"))
        distinct = np.unique(np.concatenate((distinct, np.unique(values)[-8:])))
    return (distinct[1:] + distinct[:-1]) / 2


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Conditions added by information gain until no good row is covered or nothing gains."""
    rows = np.ones(len(bad), bool)
    conditions: list[Condition] = []
    while len(conditions) < most and (bad < 1)[rows].any():
        p0, n0 = bad[rows].sum(), (1 - bad)[rows].sum()
        before = np.log2(p0 / (p0 + n0))
        best, found = 1e-9, None
        for name, values in data.items():
            inside, labels = values[rows], bad[rows]
            order = np.argsort(inside, kind="stable")
            ordered, upto = inside[order], np.concatenate(([0], np.cumsum(labels[order])))
            for cut in _cuts(inside):
                at = np.searchsorted(ordered, cut)
                for above, p, size in ((True, upto[-1] - upto[at], len(ordered) - at), (False, upto[at], at)):
                    if p > 0:
                        gain = p * (np.log2(p / size) - before)
                        if gain > best:
                            best, found = gain, Condition(name, above, float(cut))
        if found is None:
            break
        conditions.append(found)
        rows &= found.mask(data)
    return conditions


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_rows: int = 3, most_rules: int = 24,
                most_conditions: int = 4) -> DecisionList:
    """An ordered list of rules that reject rows with `bad` = 1.

    Every third row prunes, the others grow. A pruned rule is kept while at least `min_precision` of
    the remaining rows that it covers, and of the prune rows among them, are bad.
    """
    bad = np.asarray(bad, np.int64)
    left = np.ones(len(bad), bool)
    prunes = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = left & ~prunes, left & prunes
        if bad[grow].sum() < min_rows or not (bad[grow] < 1).any():
            break
        conditions = _grow({k: v[grow] for k, v in data.items()}, bad[grow], most_conditions)
        if not conditions:
            break
        held = {k: v[prune] for k, v in data.items()}

        def worth(n: int) -> float:
            covered = bad[prune][Rule(tuple(conditions[:n])).mask(held)]
            return (2 * covered.sum() - len(covered)) / max(1, len(covered)) if len(covered) else -1.0

        size = max(range(1, len(conditions) + 1), key=lambda n: (worth(n), -n))
        rule = Rule(tuple(conditions[:size]))
        mask = rule.mask(data) & left
        covered, checked = bad[mask], bad[mask & prunes]
        if len(covered) < min_rows or covered.mean() < min_precision or (len(checked) and checked.mean() < min_precision):
            break
        rules.append(Rule(rule.conditions, int(len(covered)), float(covered.mean())))
        left &= ~mask
    return DecisionList(tuple(rules))


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None, max_rows: int = MAX_LABELLED,
              id_col: str = "doc_id", text_col: str = "text", **options) -> DecisionList:
    """Learn from at most `max_rows` labelled documents; only their features reach the driver."""
    rows = labelled_texts(docs, labels, label, F.lit(True) if keep is None else keep, max_rows, id_col, text_col)
    table = text_statistics(rows).select("id", (F.col("label") == 0).cast("int").alias("bad"), *[feature(f).alias(f) for f in FEATURES]).toPandas()
    table = table.sort_values(["id", "bad", *FEATURES], kind="stable")
    return learn_rules({f: table[f].to_numpy(float) for f in FEATURES}, table["bad"].to_numpy(), **options)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """`docs` plus the statistics, base_failed, rule (number of the deciding rule, 0 for none) and kept."""
    measured = text_statistics(docs, text_col)
    return measured.withColumns({"base_failed": base_failed(), "rule": rules.rule_number()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))
