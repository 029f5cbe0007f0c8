"""Quality rules: a decision list learned by sequential covering, applied as one Spark conditional expression.

The statistics of every text are computed in one pass.  From a bounded sample of labelled rows the
learner covers the rejected class rule by rule: it *grows* a conjunction of thresholds by the best
information gain, *prunes* it on rows it was not grown on, and stops when a rule is no longer precise
enough there.  The list becomes ``CASE WHEN rule THEN false ... ELSE true END``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import arrow_rows, labelled_sample, training_ids

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks",
          "n_distinct_words", "n_code_points")
_LOWER = bytes(range(97, 123))
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b".,;:!?"


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of five found at least twice; exact, the windows are named pair by pair."""
    if len(ids) <= WINDOW:
        return 0

    def named(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        values, inverse, counts = np.unique(a * n + b, return_inverse=True, return_counts=True)
        return inverse, counts

    n = int(ids.max()) + 1
    two, counts = named(ids[:-1], ids[1:], n)
    if counts.max() < 2:
        return 0
    four, counts = named(two[:-2], two[2:], len(counts))
    if counts.max() < 2:
        return 0
    five, counts = named(four[:-1], ids[WINDOW - 1:], max(n, len(counts)))
    repeated = counts[five] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:-WINDOW] += repeated
    edges[WINDOW:] -= repeated
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The integers of ``COUNTS`` for a whole text (null: as for an empty text)."""
    text = text or ""
    data = text.encode()
    words = data.split()
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    seen, duplicates, lines = set(), 0, 0
    for line in data.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    n = len(data)
    spaces = n - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    return (
        len(words), len(text) - spaces, n - len(data.translate(None, SYMBOLS)), duplicates, repeated_words(ids), lines,
        n - len(data.translate(None, _UPPER)), n - len(data.translate(None, _DIGITS)), n - len(data.translate(None, _MARKS)),
        len(names), len(text),
    )


def text_statistics(docs: DataFrame, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``COUNTS`` of every whole text; one row per row, null texts count as empty."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), *[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in COUNTS],
    ])

    def row():
        return lambda doc_id, text, *kept: (doc_id, *kept, *text_counts(text))

    return arrow_rows(docs, row, ["doc_id", "text", *keep], schema)


def base_failed() -> Column:
    """The fixed rule: too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def features(prefix: str = "") -> dict[str, Column]:
    """Ratios the learner sees, from the counts."""
    c = {name: F.col(prefix + name).cast("double") for name in COUNTS}
    at_least_one = {name: F.greatest(c[name], F.lit(1.0)) for name in ("n_words", "n_lines", "word_chars")}
    return {
        "word_length": c["word_chars"] / at_least_one["n_words"],
        "symbol_share": c["n_symbols"] / at_least_one["n_words"],
        "duplicate_line_share": c["n_dup_lines"] / at_least_one["n_lines"],
        "repeated_share": c["n_repeat_words"] / at_least_one["n_words"],
        "upper_share": c["n_upper"] / at_least_one["word_chars"],
        "digit_share": c["n_digits"] / at_least_one["word_chars"],
        "mark_share": c["n_marks"] / at_least_one["n_words"],
        "distinct_share": c["n_distinct_words"] / at_least_one["n_words"],
        "words": c["n_words"],
        "words_per_line": c["n_words"] / at_least_one["n_lines"],
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def expression(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    """Add the threshold with the best gain until no good row is covered or nothing is gained."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (inside & ~bad).any():
        p, n = (inside & bad).sum(), inside.sum()
        best_gain, best = 0.0, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            last = np.flatnonzero(v[1:] != v[:-1])
            below_p, below_n = np.cumsum(b)[last], last + 1
            for above, pp, nn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / nn) - np.log2(p / n)), 0.0)
                if len(gain) and gain.max() > best_gain + 1e-9:
                    k = int(gain.argmax())
                    best_gain, best = float(gain[k]), Condition(name, above, float((v[last[k]] + v[last[k] + 1]) / 2))
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop the last conditions as long as (right - wrong) / covered does not fall."""

    def worth(r: Rule) -> float:
        c = _covered(r, x, len(bad))
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / max(1, p + n)

    candidates = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(candidates, key=lambda r: (worth(r), -len(r))) if candidates else rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4,
                least_precision: float = 0.95, least_covered: int = 3) -> list[Rule]:
    """Ordered rules for ``bad`` rows.  A third of the rows, dealt out in turn, is for pruning and judging only.

    No rows, or rows of one class, give an empty list.
    """
    rules: list[Rule] = []
    held = np.arange(len(bad)) % 3 == 2
    open_rows = np.ones(len(bad), bool)
    while len(rules) < max_rules and (open_rows & bad & ~held).any() and (open_rows & ~bad & ~held).any():
        grow, prune = open_rows & ~held, open_rows & held
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        covered = _covered(rule, x, len(bad)) & open_rows
        right, judged = (covered & bad & held).sum(), (covered & held).sum()
        overall = (covered & bad).sum() / max(1, covered.sum())
        if covered.sum() < least_covered or not judged or right / judged < least_precision or overall < least_precision:
            break
        rules.append(rule)
        open_rows &= ~covered
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 50_000, **options) -> list[Rule]:
    """Learn from at most ``max_rows`` labelled rows (quality 0 is the class to reject); a few numbers per row reach the driver."""
    named = features()
    sample = labelled_sample(stats.where(~base_failed()), labels, "quality", max_rows)
    rows = sample.select("doc_id", "_label", *[c.alias(k) for k, c in named.items()]).toArrow().sort_by("doc_id")
    x = {k: rows.column(k).to_numpy() for k in named}
    return learn_rules(x, rows.column("_label").to_numpy() == 0, **options)


def fit_rules_on_texts(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, **options) -> list[Rule]:
    """``fit_rules`` where no statistics exist yet: only the texts of the training sample are read for it."""
    few = docs.join(F.broadcast(training_ids(labels, "quality", max_rows).select("doc_id")), "doc_id", "left_semi")
    return fit_rules(text_statistics(few), labels, max_rows, **options)


def keep_expression(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false at the first rule that fires, else true."""
    columns = features()

    def all_of(rule: Rule) -> Column:
        out = F.lit(True)
        for condition in rule:
            out = out & condition.expression(columns)
        return out

    decided: Callable | None = None
    for rule in rules:
        decided = F.when(all_of(rule), False) if decided is None else decided.when(all_of(rule), False)
    return F.lit(True) if decided is None else decided.otherwise(True)


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed`` and ``kept`` (false where the fixed rule fails, else the decision list's verdict)."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & keep_expression(rules))
