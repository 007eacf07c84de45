"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions.

A rule is a conjunction of thresholds on statistics of a text. Growing adds, condition by condition, the threshold that gains most
information on two thirds of the labelled rows; pruning drops conditions from the end while that doesn't lower the rule's worth on the last
third. Rules that aren't precise there end the list; each accepted rule takes the bad rows that it covers out of what the next must cover.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats
from .common import map_texts
from .quality_model import FIT_ROWS, labelled

#: Conditions in a rule, rules in a list, candidate thresholds for a statistic, share of bad rows that a rule must reach on unseen rows.
CONDITIONS, RULES, CANDIDATES, PRECISION = 4, 12, 48, 0.95
#: Base limits: words at least, and words in repeated windows out of a hundred at most.
LEAST_WORDS, MOST_REPEATS = 20, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals", "n_letters", "n_same", "n_distinct"]
Rule = list[tuple[str, str, float]]


def describe(text: str) -> tuple[int, ...]:
    """The numbers of COUNTS: the base ones, lines with a word, ! and ?, ASCII capitals and letters, words equal to the one before, distinct words."""
    by, words, lines, dup, repeats = textstats.counts(text)
    same = sum(map(textstats.eq, words, words[1:]))
    capitals = int(by[65:91].sum())
    return (
        len(words),
        len(text) - int(by[textstats.SPACES].sum()),
        int(by[textstats.SYMBOLS].sum()),
        dup,
        repeats,
        lines,
        int(by[33] + by[63]),
        capitals,
        capitals + int(by[97:123].sum()),
        same,
        len(set(words)),
    )


def statistics() -> dict[str, Column]:
    """Statistics that rules may use, of the columns in COUNTS; shares are 0 where there is nothing to share."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mark_share": share("n_marks", "n_words"),
        "capital_share": share("n_capitals", "n_letters"),
        "same_share": share("n_same", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, t in rule:
        out &= x[name] >= t if sign == ">=" else x[name] <= t
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition with the highest information gain until only bad rows are covered or no condition gains."""
    rule: Rule = []
    covered = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS:
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for name in sorted(x):
            values = x[name][covered]
            own = bad[covered]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CANDIDATES)))
            if len(cuts) > 1:
                cuts = (cuts[1:] + cuts[:-1]) / 2
                for sign in (">=", "<="):
                    held = values[:, None] >= cuts if sign == ">=" else values[:, None] <= cuts
                    a, b = (held & own[:, None]).sum(0), (held & ~own[:, None]).sum(0)
                    gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1) / np.maximum(a + b, 1)) - before), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = float(gain[k]), (name, sign, float(cuts[k]))
        if best[1] is None:
            break
        rule.append(best[1])
        covered &= _covers([best[1]], x, len(bad))
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The front part of the rule that is worth most on unseen rows, with its precision there and the bad rows that it covers."""
    best = ([], -2.0, 0.0, 0)
    for k in range(1, len(rule) + 1):
        held = _covers(rule[:k], x, len(bad))
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[1]:
            best = (rule[:k], worth, p / (p + n) if p + n else 0.0, p)
    return best[0], best[2], best[3]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """The ordered rules whose rows are rejected. Without bad rows there are none."""
    part = np.random.default_rng(seed).permutation(len(bad)) % 3
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES:
        a, b = left & (part < 2), left & (part == 2)
        if (a & bad).sum() < 5:
            break
        rule = grow({k: v[a] for k, v in x.items()}, bad[a])
        rule, precision, reach = prune(rule, {k: v[b] for k, v in x.items()}, bad[b])
        if not rule or precision < PRECISION or reach < 2:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over the columns of COUNTS: number of the first rule that holds, 0 if none."""
    of, out = statistics(), None
    for k, rule in enumerate(rules, 1):
        held = F.lit(True)
        for name, sign, t in rule:
            held = held & (of[name] >= t if sign == ">=" else of[name] <= t)
        out = F.when(held, F.lit(k)) if out is None else out.when(held, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def described(docs: DataFrame) -> DataFrame:
    schema = ", ".join(f"{c} long" for c in COUNTS)
    return map_texts(docs.select("doc_id", "text"), ["doc_id"], "text", lambda: lambda texts: [describe(x) for x in texts], schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` labelled documents that aren't held out."""
    data = labelled(docs, labels, "quality", lambda: lambda texts: [describe(x) for x in texts], ", ".join(f"{c} long" for c in COUNTS), rows)
    sample = data.select("label", *[c.alias(k) for k, c in statistics().items()]).toPandas()
    return learn({k: sample[k].to_numpy(float) for k in statistics()}, sample["label"].to_numpy(float) < 0.5)


def judge(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of each row of docs.

    Null and empty texts have no words, so they fail the base rules. rule is the number of the learned rule that rejects a row, 0 if none does.
    Repeated rows and null ids are kept. No shuffle.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    out = described(docs).withColumns({"base_failed": failed, "rule": verdict(fit(docs, labels, rows))})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
