"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every text is measured once (words, symbols, repeated lines and windows, capitals).  A rule rejects
a document when one of these ratios exceeds a cutoff.  Cutoffs are chosen per stratum (a band of
text length) from fixed ladders with labelled documents that serve as a holdout only: a ladder is
climbed from its most lenient step, and a step is accepted as long as the exact binomial tail shows
that the share of good documents it rejects is below the rule's share of ``alpha``.  The error
probability ``delta`` is divided over strata and rules (Bonferroni); within a ladder the fixed order
of the tests needs no further correction, since climbing stops at the first step that fails.  Among
accepted steps the one that separates bad from good documents best is used.  A stratum with too few
labels accepts no step and so rejects nothing beyond the base rules.

A trial is a distinct text: labelled rows with the same text count once, with their smallest label,
since copies are no independent evidence.  The guarantee thus is that of the good distinct texts of a
stratum no more than ``alpha`` are rejected, with probability 1 - ``delta`` for all strata at once.

Defined results: a null or empty text has no words and fails the base rule; rows repeat in the
output as they repeat in the input; a null ``doc_id`` is measured like any other but has no label;
without labels only the base rules reject; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import free_name, labels_of, text_of
from sensorspark.session import materialize

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
)
MEASURES = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

# A ladder per rule, from lenient to strict.
LADDERS: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1),
    "mean_word_length": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}
# Upper word counts of the strata; the last stratum is open.
BANDS = (200, 1000)
# How many good documents in a hundred weigh as much as a hundred bad ones in choosing a step.
GOOD_WEIGHT = 20.0


@dataclass(frozen=True)
class Cutoff:
    stratum: int
    rule: str
    value: float
    good: int
    rejected_good: int


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 1 << 21:
        codes = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        codes = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(codes)
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure_text(text: str) -> tuple[int, ...]:
    """The counts named in ``COUNTS``; words are runs without ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    spaces = len(raw) - len(raw.translate(None, SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, max(len(numbers), 1)),
        len(lines),
        len(raw) - len(raw.translate(None, CAPITALS)),
    )


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(COUNTS), dtype="int64")


def measures(text: Column) -> Column:
    """A struct of ``COUNTS``; ``text`` must not be null."""
    return F.pandas_udf(_measures, MEASURES)(text)


def base_failed(m: str) -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words")
    )


def ratios(m: str) -> dict[str, Column]:
    """The statistic that each rule compares with its cutoff; zero where a text has no words."""

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{m}.{part}").cast("double"), F.col(f"{m}.{whole}")), F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "mean_word_length": share("word_chars", "n_words"),
    }


def stratum(m: str) -> Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(F.col(f"{m}.n_words") < BANDS[k], k).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    terms = [
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)
        for i in range(k + 1)
    ]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def calibrate(
    measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05
) -> list[Cutoff]:
    """Cutoffs from (doc_id, fp, m) rows and their ``quality`` labels; ``fp`` tells texts apart.

    The counts per stratum, rule and step are one aggregate of fixed size, whatever the number of
    labelled rows; only that aggregate reaches the driver.
    """
    labelled = measured.join(
        labels_of(labels, "quality"), F.col("doc_id") == F.col("label_key")
    ).where(~base_failed("m"))
    holdout = labelled.groupBy("fp").agg(F.min("label").alias("label"), F.first("m").alias("m"))
    stats = ratios("m")
    counted = holdout.groupBy(stratum("m").alias("stratum"), "label").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if(stats[rule] > value).alias(f"{rule}_{step}")
            for rule, ladder in LADDERS.items()
            for step, value in enumerate(ladder)
        ],
    )
    return chosen({(row["stratum"], row["label"]): row for row in counted.collect()}, alpha, delta)


def chosen(by: dict, alpha: float, delta: float) -> list[Cutoff]:
    """The best certified step of each ladder, from counts by (stratum, label): ``n`` texts, and how
    many of them each ``rule_step`` rejects."""
    tests = (len(BANDS) + 1) * len(LADDERS)
    found = []
    for band in range(len(BANDS) + 1):
        good, bad = by.get((band, 1)), by.get((band, 0))
        if good is None or bad is None:
            continue
        for rule, ladder in LADDERS.items():
            best, gain = None, 0.0
            for step, value in enumerate(ladder):
                lost, caught = good[f"{rule}_{step}"], bad[f"{rule}_{step}"]
                if binomial_tail(lost, good["n"], alpha / len(LADDERS)) > delta / tests:
                    break
                worth = caught / bad["n"] - GOOD_WEIGHT * lost / good["n"]
                if worth > gain:
                    best, gain = Cutoff(band, rule, value, good["n"], lost), worth
            if best:
                found.append(best)
    return found


def rejected(m: str, cutoffs: list[Cutoff]) -> Column:
    """True where some rule of the row's stratum exceeds its cutoff."""
    stats, band, out = ratios(m), stratum(m), F.lit(False)
    for c in cutoffs:
        out = out | ((band == c.stratum) & (stats[c.rule] > c.value))
    return out


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``."""
    measured = materialize(
        docs.select("doc_id", F.md5(text_of(docs)).alias("fp"), measures(text_of(docs)).alias("m")),
        "quality-measures",
    )
    cutoffs = calibrate(measured, labels)
    return measured.select(
        "doc_id",
        *[F.col(f"m.{c}").alias(c) for c in COUNTS],
        base_failed("m").alias("base_failed"),
        (~base_failed("m") & ~rejected("m", cutoffs)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    Texts are measured twice, for the counts of the labelled rows and for the verdicts, so that no
    text is ever shuffled or written.
    """
    labelled = labels_of(labels, "quality")
    ids = docs.select("doc_id", text_of(docs).alias("t"))
    measured = materialize(
        ids.select("doc_id", F.md5("t").alias("fp"), measures(F.col("t")).alias("m")), "quality-measures"
    )
    cutoffs = calibrate(measured, labelled.select(F.col("label_key").alias("doc_id"), F.col("label").alias("quality")))
    m = free_name(docs, "measures")
    return (
        docs.withColumn(m, measures(text_of(docs)))
        .where(~base_failed(m) & ~rejected(m, cutoffs))
        .drop(m)
    )
