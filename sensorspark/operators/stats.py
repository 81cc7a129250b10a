"""Exact quantiles, standardisation, correlation and covariance."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.functions.clean import complete_cases
from sensorspark.session import broadcast_if_small, materialize, materialize_observed, with_scalars

# Values that may be left between the ends of a bracket: the most that one group's final sort takes.
BRACKET_ROWS = 50_000
# Cut points of a sketch and its accuracy.
CUTS = 1024
CUT_ACCURACY = 10_000


def linear_position(n: Column, prob: Column) -> Column:
    """Rank of the usual interpolating quantile: ``(n − 1) · prob``."""
    return (n - 1) * prob


class _Brackets:
    """For every (group, probability) an interval of values that holds the wanted ranks.

    ``table`` has the group, ``_i`` (which probability), ``_n`` (rows of the group), the 0-based ranks
    ``_k`` and ``_k2``, ``_frac``, ``low`` and ``high`` (null: no limit), ``_upto`` (rows not above
    low), ``_left`` (rows strictly inside) and ``_tries``.
    """

    def __init__(self, rows: DataFrame, by: list[str], probs: list[float], position, few_groups: bool):
        self.rows, self.by, self.few = rows, by, few_groups
        prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
        place = position(F.col("_n"), prob)
        none = F.lit(None).cast("double")
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 0)
        self.table = (
            sizes.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(probs))])))
            .withColumns({"prob": prob, "_k": F.floor(place), "_frac": place - F.floor(place)})
            .withColumn("_k2", F.least(F.col("_k") + 1, F.col("_n") - 1))
            .withColumns({"low": none, "high": none, "_upto": F.lit(0).cast("long"), "_left": F.col("_n"), "_tries": F.lit(0)})
        )
        self._write()

    def _write(self) -> None:
        open_rows = F.count_if(F.col("_left") > BRACKET_ROWS)
        self.table, seen = materialize_observed(self.table, "brackets", open=open_rows)
        self.open = seen["open"]

    def beside(self, brackets: DataFrame, fields: list[str], wanted) -> DataFrame:
        """Rows of ``rows`` beside those brackets of their group for which ``wanted(bracket)`` holds."""
        keys = [F.col(c).alias(f"_g_{c}") for c in self.by]
        packed = brackets.groupBy(*keys).agg(F.collect_list(F.struct("_i", *fields)).alias("_all"))
        if self.by:
            small = F.broadcast(packed) if self.few else broadcast_if_small(packed)
            same = [self.rows[c].eqNullSafe(F.col(f"_g_{c}")) for c in self.by]
            joined = self.rows.join(small, same).drop(*[f"_g_{c}" for c in self.by])
        else:
            joined = with_scalars(self.rows, packed)
        return joined.withColumn("_b", F.explode(F.filter("_all", wanted))).select(*self.by, "_v", "_b.*")

    def _strictly(self, b: Column) -> Column:
        v = F.col("_v")
        return (b["low"].isNull() | (v > b["low"])) & (b["high"].isNull() | (v < b["high"]))

    def _joined(self, brackets: DataFrame, found: DataFrame) -> DataFrame:
        same = [brackets[c].eqNullSafe(found[c]) for c in [*self.by, "_i"]]
        return brackets.join(found, same, "left").select(
            *[brackets[c] for c in brackets.columns], *[found[c] for c in found.columns if c not in [*self.by, "_i"]]
        )

    def narrow(self) -> None:
        """One round for the brackets that are still too wide: a sketch of what lies inside proposes a
        narrower one around the ranks, and exact counts accept it or ask for a wider proposal."""
        wide = self.table.where(F.col("_left") > BRACKET_ROWS)
        shares = [i / CUTS for i in range(CUTS + 1)]
        sketch = (
            self.beside(wide, ["low", "high"], self._strictly)
            .groupBy(*self.by, "_i")
            .agg(F.percentile_approx("_v", shares, CUT_ACCURACY).alias("_cuts"))
        )

        def share(rank: str) -> Column:
            return (F.col(rank) - F.col("_upto")) / F.col("_left") * CUTS

        margin = F.pow(F.lit(2.0), F.col("_tries"))
        first = (F.floor(share("_k")) - margin).cast("int")
        last = (F.ceil(share("_k2")) + margin).cast("int")
        proposed = materialize(
            self._joined(wide, sketch)
            .withColumn("a", F.when(first >= 0, F.get("_cuts", F.least(first, F.lit(CUTS)))).otherwise(F.col("low")))
            .withColumn("b", F.when(last <= CUTS, F.get("_cuts", F.greatest(last, F.lit(0)))).otherwise(F.col("high")))
            .drop("_cuts"),
            "proposed",
        )
        v = F.col("_v")
        counts = (
            self.beside(proposed, ["low", "high", "a", "b"], self._strictly)
            .groupBy(*self.by, "_i")
            .agg(
                F.count_if(v < F.col("a")).alias("_under"),
                F.count_if(v <= F.col("a")).alias("_to_a"),
                F.count_if(F.col("b").isNull() | (v < F.col("b"))).alias("_before_b"),
                F.count_if(F.col("b").isNull() | (v <= F.col("b"))).alias("_to_b"),
            )
        )
        # Ends that were kept have nothing below or above them inside the old bracket.
        base, kept_a, kept_b = F.col("_upto"), F.col("a").eqNullSafe(F.col("low")), F.col("b").eqNullSafe(F.col("high"))
        good = (kept_a | (F.col("_k") >= base + F.col("_under"))) & (kept_b | (F.col("_k2") < base + F.col("_to_b")))
        upto = F.when(kept_a, base).otherwise(base + F.col("_to_a"))
        end = F.when(kept_b, base + F.col("_left")).otherwise(base + F.col("_before_b"))
        judged = self._joined(proposed, counts).select(
            *[c for c in self.table.columns if c not in ("low", "high", "_upto", "_left", "_tries")],
            F.when(good, F.col("a")).otherwise(F.col("low")).alias("low"),
            F.when(good, F.col("b")).otherwise(F.col("high")).alias("high"),
            F.when(good, upto).otherwise(base).alias("_upto"),
            F.when(good, F.greatest(end - upto, F.lit(0))).otherwise(F.col("_left")).alias("_left"),
            F.when(good, 0).otherwise(F.col("_tries") + 1).alias("_tries"),
        )
        closed = self.table.where(F.col("_left") <= BRACKET_ROWS)
        self.table = closed.unionByName(judged)
        self._write()


def grouped_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: list[float],
    few_groups: bool = False,
    position: Callable[[Column, Column], Column] = linear_position,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: columns ``by``, ``prob``, ``quantile``.

    Spark's own exact percentile merges every distinct value of a group in one task.  Here each wanted
    rank has a bracket, narrowed round by round until at most ``BRACKET_ROWS`` rows lie strictly
    inside; only then are distinct values sorted.  A round keeps about one part in ``CUTS`` of a
    bracket, so that 10^12 rows take three.  Equal values are counted before the shuffle, which makes
    a value that fills a third of the table a single row; as an end of a bracket it costs nothing.

    ``few_groups`` states that the number of groups is fixed by the caller (a list of metric
    names, the hours of a day); otherwise the bracket table is counted before it is broadcast.
    ``position(n, prob)`` is the 0-based, possibly fractional rank to read.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    brackets = _Brackets(rows, by, probs, position, few_groups)
    while brackets.open:
        brackets.narrow()
    fields = ["prob", "_k", "_k2", "_frac", "low", "high"]
    near = brackets.beside(brackets.table, fields, lambda b: b["high"].isNull() | (F.col("_v") <= b["high"]))
    # NULL collects everything below the bracket into one counted row.
    kept = F.when(F.col("low").isNull() | (F.col("_v") >= F.col("low")), F.col("_v"))
    counted = near.groupBy(*by, "_i", *fields[:4], kept.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ordered = Window.partitionBy(*by, "_i").orderBy(F.asc_nulls_first("_v"))
    ranked = counted.withColumn("_to", F.sum("_c").over(ordered)).withColumn("_from", F.col("_to") - F.col("_c"))

    def at(rank: str) -> Column:
        inside = (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_to"))
        return F.max(F.when(inside, F.col("_v")))

    picked = ranked.groupBy(*by, "_i", "prob", "_frac").agg(at("_k").alias("_lo"), at("_k2").alias("_hi"))
    return picked.select(
        *by, "prob", (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias("quantile")
    )


def long_form(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids…, variable, value): several measures stacked into one double column."""
    keep = ids or []
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(keep, columns, "variable", "value")


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """One row per column of ``df``: ``variable`` and one exact quantile column per name."""
    q = grouped_quantiles(
        long_form(df, columns), ["variable"], "value", list(probs.values()), few_groups=True
    )
    return q.groupBy("variable").agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for name, p in probs.items()
        ]
    )


def quantile_row(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """The same quantiles as one row with columns ``<column>_<name>``."""
    long = column_quantiles(df, columns, probs)
    return long.agg(
        *[
            F.max(F.when(F.col("variable") == c, F.col(name))).alias(f"{c}_{name}")
            for c in columns
            for name in probs
        ]
    )


def iqr_outlier_counts(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """One row with the number of values outside the quartile fences, per column."""
    fenced = with_scalars(df.select(*columns), quantile_row(df, columns, {"q1": 0.25, "q3": 0.75}))

    def outside(c: str):
        spread = multiplier * (F.col(f"{c}_q3") - F.col(f"{c}_q1"))
        return (F.col(c) < F.col(f"{c}_q1") - spread) | (F.col(c) > F.col(f"{c}_q3") + spread)

    return fenced.agg(*[F.count_if(outside(c)).alias(f"{c}_outliers") for c in columns])


def six_number_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, first quartile, median, mean, third quartile, max and NULL count per column."""
    quartiles = column_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    basic = (
        long_form(df, columns)
        .groupBy("variable")
        .agg(
            F.min("value").alias("min"),
            F.avg("value").alias("mean"),
            F.max("value").alias("max"),
            F.count_if(F.col("value").isNull()).alias("na_count"),
        )
    )
    # One row per listed column on either side.
    return basic.join(F.broadcast(quartiles), "variable", "left")


def mean_sd_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_sd") for c in columns],
    )


def standardize(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """(x − mean) / sample sd; NULL where the sd is zero."""
    scaled = with_scalars(df, mean_sd_row(df, columns))
    z = {
        f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd"))
        for c in columns
    }
    return scaled.withColumns(z).drop(
        *[f"{c}_mean" for c in columns], *[f"{c}_sd" for c in columns]
    )


def _pair_rows(row: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """Melt a one-row aggregate into (var1, var2, value); ``names`` holds (var1, var2, column)."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(c).alias("value"))
            for a, b, c in names
        ]
    )
    return row.select(F.inline(cells))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlations on rows complete in all ``columns``: long form, both triangles."""
    complete = complete_cases(df.select(*columns))
    pairs = list(combinations(columns, 2))
    row = complete.agg(
        *[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)],
        *[
            F.when(F.stddev_samp(c) > 0, F.lit(1.0)).alias(f"_d{i}")
            for i, c in enumerate(columns)
        ],
    )
    names = [(c, c, f"_d{i}") for i, c in enumerate(columns)]
    for i, (a, b) in enumerate(pairs):
        names += [(a, b, f"_r{i}"), (b, a, f"_r{i}")]
    return _pair_rows(row, names)


def top_correlations(matrix: DataFrame, n: int = 10) -> DataFrame:
    """Strongest pairs by absolute value, each unordered pair once."""
    return (
        matrix.where(F.col("var1") < F.col("var2"))
        .orderBy(F.desc_nulls_last(F.abs("value")), "var1", "var2")
        .limit(n)
    )


def correlation_of(matrix: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    wanted = F.struct("var1", "var2").isin(
        *[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2")) for a, b in pairs]
    )
    return matrix.where(wanted)


def covariance_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over rows complete in ``columns``: ``n``, ``mean_i`` and ``cov_i_j`` (i ≤ j)."""
    complete = complete_cases(df.select(*columns))
    index = range(len(columns))
    return complete.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(columns[i]).alias(f"mean_{i}") for i in index],
        *[
            F.covar_samp(columns[i], columns[j]).alias(f"cov_{i}_{j}")
            for i, j in combinations_with_replacement(index, 2)
        ],
    )


def covariance_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    row = covariance_row(df, columns)
    names = []
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        names.append((columns[i], columns[j], f"cov_{i}_{j}"))
        if i != j:
            names.append((columns[j], columns[i], f"cov_{i}_{j}"))
    return _pair_rows(row, names)
