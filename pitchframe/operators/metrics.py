"""Likelihoods, chi-square statistics and classification reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.functions.binomial import multinomial_counts
from pitchframe.functions.normal import add_normal_cdf
from pitchframe.operators.aggregate import frequencies
from pitchframe.operators.joins import lookup
from pitchframe.operators.sampling import hashed_uniform
from pitchframe.session import ship

EPSILON = 2.220446049250313e-16
DRAWS_PER_BLOCK = 250


def log_loss(df: DataFrame, p_true: Column, out: str = "log_loss", epsilon: float = EPSILON) -> DataFrame:
    """Mean negative log of the probability given to the true class."""
    clipped = F.greatest(F.least(p_true, F.lit(1.0 - epsilon)), F.lit(epsilon))
    return df.agg((-F.avg(F.log(clipped))).alias(out))


def log_likelihood(df: DataFrame, p_true: Column, out: str = "log_likelihood") -> DataFrame:
    return df.agg(F.sum(F.log(p_true)).alias(out))


def with_baseline_probability(
    train: DataFrame, test: DataFrame, label: str, out: str = "p_baseline"
) -> DataFrame:
    """Each test row with the share of its label in the training rows (NULL if never seen)."""
    shares = frequencies(train.where(F.col(label).isNotNull()), [label], share=out)
    return lookup(test, shares, {label: label}, [out])


def add_chi_square_tail(df: DataFrame, statistic: str, dof: str, out: str = "p_value") -> DataFrame:
    """Adds P(X >= statistic) of the chi-square distribution, in native expressions.

    For whole degrees of freedom the upper incomplete gamma function is a finite
    sum, plus a normal tail when they are odd. Terms are summed from their
    logarithms, so large statistics do not overflow.
    """
    x, k = F.col(statistic) / 2.0, F.col(dof)
    odd = k % 2 == 1
    first = F.when(odd, F.lit(0.5) * F.log(x) - math.lgamma(1.5)).otherwise(F.lit(0.0)) - x
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    terms = F.floor(k / 2).cast("int")
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps,
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda acc, i: F.struct(
            (acc["log"] + F.log(x) - F.log(i + shift)).alias("log"),
            (acc["sum"] + F.exp(acc["log"] + F.log(x) - F.log(i + shift))).alias("sum"),
        ),
    )["sum"]
    df = add_normal_cdf(df.withColumn("_root", -F.sqrt(F.greatest(F.col(statistic), F.lit(0.0)))), "_root", "_half")
    series = F.when(terms > 0, total).otherwise(0.0)
    tail = F.when(odd, F.col("_half") * 2.0 + series).otherwise(series)
    value = F.when(F.col(statistic).isNull() | (k < 1), F.lit(None)).when(F.col(statistic) <= 0, F.lit(1.0)).otherwise(tail)
    return df.withColumn(out, value).drop("_root", "_half")


def goodness_of_fit(
    observed: DataFrame, expected: DataFrame, keys: Sequence[str], count: str, by: Sequence[str] = ()
) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p-value of observed against expected counts.

    Categories are those of ``observed``; one that ``expected`` lacks counts as
    0 there and makes the statistic NULL. ``by`` runs one test per group.
    """
    join_on = [*by, *keys]
    right = expected.select(*join_on, F.col(count).cast("double").alias("_e"))
    both = observed.select(*join_on, F.col(count).cast("double").alias("_o")).join(right, join_on, "left")
    both = both.withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    term = F.try_divide((F.col("_o") - F.col("_e")) ** 2, F.col("_e"))
    total = F.when(F.count_if(F.col("_e") == 0) == 0, F.sum(term))
    tests = both.groupBy(*by).agg(total.alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof"))
    return add_chi_square_tail(tests, "statistic", "dof")


def repeated_goodness_of_fit(
    observed: DataFrame,
    shares: DataFrame,
    by: Sequence[str],
    category: str,
    *,
    count: str = "n",
    share: str = "p",
    draws: int = 1000,
    level: float = 0.05,
    u: Callable[[Column, Column], Column] | None = None,
    seed: int = 0,
) -> DataFrame:
    """How often observed counts differ from counts drawn with the given class shares, per group.

    Every draw distributes the group's rows over its classes and tests the
    observed counts against that. Counts are drawn as a chain of binomial
    quantiles, so a draw costs one step per class whatever the number of rows.
    ``u(draw, position)`` gives the uniform numbers (hashed from the group by
    default), so a repeated task draws the same counts. A class that a draw
    leaves out although it was observed makes that draw differ. Classes are those
    of ``shares``; an observed class without a share is drawn 0 times. Columns:
    by, draws, different, share_different.
    """
    ship(observed.sparkSession)
    cells = shares.select(*by, category, F.col(share).cast("double").alias("_p"))
    seen = observed.select(*by, category, F.col(count).cast("long").alias("_o"))
    both = cells.join(seen, [*by, category], "full_outer").fillna({"_p": 0.0, "_o": 0})
    listed = F.sort_array(F.collect_list(F.struct(category, "_p", "_o"))).alias("_cells")
    groups = both.groupBy(*by).agg(listed, F.sum("_o").alias("_n"), F.sum("_p").alias("_all")).where("_n > 0 AND _all > 0")
    numbered = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_PER_BLOCK)))).repartition(*by, "_block")
    first = F.col("_block") * DRAWS_PER_BLOCK + 1
    rows = numbered.withColumn("draw", F.explode(F.sequence(first, F.least(first + DRAWS_PER_BLOCK - 1, F.lit(draws)))))
    number = u or (lambda draw, position: hashed_uniform(*by, draw, position, seed=seed))
    rows = rows.select(
        *by, "draw", "_n", F.col("_cells._p").alias("_p"), F.col("_cells._o").alias("_o"),
        F.transform(F.sequence(F.lit(1), F.size("_cells")), lambda k: number(F.col("draw"), k)).alias("_u"),
    )

    def count_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pa.compute.list_value_length(batch.column("_p")).to_pylist(), np.int64)
            drawn: list = [None] * len(sizes)
            held = {name: batch.column(name).to_pylist() for name in ("_p", "_u", "_n")}
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                take = lambda name: np.array([held[name][i] for i in at])  # noqa: B023, E731
                for i, counts in zip(at, multinomial_counts(take("_u"), take("_n"), take("_p")), strict=True):
                    drawn[i] = counts.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.list_(pa.int64()))], names=[*batch.schema.names, "_d"])

    fields = [*rows.schema.fields, T.StructField("_d", T.ArrayType(T.LongType()))]
    drawn = rows.mapInArrow(count_draws, T.StructType(fields))
    pairs = F.filter(F.arrays_zip("_o", "_d"), lambda c: c["_o"] > 0)
    term = lambda c: F.when(c["_d"] > 0, (c["_o"] - c["_d"]) ** 2 / c["_d"])
    total = F.aggregate(pairs, F.lit(0.0), lambda a, c: a + term(c))
    tests = drawn.select(*by, "draw", total.alias("_statistic"), (F.size(pairs) - 1).alias("_dof"))
    tested = add_chi_square_tail(tests, "_statistic", "_dof", "_p_value")
    # One class alone always agrees; a statistic without a value comes from a class that was not drawn.
    differs = F.when(F.col("_statistic").isNull(), True).when(F.col("_dof") < 1, False).otherwise(F.col("_p_value") < level)
    out = tested.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.count_if(differs).alias("different"))
    return out.withColumn("share_different", F.col("different") / F.col("draws"))


def contingency(df: DataFrame, sample: str, category: str) -> DataFrame:
    """Chi-square test of independence between two columns.

    With one degree of freedom the continuity correction of at most one half is
    applied. All work after the first count runs on one row per occurring cell.
    """
    cells = df.groupBy(sample, category).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    rows = cells.groupBy(sample).agg(F.sum("_o").alias("_row"))
    columns = cells.groupBy(category).agg(F.sum("_o").alias("_col"))
    sizes = cells.agg(
        F.struct(
            F.sum("_o").alias("total"),
            F.count_distinct(sample).alias("r"),
            F.count_distinct(category).alias("c"),
        )
    ).scalar()
    placed = cells.join(rows, sample).join(columns, category).withColumn("_s", sizes)
    expected = F.col("_row") * F.col("_col") / F.col("_s.total")
    gap = F.col("_o") - expected
    measured = placed.select(
        (gap * gap / expected).alias("_term"),
        F.abs(gap).alias("_gap"),
        expected.alias("_e"),
        F.col("_s.total").alias("_n"),
        ((F.col("_s.r") - 1) * (F.col("_s.c") - 1)).alias("dof"),
    )
    inverse = rows.agg(F.sum(F.lit(1.0) / F.col("_row"))).scalar() * columns.agg(F.sum(F.lit(1.0) / F.col("_col"))).scalar()
    # A cell that never occurs would add its whole expected count, and all
    # expected counts sum to the total. In a two-by-two table every cell has the
    # same gap.
    full = F.sum("_term") + F.max("_n") - F.sum("_e")
    corrected = F.max("_gap") - F.least(F.max("_gap"), F.lit(0.5))
    statistic = F.when(F.max("dof") == 1, corrected * corrected * F.max("_n") * inverse).otherwise(full)
    tests = measured.agg(statistic.alias("statistic"), F.max("dof").alias("dof"))
    return add_chi_square_tail(tests, "statistic", "dof")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = confusion(df, label, predicted)
    hit = F.col(label) == F.col(predicted)
    actual = cells.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_hits")
    )
    guessed = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("_guesses"))
    both = actual.join(guessed, "class", "full_outer").na.fill(0, ["support", "_hits", "_guesses"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits, guesses, support = (F.col(c).cast("double") for c in ("_hits", "_guesses", "support"))
    return both.select(
        "class",
        ratio(hits, guesses).alias("precision"),
        ratio(hits, support).alias("recall"),
        ratio(2.0 * hits, guesses + support).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy with macro and support-weighted averages of a class report."""
    total = F.sum("support")
    columns = [(F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy")]
    for c in ("precision", "recall", "f1"):
        columns += [
            F.avg(c).alias(f"macro_{c}"),
            (F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}"),
        ]
    return report.agg(*columns)
