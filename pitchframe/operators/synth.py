"""Synthetic rows: kernel resampling, kernel densities, a Gaussian copula, comparisons.

All randomness is hashed from row ids, so a lost task draws the same numbers
again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.functions.normal import add_normal_cdf, add_normal_quantile
from pitchframe.operators.aggregate import attach, pair_matrix
from pitchframe.operators.ordered import Ordered, written
from pitchframe.operators.quantiles import histogram, histogram_quantile, long_values, per_column, quantiles_at
from pitchframe.operators.sampling import hashed_uniform
from pitchframe.operators.split import contiguous_folds
from pitchframe.operators.standardize import pseudo_observations

BANDWIDTH = 0.1
BLOCK = 100_000
SMALLEST = 1e-300


def numbered(groups: DataFrame, keys: Sequence[str], n: int, out: str = "sample") -> DataFrame:
    """``n`` numbered rows per group, spread over tasks in blocks."""
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK))))
    spread = blocks.repartition(*keys, "_block")
    first = F.col("_block") * BLOCK + 1
    last = F.least(first + (BLOCK - 1), F.lit(n))
    return spread.withColumn(out, F.explode(F.sequence(first.cast("long"), last.cast("long")))).drop("_block")


def ball_samples(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], n: int, *, bandwidth: float = BANDWIDTH, seed: int = 0,
    uniform: Callable[[str], Column] | None = None,
) -> DataFrame:
    """``n`` draws per group from a top-hat kernel density over the columns.

    A draw is a random row of the group plus a point from the ball of radius
    ``bandwidth``: a normal direction, and a radius that fills the volume evenly.
    ``uniform`` gives the numbers behind a draw by name (``row``, ``radius`` and
    each column); they are hashed by default.
    """
    rows = df.dropna(how="any", subset=[*keys, *columns]).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    placed = Ordered(rows, keys, columns).row_number("_at").build()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = numbered(sizes, keys, n)
    u = uniform or (lambda name: hashed_uniform(*keys, "sample", F.lit(name), seed=seed))
    draws = draws.withColumn("_at", (F.floor(u("row") * F.col("_n")) + 1).cast("long"))
    picked = draws.join(placed, [*keys, "_at"])
    for c in columns:
        picked = add_normal_quantile(picked.withColumn("_p", u(c)), "_p", f"_z_{c}").drop("_p")
    length = F.lit(0.0)
    for c in columns:
        length = length + F.col(f"_z_{c}") * F.col(f"_z_{c}")
    scale = F.try_divide(F.pow(u("radius"), F.lit(1.0 / len(columns))) * bandwidth, F.sqrt(length))
    picked = picked.withColumn("_scale", F.coalesce(scale, F.lit(0.0)))
    return picked.select(
        *keys, "sample", *[(F.col(c) + F.col(f"_z_{c}") * F.col("_scale")).alias(c) for c in columns]
    )


def _kernel(kind: str, squared: Column, bandwidth: float, dimensions: int) -> tuple[Column, float]:
    """Kernel value and the constant that makes it integrate to one."""
    if kind == "gaussian":
        return F.exp(-squared / (2.0 * bandwidth**2)), (math.sqrt(2 * math.pi) * bandwidth) ** dimensions
    if kind == "tophat":
        volume = math.pi ** (dimensions / 2) / math.gamma(dimensions / 2 + 1)
        return F.when(squared <= bandwidth**2, 1.0).otherwise(0.0), volume * bandwidth**dimensions
    raise ValueError(f"unknown kernel {kind}")


def log_density(
    df: DataFrame,
    columns: Sequence[str],
    points: Sequence[Mapping[str, float]],
    *,
    bandwidth: float,
    kernel: str = "gaussian",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Kernel log density of the rows at a given list of points.

    Each row meets the literal point list inside its task and is reduced there
    to one partial sum per point. Where no row reaches a point the result is NULL.
    """
    grid = F.array(
        *[
            F.struct(F.lit(i).alias("point"), *[F.lit(float(p[c])).alias(f"_x_{c}") for c in columns])
            for i, p in enumerate(points)
        ]
    )
    rows = df.dropna(how="any", subset=list(columns)).select(*keys, *columns, F.inline(grid))
    squared = F.lit(0.0)
    for c in columns:
        squared = squared + (F.col(c).cast("double") - F.col(f"_x_{c}")) ** 2
    value, constant = _kernel(kernel, squared, bandwidth, len(columns))
    sums = rows.groupBy(*keys, "point").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    density = F.col("_s") / (F.col("_n") * F.lit(constant))
    return sums.select(*keys, "point", F.when(density > 0, F.log(density)).alias("log_density"))


def log_density_at(
    df: DataFrame,
    columns: Sequence[str],
    points: DataFrame,
    point_keys: Sequence[str],
    *,
    bandwidth: float,
    kernel: str = "gaussian",
    rows_per_cell: int = 10_000,
) -> DataFrame:
    """Kernel log density of the rows of ``df`` at every row of ``points``: (point_keys, log_density).

    Space is cut into cells as wide as the kernel reaches (the bandwidth of a
    top-hat, eight of a Gaussian, beyond which a row adds less than 1e-13 of its
    peak). Equal rows are counted and equal points asked once; a point looks into
    its own and the neighbouring cells, and a cell with more than
    ``rows_per_cell`` distinct rows is split, with its points copied to each part.
    A Gaussian is a product over the columns, so the rows of a part are summed
    along one column after the other: each step meets the points' distinct
    coordinates so far and keeps one sum per coordinate and what is left of the
    row, never more than all pairs of the cell. Where no row reaches a point the
    result is NULL; points with a missing coordinate are left out.
    """
    reach = bandwidth * (8.0 if kernel == "gaussian" else 1.0)
    sides = range(len(columns))
    values = {f"_r_{i}": F.col(c).cast("double") + F.lit(0.0) for i, c in enumerate(columns)}
    present = df.dropna(how="any", subset=list(columns))
    counted = present.select(*[v.alias(k) for k, v in values.items()]).groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
    cells = [f"_c_{i}" for i in sides]
    place = {c: F.floor(F.col(f"_r_{i}") / reach) for i, c in enumerate(cells)}
    counted = written(counted.withColumns(place), "rows")
    crowded = counted.groupBy(*cells).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_cell)
    crowded = crowded.select(*cells, F.ceil(F.col("_rows") / rows_per_cell).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    rows = counted.join(crowded, cells, "left").withColumn("_part", F.pmod(F.xxhash64(*values), parts).cast("int")).drop("_parts")
    at = [f"_x_{i}" for i in sides]
    asked = points.dropna(how="any", subset=list(columns)).select(*point_keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(x) for x, c in zip(at, columns, strict=True)])
    looked = asked.select(*at).distinct()
    for x, c in zip(at, cells, strict=True):
        own = F.floor(F.col(x) / reach)
        looked = looked.withColumn(c, F.explode(F.array(own - 1, own, own + 1)))
    looked = looked.join(crowded, cells, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    part = [*cells, "_part"]
    if kernel == "gaussian":
        sums = rows
        for i in sides:
            met = looked.select(*part, *at[: i + 1]).distinct().join(sums, [*part, *at[:i]])
            value, _ = _kernel(kernel, (F.col(f"_r_{i}") - F.col(at[i])) ** 2, bandwidth, 1)
            left = [f"_r_{j}" for j in sides if j > i]
            sums = met.groupBy(*(part if left else []), *at[: i + 1], *left).agg(F.sum(F.col("_n") * value).alias("_n"))
        sums = sums.withColumnRenamed("_n", "_s")
    else:
        squared = F.lit(0.0)
        for i in sides:
            squared = squared + (F.col(f"_r_{i}") - F.col(at[i])) ** 2
        value, _ = _kernel(kernel, squared, bandwidth, len(columns))
        sums = looked.join(rows, part).groupBy(*at).agg(F.sum(F.col("_n") * value).alias("_s"))
    _, constant = _kernel(kernel, F.lit(0.0), bandwidth, len(columns))
    found = attach(asked, sums, at, "left").groupBy(*point_keys).agg(F.sum("_s").alias("_s"))
    density = F.col("_s") / (present.agg(F.count(F.lit(1))).scalar() * F.lit(constant))
    return found.select(*point_keys, F.when(density > 0, F.log(density)).alias("log_density"))


def bandwidth_scores(
    df: DataFrame, column: str, bandwidths: Sequence[float], order: Sequence[str], *, folds: int = 5, bins: int = 32
) -> DataFrame:
    """Mean held-out log likelihood per row of a one-column Gaussian kernel, per bandwidth.

    Values are counted in cells of a ``bins``-th of a bandwidth, one count per
    fold, and stand at their cell's mean, which moves no value by more than a cell
    and changes a kernel sum by about ``1 / (24 * bins**2)`` of itself: 4e-5 by
    default. Cells of larger bandwidths are put together from those of the
    smallest. Only occupied cells count, so a far value costs nothing. Cells meet
    within eight bandwidths, through blocks of that width; a cell that meets
    nobody there looks as far as a kernel is more than nothing (38 bandwidths).
    """
    step = min(bandwidths) / bins
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"), *dict.fromkeys(o.lstrip("-") for o in order))
    folded = contiguous_folds(rows, order, folds)
    held = [f"n{f}" for f in range(folds)]
    in_fold = [F.count_if(F.col("fold") == f).alias(n) for f, n in enumerate(held)]
    cells = folded.groupBy(F.floor(F.col("_v") / step).alias("_cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("x"), *in_fold)
    cells = written(cells, "cells")
    options = F.array(*[F.lit(float(b)) for b in bandwidths])
    wide = cells.withColumn("bandwidth", F.explode(options)).groupBy("bandwidth", F.floor(F.col("x") * bins / F.col("bandwidth")).alias("_cell"))
    placed = wide.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in held])
    placed = written(placed, "cells")

    def sums(test: DataFrame, reach: float) -> DataFrame:
        """Kernel sums ``d0, d1 ...`` of a cell over the rows outside of each fold."""
        block = F.floor(F.col("x") / (F.col("bandwidth") * reach)).alias("_block")
        train = placed.select("bandwidth", block, F.col("x").alias("_x"), *[(F.col("n") - F.col(n)).alias(f"_{n}") for n in held])
        near = F.array(*[F.floor(F.col("x") / (F.col("bandwidth") * reach)) + k for k in (-1, 0, 1)])
        pairs = test.withColumn("_block", F.explode(near)).join(train, ["bandwidth", "_block"])
        gap = F.col("x") - F.col("_x")
        kernel = F.exp(-gap * gap / (2.0 * F.col("bandwidth") * F.col("bandwidth"))) / (F.col("bandwidth") * math.sqrt(2 * math.pi))
        totals = [F.sum(F.col(f"_{n}") * F.col("_k")).alias(f"d{f}") for f, n in enumerate(held)]
        return pairs.withColumn("_k", kernel).groupBy("bandwidth", "_cell").agg(*[F.max(n).alias(n) for n in held], *totals)

    near = written(sums(placed, 8.0), "densities")
    alone = " OR ".join(f"(n{f} > 0 AND d{f} = 0)" for f in range(folds))
    lone = placed.join(near.where(alone).select("bandwidth", "_cell"), ["bandwidth", "_cell"], "left_semi")
    density = near.where(f"NOT ({alone})").unionByName(sums(lone, 38.0))
    sizes = F.struct(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in held])
    density = density.withColumn("_all", cells.agg(sizes).scalar())
    score, count = F.lit(0.0), F.lit(0)
    for f, n in enumerate(held):
        mean = F.coalesce(F.try_divide(F.col(f"d{f}"), F.col("_all.n") - F.col(f"_all.{n}")), F.lit(0.0))
        score = score + F.col(n) * F.log(F.greatest(mean, F.lit(SMALLEST)))
        count = count + F.col(n)
    return density.groupBy("bandwidth").agg((F.sum(score) / F.sum(count)).alias("mean_log_likelihood"))


def normal_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ranks to normal scores, one column ``<name>_z`` each."""
    rows = df.dropna(how="any", subset=list(columns)).select(*columns)
    rows = pseudo_observations(rows, columns, suffix="_u")
    for c in columns:
        rows = add_normal_quantile(rows, f"{c}_u", f"{c}_z")
    return rows


def correlation_factor(scores: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Cholesky factor of the correlation matrix.

    Only the matrix (one cell per column pair) comes to the driver. If rounding
    or collinear columns leave it indefinite, negative eigenvalues become zero.
    """
    place = {c: i for i, c in enumerate(columns)}
    matrix = np.eye(len(columns))
    for row in pair_matrix(scores, columns).collect():
        value = 0.0 if row["correlation"] is None or math.isnan(row["correlation"]) else row["correlation"]
        if row["a"] != row["b"]:
            matrix[place[row["a"]], place[row["b"]]] = matrix[place[row["b"]], place[row["a"]]] = value
    values, vectors = np.linalg.eigh(matrix)
    if values.min() > 1e-10:
        return np.linalg.cholesky(matrix)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 0.0)))


def correlated_uniforms(spark, columns: Sequence[str], factor: np.ndarray, n: int, seed: int) -> DataFrame:
    """Long rows (sample, column, u) with normal dependence between the columns."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "sample")
    for c in columns:
        rows = add_normal_quantile(rows.withColumn("_p", hashed_uniform("sample", F.lit(c), seed=seed)), "_p", f"_e_{c}").drop("_p")
    mixed = {}
    for i, c in enumerate(columns):
        total = F.lit(0.0)
        for j, d in enumerate(columns):
            total = total + F.col(f"_e_{d}") * F.lit(float(factor[i, j]))
        mixed[f"_m_{c}"] = total
    rows = rows.withColumns(mixed)
    for c in columns:
        rows = add_normal_cdf(rows, f"_m_{c}", f"_u_{c}")
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"_u_{c}").alias("u")) for c in columns]
    return rows.select("sample", F.inline(F.array(*cells)))


def copula_samples(
    df: DataFrame, columns: Sequence[str], n: int, *, seed: int = 0, margins: str = "empirical", bins: int = 1000
) -> DataFrame:
    """``n`` rows with the margins of the data and its rank dependence (Gaussian copula).

    ``margins`` is ``empirical`` (interpolated order statistics) or
    ``histogram`` (bin edges of an equal-width density).
    """
    factor = correlation_factor(
        normal_scores(df, columns).select(*[F.col(f"{c}_z").alias(c) for c in columns]), columns
    )
    draws = correlated_uniforms(df.sparkSession, columns, factor, n, seed)
    if margins == "empirical":
        values = quantiles_at(df.dropna(how="any", subset=list(columns)), columns, draws)
    else:
        values = None
        for c in columns:
            part = histogram_quantile(histogram(df, c, bins), draws.where(F.col("column") == c))
            values = part if values is None else values.unionByName(part)
    return values.groupBy("sample").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def compare_columns(real: DataFrame, generated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column, from running shares of distinct values."""
    a = long_values(real, columns).select("column", "value", F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    b = long_values(generated, columns).select("column", "value", F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    both = a.unionByName(b).withColumn("value", F.col("value") + F.lit(0.0))
    counts = both.groupBy("column", "value").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    running = Ordered(counts, ["column"], ["value"], measure=both).running_sum("_ra", "_a").running_sum("_rb", "_b").build()
    totals = counts.groupBy("column").agg(F.struct(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb")).alias("_t"))
    gaps = running.withColumn("_t", per_column(totals, "_t")).select("*", "_t.*")
    gap = F.abs(F.try_divide(F.col("_ra"), F.col("_ta")) - F.try_divide(F.col("_rb"), F.col("_tb")))
    return gaps.groupBy("column").agg(F.max(gap).alias("ks_distance"))


def compare_pairs(real: DataFrame, generated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column pair in both frames and the absolute difference."""
    left = pair_matrix(real, columns).select("a", "b", F.col("correlation").alias("real"))
    right = pair_matrix(generated, columns).select("a", "b", F.col("correlation").alias("generated"))
    both = left.where(F.col("a") != F.col("b")).join(right, ["a", "b"])
    return both.withColumn("difference", F.abs(F.col("real") - F.col("generated")))
