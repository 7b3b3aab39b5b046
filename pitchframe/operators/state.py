"""Counts, runner tracking and base/out state transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.aggregate import attach, conditional_distribution
from pitchframe.operators.ordered import Ordered
from pitchframe.operators.sampling import draw
from pitchframe.operators.shape import domain_product

BASES = ("on_1b", "on_2b", "on_3b")
AFTER = ("after_outs", "after_1b", "after_2b", "after_3b", "runs_scored")


COUNT_SUMS = ("_swings", "_balls", "_lates", "_reset")


def count_sums(
    df: DataFrame, at_bat: Sequence[str], order: Sequence[str], outcome: str, carry: DataFrame | None = None
) -> DataFrame:
    """Running sums behind the ball/strike count, on top of the sums carried over per at-bat."""
    kind = F.col(outcome)
    if carry is None:
        start = {f"{c}0": F.lit(None).cast("long") for c in COUNT_SUMS}
        rows = df.withColumns(start)
    else:
        rows = attach(df, carry.withColumnsRenamed({c: f"{c}0" for c in COUNT_SUMS}), at_bat, "left")
    given = lambda c: F.coalesce(F.col(f"{c}0"), F.lit(0))
    flag = lambda test: F.coalesce(test.cast("long"), F.lit(0))
    sums = Ordered(rows, at_bat, order)
    first = (
        sums.running_sum("_swings", flag(kind.isin("strike", "foul")))
        .running_sum("_balls", flag(kind == "ball"))
        .build()
    )
    first = first.withColumns({c: F.col(c) + given(c) for c in ("_swings", "_balls")})
    first = first.withColumns(
        {
            "_late": flag((kind == "strike") & (F.col("_swings") > 2)),
            "_mark": F.when(kind == "hit_by_pitch", F.col("_balls")),
        }
    )
    second = sums.again(first).running_sum("_lates", "_late").running_max("_reset", "_mark").build()
    return second.withColumns(
        {"_lates": F.col("_lates") + given("_lates"), "_reset": F.greatest("_reset", "_reset0")}
    ).drop("_late", "_mark", *[f"{c}0" for c in COUNT_SUMS])


def running_count(
    df: DataFrame, at_bat: Sequence[str], order: Sequence[str], outcome: str, carry: DataFrame | None = None
) -> DataFrame:
    """Balls and strikes after each pitch, and the event that ends the at-bat.

    The clamped fold has a closed form in running sums, so it splits like any
    other ordered operator: the first two strikes-or-fouls always add a strike,
    after them only strikes do; a hit-by-pitch sets the balls to four. ``event``
    is ``walk`` above three balls, else ``K`` above two strikes.
    """
    return finish_count(count_sums(df, at_bat, order, outcome, carry)).drop(*COUNT_SUMS)


def finish_count(sums: DataFrame) -> DataFrame:
    reset = F.col("_reset")
    balls = F.when(reset.isNull(), F.col("_balls")).otherwise(F.col("_balls") - reset + 4)
    strikes = F.least(F.col("_swings"), F.lit(2)) + F.col("_lates")
    return sums.withColumns({"balls_after": balls.cast("long"), "strikes_after": strikes.cast("long")}).withColumn(
        "event", F.when(F.col("balls_after") > 3, "walk").when(F.col("strikes_after") > 2, "K")
    )


def previous_holder(occupant: Column, batter: Column, first: Column, second: Column, third: Column) -> Column:
    """Where a runner stood before the play; NULL for an empty base or a runner not seen before.

    When an id occurs twice the later base wins.
    """
    return (
        F.when(occupant == third, "3b")
        .when(occupant == second, "2b")
        .when(occupant == first, "1b")
        .when(occupant == batter, "batter")
    )


def track_runners(df: DataFrame, batter: str = "batter", bases: Sequence[str] = BASES, after: str = "_after") -> DataFrame:
    """Adds ``after_1b`` to ``after_3b``: the previous position of each later occupant."""
    before = [F.col(b) for b in bases]
    names = ("after_1b", "after_2b", "after_3b")
    return df.withColumns(
        {n: previous_holder(F.col(f"{b}{after}"), F.col(batter), *before) for n, b in zip(names, bases)}
    )


def next_state(
    df: DataFrame,
    half: Sequence[str],
    order: Sequence[str],
    outs: str = "outs_when_up",
    bases: Sequence[str] = BASES,
) -> DataFrame:
    """State after each row: the next row of the half-inning, else three outs and empty bases."""
    ordered = Ordered(df, half, order).lead("after_outs", outs, 1, 3)
    for base in bases:
        ordered.lead(f"{base}_after", base)
    return ordered.build()


def fit_transitions(
    df: DataFrame,
    half: Sequence[str],
    order: Sequence[str],
    *,
    outcome: str = "simplified_outcome",
    stand: str = "stand",
    batter: str = "batter",
    outs: str = "outs_when_up",
    bases: Sequence[str] = BASES,
    runs: str = "runs_scored",
) -> DataFrame:
    """Distribution of the state after, per outcome, stand and state before.

    The next row is looked up before rows without an outcome class are dropped.
    """
    rows = next_state(df, half, order, outs, bases).where(F.col(outcome).isNotNull())
    rows = track_runners(rows, batter, bases)
    flags = {f"{b}_before": F.col(b).isNotNull() for b in bases}
    rows = rows.withColumns(flags).select(
        F.col(outcome).alias("outcome"),
        F.col(stand).alias("stand"),
        F.col(outs).alias("outs"),
        *[F.col(f"{b}_before").alias(n) for b, n in zip(bases, BASES)],
        *[F.col(c) for c in AFTER[:4]],
        F.col(runs).alias("runs_scored"),
    )
    return conditional_distribution(rows, ["outcome", "stand", "outs", *BASES], AFTER)


def forced_transition(event: Column, outs: Column, first: Column, second: Column, third: Column) -> Column:
    """Struct of the certain state after a strike-out or a walk; NULL for other events.

    A strike-out adds an out. A walk pushes runners only as far as they are
    forced, and a run scores only from loaded bases.
    """
    stay1 = F.when(first, F.lit("1b"))
    stay2 = F.when(second, F.lit("2b"))
    stay3 = F.when(third, F.lit("3b"))
    strike_out = F.struct(
        (outs + 1).cast("int").alias(AFTER[0]),
        stay1.alias(AFTER[1]),
        stay2.alias(AFTER[2]),
        stay3.alias(AFTER[3]),
        F.lit(0).alias(AFTER[4]),
    )
    walk = F.struct(
        outs.cast("int").alias(AFTER[0]),
        F.lit("batter").alias(AFTER[1]),
        F.when(first, F.lit("1b")).otherwise(stay2).alias(AFTER[2]),
        F.when(first & second, F.lit("2b")).otherwise(stay3).alias(AFTER[3]),
        F.when(first & second & third, 1).otherwise(0).alias(AFTER[4]),
    )
    return F.when(event == "K", strike_out).when(event == "walk", walk)


def forced_table(spark) -> DataFrame:
    """The certain transitions of all 24 base/out states, long form."""
    states = domain_product(
        spark,
        {"outcome": ["K", "walk"], "outs": [0, 1, 2], "on_1b": [True, False], "on_2b": [True, False], "on_3b": [True, False]},
    )
    after = forced_transition(*[F.col(c) for c in ("outcome", "outs", *BASES)])
    return states.withColumn("_after", after).select("outcome", "outs", *BASES, "_after.*")


def apply_transitions(states: DataFrame, table: DataFrame, u: str) -> DataFrame:
    """State after each row of ``states`` (outcome, stand, outs, bases and ``u``).

    Strike-outs and walks follow from an expression; the rest is drawn from the
    fitted table. A state the table never saw keeps NULL.
    """
    drawn = draw(states, table, ["outcome", "stand", "outs", *BASES], AFTER, "n", u, bounded=True)
    certain = forced_transition(*[F.col(c) for c in ("outcome", "outs", *BASES)])
    fixed = drawn.withColumn("_certain", certain)
    out = {}
    for name in AFTER:
        out[name] = F.when(F.col("_certain").isNotNull(), F.col(f"_certain.{name}")).otherwise(F.col(name))
    return fixed.withColumns(out).drop("_certain")


def move_occupants(
    df: DataFrame, batter: str = "batter", bases: Sequence[str] = BASES, holders: Sequence[str] = AFTER[1:4], suffix: str = "_new"
) -> DataFrame:
    """Ids on the bases after a transition that names each base's previous holder."""
    def occupant(holder: str) -> Column:
        out = F.when(F.col(holder) == "batter", F.col(batter))
        for label, base in zip(("1b", "2b", "3b"), bases):
            out = out.when(F.col(holder) == label, F.col(base))
        return out

    return df.withColumns({f"{b}{suffix}": occupant(h) for b, h in zip(bases, holders)})
