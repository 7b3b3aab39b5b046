"""Equi-joins: inserts of new keys, lookups, profiles and id maps.

No join here forces a broadcast. File-backed dimensions are broadcast by the
optimizer when their size on disk is under the threshold; a derived side is
switched to a broadcast at run time once its shuffle has been measured. Beyond
the threshold the joins shuffle, and a hot key is split by the adaptive skew
join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.ordered import top_rows


def only_new(
    incoming: DataFrame,
    stored: DataFrame,
    key: Sequence[str],
    *,
    date: str | None = None,
    look_back_days: int = 2,
    high_water: object = None,
) -> DataFrame:
    """Incoming rows whose key is not stored yet, once per key: of rows that repeat a key, the one with the smallest values.

    With ``date`` and ``high_water`` only stored keys strictly later than
    ``high_water - look_back_days`` are read, which prunes the stored side.
    """
    if date is not None and high_water is not None:
        edge = F.date_sub(F.lit(high_water).cast("date"), look_back_days)
        stored = stored.where(F.col(date) > edge.cast(stored.schema[date].dataType))
    keys = stored.select(*key)
    return first_of_key(incoming.join(keys, list(key), "left_anti"), key)


def first_of_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, the one with the smallest other values, whatever order the rows come in."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def merge_sides(left: DataFrame, right: DataFrame, key: Sequence[str], out: str = "side") -> DataFrame:
    """Full outer join of two key sets with the side each key came from."""
    a = left.select(*key, F.lit(True).alias("_l"))
    b = right.select(*key, F.lit(True).alias("_r"))
    side = (
        F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    )
    return a.join(b, list(key), "full_outer").withColumn(out, side).drop("_l", "_r")


def missing_keys(facts: DataFrame, known: DataFrame, fact_key: str, known_key: str) -> DataFrame:
    """Distinct keys of the facts that the lookup does not know."""
    keys = facts.select(fact_key).where(F.col(fact_key).isNotNull()).distinct()
    return keys.join(known.select(F.col(known_key).alias(fact_key)), fact_key, "left_anti")


def restrict_to(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other frame."""
    return df.join(allowed.select(*keys), list(keys), "left_semi")


def restrict_to_latest(
    df: DataFrame, groups: DataFrame, entity: Sequence[str], group: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """Rows that belong to the latest ``n`` groups (games) of their entity."""
    latest = top_rows(groups, entity, order, n)
    return restrict_to(df, latest, [*entity, *group])


def lookup(
    df: DataFrame, table: DataFrame, on: Mapping[str, str], take: Mapping[str, str] | Sequence[str]
) -> DataFrame:
    """Left join that adds columns of a lookup table.

    ``on`` maps columns of ``df`` to columns of ``table``; ``take`` lists the
    columns to add or maps them to new names.
    """
    names = dict(take) if isinstance(take, Mapping) else {c: c for c in take}
    side = table.select(
        *[F.col(b).alias(f"_on_{a}") for a, b in on.items()], *[F.col(c).alias(n) for c, n in names.items()]
    )
    condition = None
    for a in on:
        test = df[a] == F.col(f"_on_{a}")
        condition = test if condition is None else condition & test
    return df.join(side, condition, "left").drop(*[f"_on_{a}" for a in on])


def join_wide(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Left join of two wide tables on one key, each with its own column suffix."""
    from pitchframe.operators.shape import add_suffix

    a = add_suffix(left, suffixes[0], except_for=[key])
    return a.join(add_suffix(right, suffixes[1], except_for=[key]), key, "left")


def profile(df: DataFrame, parts: Sequence[tuple[DataFrame, str]], key: str, defaults: Mapping[str, object]) -> DataFrame:
    """One record per entity from several one-key lookups, with defaults where nothing is known."""
    for table, table_key in parts:
        columns = [c for c in table.columns if c != table_key]
        df = lookup(df, table, {key: table_key}, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def first_entry(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key, for id maps with repeated entries."""
    return top_rows(df, key, order, 1)


def resolve_ids(
    df: DataFrame, id_map: DataFrame, left_id: str, right_id: str, order: Sequence[str]
) -> DataFrame:
    """Fill whichever of two ids is missing from a two-way map; the first map entry wins."""
    forward = first_entry(id_map.where(F.col(left_id).isNotNull()), [left_id], order)
    backward = first_entry(id_map.where(F.col(right_id).isNotNull()), [right_id], order)
    out = lookup(df, forward, {left_id: left_id}, {right_id: "_to_right"})
    out = lookup(out, backward, {right_id: right_id}, {left_id: "_to_left"})
    return out.withColumns(
        {
            left_id: F.coalesce(F.col(left_id), F.col("_to_left")),
            right_id: F.coalesce(F.col(right_id), F.col("_to_right")),
        }
    ).drop("_to_left", "_to_right")


def with_overrides(table: DataFrame, key: str, value: str, patches: Mapping[object, object]) -> DataFrame:
    """A lookup table where single keys are patched."""
    out: Column = F.col(value)
    for k, v in patches.items():
        out = F.when(F.col(key) == F.lit(k), F.lit(v)).otherwise(out)
    return table.withColumn(value, out)
