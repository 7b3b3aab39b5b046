"""Typed loads with a reject side.

A column whose stored type already is, or widens to, the declared one passes
through untouched, so predicates on it reach the scan. Any other value is
converted only where nothing is lost: ``543257.0`` is a whole number, ``12.7`` is
not. What does not fit is a problem of its row, and rows with problems go to a
reject side with the column, the value as text and the reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchframe.session import compiled_small, observed

# Texts that stand for a missing number or date in exported files.
MISSING = ["", "NaN", "nan", "null", "NULL", "None"]
PROBLEM = "array<struct<column:string,value:string,reason:string>>"
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}
_WHOLE = T.DecimalType(38, 9)


def passes(have: T.DataType, want: T.DataType) -> bool:
    """Whether every value of the stored type is one of the declared type."""
    if have == want or isinstance(have, T.NullType) or (isinstance(want, T.StringType) and isinstance(have, T.AtomicType)):
        return True
    if type(have) in _WIDTH and type(want) in _WIDTH:
        return _WIDTH[type(have)] <= _WIDTH[type(want)]
    if isinstance(want, T.TimestampType):
        return isinstance(have, (T.TimestampNTZType, T.DateType))
    if isinstance(want, T.DoubleType):
        return isinstance(have, (T.FloatType, T.IntegerType, T.ShortType, T.ByteType))
    return isinstance(have, T.DoubleType) and isinstance(want, T.FloatType)


def _present(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """``value``, NULL where it only says that nothing is there."""
    if isinstance(have, T.StringType) and not isinstance(want, T.StringType):
        text = F.trim(value)
        return F.when(~text.isin(MISSING), text)
    if isinstance(have, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def converted(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A present value in the declared type; NULL where it has none there."""
    direct = value.try_cast(want)
    if type(want) not in _WIDTH:
        return direct
    if isinstance(have, (T.StringType, T.FloatType, T.DoubleType, T.DecimalType)):
        # 30 places before the point hold any whole number of the declared types, nine behind it show what is lost.
        exact = value.try_cast(_WHOLE)
        whole = F.when(exact == F.floor(exact), exact.try_cast(want))
        if isinstance(have, T.StringType):
            # A text with a point never is a whole number as it stands; trying would cost an exception for each.
            return F.coalesce(F.when(~F.contains(value, F.lit(".")), direct), whole)
        return F.when(value == F.floor(value), whole)
    return direct


@dataclass(frozen=True)
class Checked:
    """Declared columns plus ``problems``; ``required`` and ``fallible`` name the columns that can have one."""

    frame: DataFrame
    columns: list[str]
    required: list[str]
    fallible: list[str]
    kept: list[str] = field(default_factory=list)

    def rows(self) -> DataFrame:
        """Rows without problems. Where only required columns can have one, the test is a plain NOT NULL of theirs."""
        rows = self.frame
        if self.fallible:
            rows = rows.where(F.size("problems") == 0)
        for c in self.required:
            rows = rows.where(F.col(c).isNotNull())
        return rows.select(*self.kept, *self.columns)

    def rejects(self) -> DataFrame:
        """``column, value, reason`` of every problem, with the kept and required columns of its row."""
        keys = [*self.kept, *[c for c in self.required if c not in self.kept]]
        return self.frame.where(F.size("problems") > 0).select(*keys, F.inline("problems"))

    def nulled(self) -> DataFrame:
        """All rows, values that don't fit as NULL; a missing required value fails the job."""
        names = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in self.required]), lambda c: c.isNotNull())
        rows = self.frame
        if self.required:
            complete = F.when(F.size(names) > 0, F.raise_error(F.concat(F.array_join(names, ", "), F.lit(" is missing"))).cast("boolean")).otherwise(True)
            rows = rows.where(complete)
        return rows.select(*self.kept, *self.columns)


def checked(
    df: DataFrame, schema: T.StructType, extras: Sequence[str] = (), keep: Sequence[str] = (), already: str | None = None
) -> Checked:
    """``df`` in the declared columns of ``schema``.

    Undeclared columns and ``extras`` are left out except for ``keep``, absent
    columns are NULL, and a missing value of a column that is declared not null
    is a problem. ``already`` names an array column of problems found before.
    """
    df = df.drop(*extras)
    stored = {f.name: f.dataType for f in df.schema.fields}
    columns, problems, troubled, fallible = [], [], [], []

    def problem(test: Column, what: Column) -> None:
        troubled.append(test)
        problems.append(F.when(test, what))

    # Present values and then typed ones have steps of their own, so that each is made once.
    presents, values, taken = [], [], {name.lower() for name in df.columns}
    required = [f.name for f in schema.fields if not f.nullable]
    for f in schema.fields:
        have = stored.get(f.name)
        raw = F.col(f"`{f.name}`")
        if have is None:
            value = F.lit(None).cast(f.dataType)
        elif passes(have, f.dataType):
            value = raw if have == f.dataType else raw.cast(f.dataType)
        else:
            made = [_unused(f"{step}_{f.name}", taken) for step in ("present", "typed")]
            present, value = (F.col(f"`{name}`") for name in made)
            presents.append(_present(raw, have, f.dataType).alias(made[0]))
            values.append(converted(present, have, f.dataType).alias(made[1]))
            fallible.append(f.name)
            lost = F.struct(F.lit(f.name).alias("column"), raw.cast("string").alias("value"), F.lit(f"not a {f.dataType.simpleString()}").alias("reason"))
            problem(present.isNotNull() & value.isNull(), lost)
            if f.name in required:
                problem(present.isNull(), _missing(f.name))
            columns.append(value.alias(f.name))
            continue
        if f.name in required:
            problem(value.isNull(), _missing(f.name))
        columns.append(value.alias(f.name))
    found = F.array().cast(PROBLEM)
    if problems:
        # Gathering is interpreted; a row without problems is spared it.
        found = F.when(reduce(or_, troubled), F.array_compact(F.array(*problems)).cast(PROBLEM)).otherwise(found)
    if already:
        found = F.concat(F.col(already), found)
        fallible.append(already)
    kept = [F.col(c) for c in keep if c not in schema.names]
    if presents:
        df = df.select("*", *presents).select("*", *values)
    frame = df.select(*kept, *columns, found.cast(PROBLEM).alias("problems"))
    return Checked(frame, list(schema.names), required, fallible, [c for c in keep if c not in schema.names])


def _unused(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name += "_"
    taken.add(name.lower())
    return name


def _missing(name: str) -> Column:
    return F.struct(F.lit(name).alias("column"), F.lit(None).cast("string").alias("value"), F.lit("missing").alias("reason"))


def load(source: Checked, target: str, partition_by: Sequence[str] = (), mode: str = "append") -> dict[str, int]:
    """Write both sides below ``target`` in one pass and return what was counted on the way.

    Rows are in ``state=accepted``, rejected ones with their problems in
    ``state=rejected``. The counts are ``read``, ``rejected`` and, as
    ``rejected_<column>``, the rows with a problem in a column.
    """
    seen = Observation()
    can = dict.fromkeys([*source.required, *[c for c in source.fallible if c in source.columns]])
    named = F.transform("problems", lambda p: p["column"])
    by_column = [F.count_if(F.array_contains("names", c)).alias(f"rejected_{c}") for c in can]
    counted = source.frame.withColumn("names", named).observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(F.size("problems") > 0).alias("rejected"), *by_column
    )
    state = F.when(F.size("problems") > 0, "rejected").otherwise("accepted")
    out = counted.drop("names").withColumn("state", state)
    parts = ["state", *partition_by]
    with compiled_small(out.sparkSession):
        out.hint("rebalance", *[F.col(c) for c in parts]).write.mode(mode).partitionBy(*parts).parquet(target)
    return {name: n for name, n in observed(seen, "read", "rejected").items() if n or name in ("read", "rejected")}


def accepted(df: DataFrame, target: str) -> DataFrame:
    """The accepted rows that :func:`load` wrote, with the columns of ``df``'s schema: their types fit, so predicates prune."""
    return df.sparkSession.read.schema(df.schema).parquet(f"{target}/state=accepted")
