"""Category codes, one-hot columns and class balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.operators.joins import lookup
from pitchframe.operators.ordered import Ordered, top_rows
from pitchframe.operators.shape import label_difference


def label_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Code table of the distinct values in alphabetical order, starting at 0.

    Joined one way it encodes, the other way it decodes.
    """
    present = df.select(column).where(F.col(column).isNotNull())
    numbered = Ordered(present.distinct(), [], [column], measure=present).row_number("_rn").build()
    return numbered.select(column, (F.col("_rn") - 1).alias(code))


def encode_labels(df: DataFrame, column: str, codes: DataFrame, out: str, *, code: str = "code") -> DataFrame:
    return lookup(df, codes, {column: column}, {code: out})


def decode_labels(df: DataFrame, column: str, codes: DataFrame, out: str, *, label: str, code: str = "code") -> DataFrame:
    return lookup(df, codes, {column: code}, {label: out})


def ordinal_encode(df: DataFrame, column: str, codes: DataFrame, out: str, *, unseen: int = -1) -> DataFrame:
    """Codes of a fitted code table; a value it does not know gets ``unseen``."""
    encoded = lookup(df, codes, {column: column}, {"code": out})
    return encoded.withColumn(out, F.coalesce(F.col(out), F.lit(unseen).cast("long")))


def one_hot(df: DataFrame, column: str, categories: Sequence[str], prefix: str = "is_") -> DataFrame:
    """One 0/1 column per listed category; an unlisted value is 0 everywhere."""
    return df.withColumns(
        {f"{prefix}{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in categories}
    )


def balance_classes(
    train: DataFrame, test: DataFrame, label: str, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Copy the first row of each class that one side lacks from the other side."""
    missing = label_difference(train, test, label)

    def borrowed(source: DataFrame, side: str) -> DataFrame:
        wanted = missing.where(F.col("missing_in") == side).select(label)
        return top_rows(source.join(wanted, label, "left_semi"), [label], order, 1)

    return (
        train.unionByName(borrowed(test, "left")),
        test.unionByName(borrowed(train, "right")),
    )
