"""Classifiers with stored parameters, end to end."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchframe.operators import boosting
from pitchframe.operators.boosting import Boosted, Setting
from pitchframe.operators.encode import balance_classes
from pitchframe.operators.shape import columns_by_type
from pitchframe.operators.split import ordered_split
from pitchframe.plans.transitions import transition_table
from pitchframe.sources.registry import PARAMETER_DAYS, TABLE_DAYS
from pitchframe.sources.store import Store

TEST_SIZE = 0.2


def searched_setting(
    rows: DataFrame, target: str, numeric: Sequence[str], text: Sequence[str], order: Sequence[str], groups=tuple(boosting.GREEDY_GROUPS), start: Setting | None = None
) -> Setting:
    """The best setting of the greedy search on the earlier and later rows, after each side has got the classes it lacks."""
    marked = ordered_split(rows.where(F.col(target).isNotNull()), [], order, TEST_SIZE)
    train, test = marked.where("is_train").drop("is_train"), marked.where("NOT is_train").drop("is_train")
    train, test = balance_classes(train, test, target, order)
    return boosting.greedy_search(train, test, target, numeric, text, groups, start)[0]


def stored_classifier(
    store: Store, name: str, key: str, today: datetime.date, rows: DataFrame, target: str, order: Sequence[str], exclude: Sequence[str] = (), *,
    days: int = PARAMETER_DAYS, groups=tuple(boosting.GREEDY_GROUPS), start: Setting | None = None,
) -> Boosted:
    """A model of all rows with the stored setting, searched anew once it is older than ``days``; the model is stored as long.

    Features are all columns but the target, the order and ``exclude``.
    """
    kinds = columns_by_type(rows.drop(target, *order, *exclude))
    numeric, text = kinds["numeric"], kinds["text"]

    def fit() -> Boosted:
        setting = store.setting(f"{name}-parameters", key, today, days, lambda: searched_setting(rows, target, numeric, text, order, groups, start))
        return boosting.fit_boosted(rows, target, numeric, text, setting)

    return store.boosted(f"{name}-model", key, today, days, fit)


def stored_transitions(store: Store, today: datetime.date, pitches: DataFrame, *, days: int = TABLE_DAYS) -> DataFrame:
    """The transition table, fitted anew once the stored one is older than ``days``."""
    return store.table("transitions", "all", today, days, lambda: transition_table(pitches))
