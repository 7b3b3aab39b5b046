"""Dates in text form, clock text, team names and regular expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Book team name -> code, where the rule below does not hold.
TEAM_CODE_OVERRIDES = {
    "WAS Nationals": "WSN",
    "CHI White Sox": "CHW",
    "CHI Cubs": "CHC",
}


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_day(column: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to timestamp; NULL where it does not parse."""
    return F.try_to_timestamp(_column(column), F.lit(pattern))


def days_before(column: Column | str, days: int) -> Column:
    return F.date_sub(_column(column).cast("date"), days)


def clock_to_timestamp(day: Column | str, clock: Column | str) -> Column:
    """A date and clock text like ``7:05 PM ET`` as a wall-clock timestamp."""
    bare = F.regexp_replace(F.trim(_column(clock)), r"\s*ET$", "")
    joined = F.concat_ws(" ", F.date_format(_column(day), "yyyy-MM-dd"), bare)
    return F.try_to_timestamp(joined, F.lit("yyyy-MM-dd h:mm a"))


def team_code(name: Column | str, overrides: Mapping[str, str] = TEAM_CODE_OVERRIDES) -> Column:
    """Short code of a team name.

    An override wins; else a two-letter city takes the first letter of the next
    word; else the first word is the code.
    """
    source = _column(name)
    words = F.split(F.trim(source), r"\s+")
    city = F.try_element_at(words, F.lit(1))
    nickname = F.try_element_at(words, F.lit(2))
    out = F.when(F.length(city) == 2, F.concat(city, F.substring(nickname, 1, 1))).otherwise(city)
    for text, code in overrides.items():
        out = F.when(source == text, F.lit(code)).otherwise(out)
    return out


def strip_tail(column: Column | str, pattern: str = ":.+") -> Column:
    return F.regexp_replace(_column(column), pattern, "")


def last_token(column: Column | str, separator: str = "-") -> Column:
    return F.substring_index(_column(column), separator, -1)
