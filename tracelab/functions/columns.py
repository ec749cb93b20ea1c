"""Small column expressions used across the package."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of a lookback such as "4w".
LOOKBACK_UNITS = {"w": "weeks", "d": "days", "h": "hours"}


def direction_code(ingoing: Column) -> Column:
    """Incoming is 0, outgoing is 1."""
    return F.when(ingoing, 0).otherwise(1)


def seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def hash_key(seed: str | int, *columns: Column | str) -> Column:
    """Reproducible pseudo-random text key of a row; sorting by it shuffles."""
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_unit(seed: str | int, *columns: Column | str) -> Column:
    """Reproducible pseudo-random number in [0, 1)."""
    return F.conv(F.substring(hash_key(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def moment(when: datetime | None) -> Column:
    """A given time, or now, without regard to time zones."""
    if when is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return F.expr(f"timestamp_ntz'{when:%Y-%m-%d %H:%M:%S.%f}'")


def lookback(text: str) -> timedelta:
    """``<integer><unit>`` with unit w, d or h."""
    found = re.fullmatch(r"(\d+)([a-z])", text)
    if not found or found.group(2) not in LOOKBACK_UNITS:
        raise ValueError(f"lookback {text!r} is not an integer followed by one of {sorted(LOOKBACK_UNITS)}")
    return timedelta(**{LOOKBACK_UNITS[found.group(2)]: int(found.group(1))})


def site_host(url: Column) -> Column:
    """The url up to and including its first ``onion``."""
    return F.concat(F.substring_index(url, "onion", 1), F.lit("onion"))


def is_monitored_class(class_name: Column) -> Column:
    return class_name.contains("sd")


def class_version(class_name: Column) -> Column:
    """Part of a monitored class name after its first underscore, else N/A."""
    return F.when(is_monitored_class(class_name), F.split_part(class_name, F.lit("_"), F.lit(2))).otherwise(F.lit("N/A"))


def first_class(text: Column, rules: list[tuple[str, str]], text_name: str = "text") -> Column:
    """Class of the first rule that holds; rules are (class name, Spark SQL predicate)."""
    picked: Column | None = None
    for name, predicate in rules:
        test = F.expr(predicate)
        picked = F.when(test, F.lit(name)) if picked is None else picked.when(test, F.lit(name))
    if picked is None:
        return F.lit(None).cast("string")
    return picked
