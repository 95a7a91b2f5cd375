"""Cleaning: declarative column specs, null sentinels, invisible characters."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts the CSV reader treats as missing, the feed's own list first.
FEED_NA = ("Undefined", "N/A", "", "NULL", "error", "#DIV/0!")
# Texts a CSV reader of data frames treats as missing by default.
DEFAULT_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
NA_TEXTS = tuple(dict.fromkeys(FEED_NA + DEFAULT_NA))

# Dates that stand for "no date".
NO_DATES = (dt.date(1900, 1, 1), dt.date(1970, 1, 1))
NO_DATE_TEXTS = ("0-00-00",)

# Zero-width and bidirectional control characters.
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF]"


def na_to_null(c: Column, texts: Sequence[str] = NA_TEXTS) -> Column:
    return F.when(~c.isin(*texts), c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def blank_to_null_cast(c: Column, type_: str, lenient: bool = False) -> Column:
    """``''`` becomes null before the cast; lenient turns other bad text into null as well."""
    c = blank_to_null(F.trim(c))
    return c.try_cast(type_) if lenient else c.cast(type_)


def no_date_to_null(c: Column, dates: Sequence[dt.date] = NO_DATES) -> Column:
    return F.when(~c.isin(*dates), c)


def no_date_text_to_null(c: Column, texts: Sequence[str] = NO_DATE_TEXTS, fmt: str = "yyyy-MM-dd") -> Column:
    """Parse a text date whose sentinels mean "no date"; unparsable text is null too."""
    return F.try_to_timestamp(F.when(~c.isin(*texts), c), F.lit(fmt)).cast("date")


def strip_invisible(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, INVISIBLE, ""), F.lit("nan"))


def strip_invisible_all(df: DataFrame) -> DataFrame:
    """Every text column without invisible characters, in one projection."""
    return df.select(
        *[strip_invisible(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string"
          else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


@dataclass(frozen=True)
class ColumnSpec:
    """How one raw column becomes a typed one."""

    source: str
    name: str
    type: str = "string"
    lower: bool = False
    no_date: bool = False
    blank_null: bool = False
    lenient: bool = False

    def column(self) -> Column:
        c = F.col(f"`{self.source}`")
        if self.type == "string" or self.blank_null:
            c = F.trim(c)
        if self.lower:
            c = F.lower(c)
        if self.blank_null:
            c = blank_to_null(c)
        if self.type != "string" or self.blank_null:
            c = c.try_cast(self.type) if self.lenient else c.cast(self.type)
        if self.no_date:
            c = no_date_to_null(c)
        return c.alias(self.name)


def clean(df: DataFrame, specs: Iterable[ColumnSpec], required: Sequence[str] = ()) -> DataFrame:
    """Rename, trim and type columns by their specs; drop rows without a required key."""
    out = df.select(*[s.column() for s in specs])
    for key in required:
        out = out.filter(F.col(key).isNotNull())
    return out


def header_simple(name: str) -> str:
    """``%`` to ``pct``, blanks to ``_``."""
    return name.strip().replace("%", "pct").replace(" ", "_")


def headers_strict(names: Sequence[str]) -> list[str]:
    """Lower-case, every run of other characters to one ``_``; a blank header is ``col_<i>``."""
    plain = [re.sub(r"[^a-z0-9]+", "_", n.replace(" ", " ").strip().lower()).strip("_") for n in names]
    return [n or f"col_{i}" for i, n in enumerate(plain)]
