"""Machine events: cleaning, priority dedup, day split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebook.operators.joins import keep_top

# Status priorities, and the state dropped before ranking.
STATUS_PRIORITY = {"Run": 1, "Planned Stop": 2, "Unplanned Stop": 3, "Not Scheduled": 4}
OTHER_PRIORITY = 99
DROPPED_STATE = "Detecting State"


def status_priority(status: Column, table: dict[str, int] = STATUS_PRIORITY, other: int = OTHER_PRIORITY) -> Column:
    out = None
    for name, rank in table.items():
        out = F.when(status == name, rank) if out is None else out.when(status == name, rank)
    return out.otherwise(other)


def drop_state(df: DataFrame, state: str, dropped: str = DROPPED_STATE) -> DataFrame:
    """Rows of every other state; a null state is dropped as well, as ``<>`` does. Stateless."""
    return df.filter(F.col(state) != dropped)


def clean_events(df: DataFrame, keys: Sequence[str], status: str, state: str, tiebreak: Sequence[str],
                 table: dict[str, int] = STATUS_PRIORITY, dropped: str = DROPPED_STATE) -> DataFrame:
    """One row per device and event: the status of the best priority wins."""
    order = [status_priority(F.col(status), table), *[F.col(t).asc_nulls_last() for t in tiebreak]]
    return keep_top(drop_state(df, state, dropped), keys, order)
