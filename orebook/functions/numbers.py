"""Numbers: guarded ratios, weights and quantities by unit, requirement rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors.
KG_TO_LB = 2.2046
KG_TO_LB_EXACT = 2.20462262184878
# Product forms measured by weight and by length.
WEIGHT_FORMS = ("BAR", "STRUCTURAL", "PLATE", "SHEET")
LENGTH_FORMS = ("TUBE", "EXTRUSION")


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; null where the divisor is zero or null."""
    return num / F.nullif(den, F.lit(0))


def ratio_guard(value: Column, den: Column, floor: float = 0.01) -> Column:
    """A given ratio, null where its divisor is about zero."""
    return F.when(F.abs(den) < floor, F.lit(None)).otherwise(value)


def to_lbs(qty: Column, uom: Column, weight_per_length: Column) -> Column:
    q, w = F.coalesce(qty, F.lit(0)), F.coalesce(weight_per_length, F.lit(0))
    return (
        F.when(uom == "LBS", q)
        .when(uom == "MT", q * w * KG_TO_LB)
        .when(uom == "KGS", q * KG_TO_LB)
        .otherwise(q * w)
    )


def native_qty(uom: Column, pieces: Column, length: Column, kg: Column, lbs: Column) -> Column:
    """On hand in the item's own unit; a length-based lot stores its total inches in ``pieces``."""
    return (
        F.when(uom == "PCS", F.round(ratio(pieces, length), 0))
        .when(uom == "FOOT", pieces / F.lit(12.0))
        .when(uom == "INCH", pieces)
        .when(uom == "KGS", kg)
        .when(uom == "POUNDS", lbs)
    )


def kg_to_lb(kg: Column) -> Column:
    return F.round(kg * KG_TO_LB_EXACT, 6)


def currency_of_site(site: Column, table: dict[str, Sequence[str]], default: str) -> Column:
    """Currency by site lists, ``{"EUR": [...], ...}``."""
    out = None
    for currency, sites in table.items():
        hit = site.isin(*sites)
        out = F.when(hit, F.lit(currency)) if out is None else out.when(hit, F.lit(currency))
    return out.otherwise(F.lit(default))


def required_qty(
    issued: Column, staged_lots: Column, expected: Column, form: Column,
    uom: Column, ordered: Column, weight: Column, cut_length: Column,
) -> Column:
    """Material a line still needs: none once issued or staged, else expected, else by form and unit."""
    unit = F.upper(uom)
    by_weight = F.when(unit == "LBS", ordered).otherwise(weight)
    by_length = (
        F.when(unit == "FT", ordered)
        .when(unit == "IN", ordered / F.lit(12.0))
        .otherwise(ordered * cut_length / F.lit(12.0))
    )
    return (
        F.when(issued > 0, F.lit(0))
        .when(staged_lots.isNotNull(), F.lit(0))
        .when(expected.isNotNull(), expected)
        .when(form.isin(*WEIGHT_FORMS), by_weight)
        .when(form.isin(*LENGTH_FORMS), by_length)
    )


def coerce(c: Column) -> Column:
    """Text to number; what is not a number counts as zero."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def unit_cost_value(usd: Column, qty: Column, other_qty: Column) -> Column:
    return ratio(usd, qty) * other_qty


def pick_by_site(site: Column, columns: dict[str, Column]) -> Column:
    """The column that belongs to the row's site; null for another site."""
    out = None
    for name, c in columns.items():
        out = F.when(site == name, c) if out is None else out.when(site == name, c)
    return out


def gated(value: Column, *gates: Column) -> Column:
    """``value`` unless a gate holds, gates tested in order."""
    out = None
    for g in gates:
        out = F.when(g, F.lit(None)) if out is None else out.when(g, F.lit(None))
    return value if out is None else out.otherwise(value)
