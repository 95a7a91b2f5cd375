"""Text parsing: composite keys, suffixes, two-digit years, reasons, JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Item variant suffixes.
COMPONENT_SUFFIXES = (".CO", ".BO", ".XP")
ITEM_SUFFIX = r"(_1(-P)?(\.(BO|CO|MO|MC))?|-P(\.(BO|CO|MO|MC))?|\.(BO|CO|MO|MC))$"


def has_star(c: Column) -> Column:
    return F.instr(c, "*") > 0


def star_part(c: Column, n: int) -> Column:
    """Segment ``n`` of ``order*line*shipment``; null for a text without ``*``."""
    return F.when(has_star(c), F.split_part(c, F.lit("*"), F.lit(n)))


def assembly_key(c: Column) -> list[Column]:
    return [
        has_star(c).alias("is_assembly"),
        star_part(c, 1).alias("assembly_order"),
        star_part(c, 2).alias("assembly_line"),
        star_part(c, 3).alias("assembly_shipment"),
    ]


def linked_key(direct: dict[str, Column], item: Column) -> list[Column]:
    """Order, line and shipment of a job: the direct value, else the segment of its item key.

    The item key counts only when its third segment is not empty.
    """
    usable = has_star(item) & (F.split_part(item, F.lit("*"), F.lit(3)) != "")
    first = next(iter(direct.values()))
    cols = [F.when(first.isNotNull(), F.lit("default")).when(usable, F.lit("assembly")).alias("link_source")]
    for n, (name, c) in enumerate(direct.items(), start=1):
        cols.append(F.coalesce(c, F.when(usable, F.split_part(item, F.lit("*"), F.lit(n)))).alias(name))
    return cols


def line_ship(c: Column) -> tuple[Column, Column]:
    """``line.ship`` to its two parts; ``.`` and blank mean none."""
    v = F.when(~F.trim(c).isin(".", ""), F.trim(c))
    return F.split_part(v, F.lit("."), F.lit(1)), F.split_part(v, F.lit("."), F.lit(2))


def order_key(c: Column) -> tuple[Column, Column, Column]:
    """``ORDER-LINE.SHIP`` to its three parts."""
    tail = F.split_part(c, F.lit("-"), F.lit(2))
    return (
        F.split_part(c, F.lit("-"), F.lit(1)),
        F.split_part(tail, F.lit("."), F.lit(1)),
        F.split_part(tail, F.lit("."), F.lit(2)),
    )


def strip_component_suffix(c: Column, suffixes: tuple[str, ...] = COMPONENT_SUFFIXES) -> Column:
    """The item without its suffix; the first suffix that ends the text is replaced."""
    out = None
    for s in suffixes:
        cond, value = c.endswith(s), F.replace(c, F.lit(s), F.lit(""))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(c)


def clean_item(c: Column) -> Column:
    return F.regexp_replace(c, ITEM_SUFFIX, "")


def strip_point_zero(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0$", "")


def two_digit_year_date(c: Column) -> Column:
    """``18-JUN-26`` to a date in this century; anything else is null."""
    full = F.regexp_replace(F.trim(c), r"(\d{2})$", "20$1")
    return F.try_to_timestamp(full, F.lit("dd-MMM-yyyy")).cast("date")


def id_text(c: Column) -> Column:
    """``123.0`` to ``123``; not a number is null."""
    return c.try_cast("double").cast("bigint").cast("string")


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def lookup(c: Column, table: dict) -> Column:
    """A literal dictionary; a key it does not hold is null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def reason_list(*reasons: Column, sep: str = "; ") -> Column:
    return F.concat_ws(sep, *reasons)


def jsonify(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for a flat file."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
          for f in df.schema.fields]
    )
