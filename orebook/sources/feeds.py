"""JSON payloads: exchange rates and device records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES_SCHEMA = "base string, rates map<string, map<string, double>>"
DEVICE_SCHEMA = "device string, columns array<struct<name: string>>, records array<array<string>>"


def rates_long(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """``{"base": b, "rates": {date: {currency: x}}}`` to (rate_date, from_currency, to_currency, rate).

    The quote is turned round, ``1/x`` to eight places; null and zero quotes are dropped.
    """
    p = payloads.select(F.from_json(text, RATES_SCHEMA).alias("p"))
    days = p.select(F.col("p.base").alias("to_currency"), F.explode("p.rates").alias("d", "quotes"))
    quotes = days.select("to_currency", "d", F.explode("quotes").alias("from_currency", "x"))
    return quotes.filter("x is not null and x != 0").select(
        F.col("d").cast("date").alias("rate_date"), "from_currency", "to_currency", F.round(1 / F.col("x"), 8).alias("rate")
    )


def device_records(payloads: DataFrame, device: Column, name: Column, text: str = "payload") -> DataFrame:
    """Records as arrays to (device, name, record map); a payload that does not parse gives no rows.

    A record shorter than the list of columns is padded with null; one that is longer fits no
    column list and is left to :func:`unfit_records`.
    """
    rows = _records(payloads, device, name, text).filter("size(r) <= size(names)")
    padded = F.concat("r", F.array_repeat(F.lit(None).cast("string"), F.size("names") - F.size("r")))
    return rows.select("device_id", "device_name", F.map_from_arrays("names", padded).alias("record"))


def unfit_records(payloads: DataFrame, device: Column, name: Column, text: str = "payload") -> DataFrame:
    """What :func:`device_records` cannot place, with the reason: payloads that do not parse, records too long."""
    broken = payloads.filter(F.col(text).isNotNull() & F.from_json(text, DEVICE_SCHEMA)["records"].isNull()).select(
        device.alias("device_id"), name.alias("device_name"), F.lit("payload does not parse").alias("reason"), F.col(text).alias("content"))
    long = _records(payloads, device, name, text).filter("size(r) > size(names)").select(
        "device_id", "device_name", F.lit("more values than columns").alias("reason"), F.to_json("r").alias("content"))
    return broken.unionByName(long)


def _records(payloads: DataFrame, device: Column, name: Column, text: str) -> DataFrame:
    p = payloads.select(device.alias("device_id"), name.alias("device_name"), F.from_json(text, DEVICE_SCHEMA).alias("p"))
    names = F.transform("p.columns", lambda c: c["name"])
    return p.select("device_id", "device_name", names.alias("names"), F.explode("p.records").alias("r"))
