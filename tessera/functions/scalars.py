"""Scalar column helpers shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(text: str) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


# --- dates -------------------------------------------------------------------

def day_bucket(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyyMMdd")


def hour_bucket(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyyMMddHH")


def iso_utc(c: str | Column) -> Column:
    """ISO-8601 text with a ``+00:00`` offset; microseconds only when present, NULL gives ``''``."""
    stamp = col(c).cast("timestamp_ntz")
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(stamp, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.coalesce(F.concat(whole, fraction, F.lit("+00:00")), F.lit(""))


def seconds_between(earlier: str | Column, later: str | Column) -> Column:
    """Seconds with microseconds; both stamps are zone-free, so no session zone plays a part."""
    span = col(later).cast("timestamp_ntz") - col(earlier).cast("timestamp_ntz")
    part = lambda field: F.extract(F.lit(field), span)
    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return (minutes.cast("decimal(18,0)") * 60 + part("SECOND")).cast("double")


def minutes_between(earlier: str | Column, later: str | Column) -> Column:
    return seconds_between(earlier, later) / F.lit(60.0)


def days_before(now: Column, days: str | int | Column) -> Column:
    """``now`` cut to whole seconds, minus ``days``."""
    n = F.lit(days) if isinstance(days, int) else col(days)
    return F.date_trunc("second", now).cast("timestamp_ntz") - F.make_dt_interval(days=n.cast("int"))


# --- strings and numbers -----------------------------------------------------

def compose_key(*parts: str | Column) -> Column:
    """Colon-joined key; string parts are literals, columns are cast."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def truncated(c: str | Column, limit: int = 2048) -> Column:
    return F.substring(col(c), 1, limit)


def is_blank(c: str | Column) -> Column:
    return F.trim(col(c)) == ""


def fixed_decimal(c: str | Column, scale: int = 4) -> Column:
    """Plain decimal text, never in scientific form; NULL gives ``'0'``."""
    return F.coalesce(col(c).cast(f"decimal(38,{scale})").cast("string"), F.lit("0"))


def clamp_low(c: str | Column, low) -> Column:
    return F.greatest(col(c), F.lit(low))


def ratio(numerator: Column, denominator: Column, floor: float = 0.001) -> Column:
    """Quotient with the denominator held at ``floor`` or above."""
    return numerator / F.greatest(denominator.cast("double"), F.lit(floor))


def int_or_null(c: str | Column) -> Column:
    return col(c).try_cast("bigint")


# --- arrays, maps and JSON ---------------------------------------------------

def known_keys(m: str | Column, keys: Sequence[str]) -> Column:
    return F.map_filter(col(m), lambda k, _: k.isin(*keys))


def ignored_keys(m: str | Column, keys: Sequence[str]) -> Column:
    """Keys outside ``keys``, sorted."""
    return F.array_sort(F.array_except(F.map_keys(col(m)), F.array(*[F.lit(k) for k in keys])))


def json_or(c: str | Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(col(c), path), F.lit(default))


def map_text(m: str | Column) -> Column:
    """``key=value`` pairs sorted by key and joined by ``;`` for printing and comparison."""
    pairs = F.transform(F.map_entries(col(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")
