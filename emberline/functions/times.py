"""Timestamp columns: per-format text to ISO text, ISO text to event time and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- Fixed values: accepted shapes. ---
_ISO_SHAPE = r"(?i)^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]{1,6})?Z?\z"
_ISO_SHAPE_OFFSET = (
    r"(?i)^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]{1,6})?"
    r"(Z|[+-][0-9]{2}:[0-9]{2})?\z"
)
_SYSLOG_SHAPE = r"^[A-Za-z]{3} [0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z"
_ANDROID_SHAPE = r"^[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{1,6}\z"
_BGL_SHAPE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})-([0-9]{2})\.([0-9]{2})\."
# --- End of fixed values. ---


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def iso_local(ts: Column) -> Column:
    """ISO text without zone; the fraction appears only when it is not zero."""
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(iso_seconds(ts), F.when(fraction == ".000000", F.lit("")).otherwise(fraction))


def iso_utc(ts: Column) -> Column:
    return F.concat(iso_local(ts), F.lit("+00:00"))


def parse_iso(text: Column, accept_offset: bool = False) -> Column:
    """UTC event time of the accepted shapes, null for anything else.

    ``accept_offset`` also takes a numeric zone, so that rendered output can be
    read back; off by default, since the ETL contract treats it as unparsable.
    """
    shape = _ISO_SHAPE_OFFSET if accept_offset else _ISO_SHAPE
    upper = F.upper(text)
    zoned = F.when(upper.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})\z"), upper).otherwise(F.concat(upper, F.lit("Z")))
    return F.when(text.rlike(shape), zoned.try_cast("timestamp"))


def syslog_time(text: Column, reference_year: int) -> Column:
    """``Mon d H:M:S`` as ISO text in ``reference_year``; unparsable text stays as it is."""
    squeezed = F.regexp_replace(text, r"(?U)\s+", " ")
    parsed = F.when(
        squeezed.rlike(_SYSLOG_SHAPE),
        F.try_to_timestamp(F.concat(F.lit(f"{reference_year:04d} "), squeezed), F.lit("yyyy MMM d H:m:s")),
    )
    return F.coalesce(iso_seconds(parsed), F.trim(text))


def android_time(text: Column, reference_year: int) -> Column:
    """``MM-dd H:M:S.f`` as ISO text in ``reference_year``; unparsable text stays as it is."""
    squeezed = F.regexp_replace(text, r"(?U)\s+", " ")
    iso = F.concat(F.lit(f"{reference_year:04d}-"), F.replace(squeezed, F.lit(" "), F.lit("T")))
    parsed = F.when(squeezed.rlike(_ANDROID_SHAPE), iso.try_cast("timestamp"))
    return F.coalesce(iso_local(parsed), F.trim(text))


def comma_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss,SSS`` as ISO text."""
    dotted = F.replace(text, F.lit(","), F.lit("."))
    return F.replace(dotted, F.lit(" "), F.lit("T"))


def bgl_time(text: Column) -> Column:
    """``yyyy-MM-dd-HH.mm.ss.ffffff`` as ISO text."""
    return F.regexp_replace(text, _BGL_SHAPE, "$1T$2:$3:")
