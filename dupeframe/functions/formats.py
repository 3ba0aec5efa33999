"""Display formats of sizes, times and lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Units per display style, each 1024 times the one before.
UNITS = {
    "scan": ("B", "KB", "MB", "GB", "TB", "PB"),
    "handler": ("B", "KB", "MB", "GB", "TB"),
    "web": ("B", "KB", "MB", "GB", "TB"),
}


def _two_decimals(value: Column) -> Column:
    # format_string alone rounds half up; the printed value must be rounded half even
    return F.format_string("%.2f", F.bround(value, 2))


def _two_decimals_trimmed(value: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", F.round(value, 2)), r"\.?0+$", "")


def format_size(size: Column, style: str = "scan") -> Column:
    """Human-readable size in the style of the scan, the decision list or the web view."""
    units = UNITS[style]
    render = _two_decimals_trimmed if style == "web" else _two_decimals
    scaled = [
        F.concat(render(size / F.lit(float(1024 ** power))), F.lit(" " + unit))
        for power, unit in enumerate(units)
    ]
    if style != "handler":
        scaled[0] = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    text = scaled[-1]
    for power in range(len(units) - 2, -1, -1):
        text = F.when(size < F.lit(1024 ** (power + 1)), scaled[power]).otherwise(text)
    return text


def format_mtime(mtime: Column, tz: str | None = None) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in ``tz`` (default: the session time zone)."""
    stamp = F.timestamp_micros(F.bround(mtime * 1000000, 0).cast("long"))
    if tz is not None:
        stamp = F.convert_timezone(
            F.current_timezone(), F.lit(tz), stamp.cast("timestamp_ntz")
        )
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")


def join_list(values: Column) -> Column:
    return F.array_join(values, ", ")


def rate_percent(part: Column, total: Column) -> Column:
    return part / total * 100
