"""Text clean-up and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A page mark such as "3 of 10" (fixed value).
PAGE_MARK = r"\b[0-9]+ *of *[0-9]+\b"


def clean_text(text: Column) -> Column:
    """Runs of blanks become one space, then page marks go and the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "), PAGE_MARK, ""))


def format_duration(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600).cast("string"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("string"), F.pmod(whole, F.lit(60)).cast("string")
    return F.when(whole >= 3600, F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s"))).when(whole >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))


def format_size(size: Column) -> Column:
    out = F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1))).otherwise(out)
    return out
