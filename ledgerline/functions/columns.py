"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, or 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def bucket(seconds: Column, width: int) -> Column:
    """The start of the bucket of `width` seconds, for times before the epoch too."""
    return seconds - F.pmod(seconds, F.lit(width))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place round((n - 1) * share) of an ascending array; 0 for an empty one."""
    place = F.round((F.size(values) - 1) * F.lit(share)).cast("int")
    return F.when(F.size(values) > 0, F.get(values, place)).otherwise(F.lit(0))


def normalized_span(message: Column) -> Column:
    """A message without source positions, white space runs as one space."""
    # few messages name a source file, and looking for one from each place of a line takes long
    plain = F.when(F.contains(message, F.lit(".rs:")), F.regexp_replace(message, r"[A-Za-z0-9_./-]+\.rs:[0-9]+(:[0-9]+)?", "")).otherwise(message)
    plain = F.regexp_replace(plain, r":[0-9]+:[0-9]+", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def plain_text(line: Column) -> Column:
    """A line without terminal escape sequences."""
    out = F.regexp_replace(line, "\x1b\\][^\x07\x1b]*(\x07|\x1b\\\\|$)", "")
    out = F.regexp_replace(out, "\x1b\\[[0-9;?]*([ -/]*[@-~]|$)", "")
    return F.regexp_replace(out, "\x1b([@-Z\\\\-_]|$)", "")


def length_prefixed(*parts: Column) -> Column:
    """Parts joined with their byte lengths before them, so that no two lists of parts read alike."""
    return F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)])


def human_bytes(n: Column) -> Column:
    """Bytes below a KiB as they are, else with one decimal in the largest unit that fits."""
    kib, mib, gib = float(1 << 10), float(1 << 20), float(1 << 30)
    return F.when(n < kib, F.format_string("%d B", n)).when(n < mib, F.format_string("%.1f KiB", n / kib)).when(n < gib, F.format_string("%.1f MiB", n / mib)).otherwise(F.format_string("%.1f GiB", n / gib))
