"""Time stamps: declared patterns, inference over every row, and UTC nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError

#: The patterns that are tried, as strptime writes them.
PATTERNS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y",
    "%m.%d.%Y %H:%M:%S", "%m.%d.%Y %H:%M", "%m.%d.%Y", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y",
    "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%Y/%m/%d %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%m-%d-%Y %H:%M:%S", "%Y%m%d %H:%M:%S", "%Y%m%d",
)
#: Single letters read one digit or two, as exports leave out leading zeros; without signs between them two are needed.
_LETTERS = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}
_RUN_TOGETHER = {"%Y%m%d": "yyyyMMdd"}


def spark_pattern(pattern: str) -> str:
    out = pattern.replace("T", "'T'")
    for a, b in (_RUN_TOGETHER | _LETTERS).items():
        out = out.replace(a, b)
    if "%" in out:
        raise SchemaError(f"no such time format here: {pattern}")
    return out


SPARK_PATTERNS = {p: spark_pattern(p) for p in PATTERNS}


def wall_clock(c: Column, pattern: str) -> Column:
    """Local microseconds as if in UTC, null where the text doesn't fit the pattern."""
    stamp = F.try_to_timestamp(F.concat(F.trim(c), F.lit(" +0000")), F.lit(spark_pattern(pattern) + " Z"))
    return F.unix_micros(stamp)


def parse_column(c: Column, pattern: str | None, timezone: str | None) -> Column:
    """UTC nanoseconds, null where unreadable. Without a pattern ISO 8601 is read.

    A stamp with an offset keeps it. Others stand in ``timezone``; a stamp that the zone skips, or that comes
    twice there when clocks go back, is unreadable: no instant is guessed. Without a zone they are unreadable too.
    """
    text = F.trim(c)
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d{2}:\d{2}")
    own = F.unix_micros(text.try_cast("timestamp")) * 1000
    naive = wall_clock(c, pattern) if pattern else F.coalesce(*[wall_clock(c, p) for p in PATTERNS[:4]])
    if timezone is None:
        return F.when(aware, own)
    # instants are moved by the zone's offset on a clock of micros, so the session's own zone plays no part
    return F.when(aware, own).otherwise(with_value(naive, lambda n: instant_of(n, timezone)) * 1000)


def with_value(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def instant_of(local: Column, timezone: str) -> Column:
    """UTC micros of a local clock time; null where the zone skips it or has it twice."""
    day = 86_400_000_000
    offsets = F.struct(zone_offset_at(local - day, timezone).alias("before"), zone_offset_at(local + day, timezone).alias("after"))

    def choose(o: Column) -> Column:
        first, second = zone_offset_at(local - o.before, timezone) == o.before, zone_offset_at(local - o.after, timezone) == o.after
        return F.when(first & (~second | (o.before == o.after)), o.before).when(second & ~first, o.after)

    return local - with_value(offsets, choose)


def zone_offset_at(utc: Column, timezone: str) -> Column:
    """The zone's offset in micros at an instant."""
    at = F.timestamp_micros(utc)
    return F.unix_micros(F.from_utc_timestamp(at, timezone)) - utc


def zone_offset(local: Column, timezone: str) -> Column:
    """The offset to take from a local time that a calendar declares; where it comes twice, the earlier instant."""
    first = zone_offset_at(local - 86_400_000_000, timezone)
    second = zone_offset_at(local + 86_400_000_000, timezone)
    return F.when(zone_offset_at(local - first, timezone) == first, first).otherwise(second)


def inferred_format(samples: DataFrame, columns: list[str]) -> str | None:
    """The pattern to read columns of stamps by that declare none; None where they are ISO 8601.

    All rows decide. Patterns that agree on every row are as good as one; where they disagree the file can't say
    which is meant, and a declared format is asked for.
    """
    stamps = samples.select(F.explode(F.array(*[F.trim(F.col(f"`{c}`")) for c in columns])).alias("stamp"))
    naive = stamps.where(~F.col("stamp").rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$") & (wall_clock(F.col("stamp"), "%Y-%m-%dT%H:%M:%S").isNull()) & wall_clock(F.col("stamp"), "%Y-%m-%d %H:%M:%S").isNull() & wall_clock(F.col("stamp"), "%Y-%m-%d").isNull())
    found = matching_formats(naive, "stamp")
    if found["ambiguous"]:
        raise SchemaError(f"declare the time format: {found['disagreement']}")
    return found["parsing"][0] if found["parsing"] else None


def matching_formats(samples: DataFrame, column: str) -> dict:
    """Patterns that read every row, and one row on which they disagree if more than one does; two aggregates in all.

    ``only`` is the pattern if exactly one reads every row, also where several agree.
    """
    c = F.col(column)
    row = samples.agg(F.count("*").alias("n"), *[F.count(wall_clock(c, p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]).first()
    if not row.n:
        return {"parsing": [], "ambiguous": False, "disagreement": None, "only": None}
    fits = [p for k, p in enumerate(PATTERNS) if row[f"p{k}"] == row.n]
    why = None
    if len(fits) > 1:
        apart = [F.first(F.when(wall_clock(c, fits[0]) != wall_clock(c, p), F.trim(c)), ignorenulls=True) for p in fits[1:]]
        found = samples.agg(*[a.alias(f"d{k}") for k, a in enumerate(apart)]).first()
        why = next((f"{v!r} reads differently under {fits[0]} and {fits[k + 1]}" for k, v in enumerate(found) if v is not None), None)
    return {"parsing": fits, "ambiguous": why is not None, "disagreement": why, "only": fits[0] if len(fits) == 1 else None}
