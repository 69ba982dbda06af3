"""Venue calendars: weekly pattern, holidays and early closes in local time, as sessions in UTC."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, time
from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import CalendarCoverageError, SchemaError
from .timeformats import zone_offset


@dataclass(frozen=True)
class VenueCalendar:
    calendar_id: str
    timezone: str
    close: time
    weekmask: str = "1111100"
    holidays: tuple[date, ...] = ()
    early_closes: dict[date, time] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.timezone not in available_timezones():
            raise SchemaError(f"no such time zone: {self.timezone}")
        if len(self.weekmask) != 7 or set(self.weekmask) - {"0", "1"} or "1" not in self.weekmask:
            raise SchemaError(f"a week mask has seven digits and an open day, got {self.weekmask}")

    def sessions(self, spark: SparkSession, start: date, end: date) -> DataFrame:
        """(session_idx, prev_close_ns, close_ns) of the open days from start to end."""
        micros = lambda t: (t.hour * 3600 + t.minute * 60 + t.second) * 1_000_000
        days = spark.range((start - date(1970, 1, 1)).days, (end - date(1970, 1, 1)).days + 1).withColumnRenamed("id", "day")
        open_days = [k for k, x in enumerate(self.weekmask) if x == "1"]
        days = days.where(((F.col("day") + 3) % 7).isin(open_days))
        if self.holidays:
            days = days.where(~F.col("day").isin([(h - date(1970, 1, 1)).days for h in self.holidays]))
        at = F.lit(micros(self.close))
        for d, t in self.early_closes.items():
            at = F.when(F.col("day") == (d - date(1970, 1, 1)).days, micros(t)).otherwise(at)
        local = F.col("day") * (C.DAY_NS // 1000) + at
        out = days.select(((local - zone_offset(local, self.timezone)) * 1000).alias("close_ns"))
        w = Window.orderBy("close_ns")  # a calendar is some thousand rows
        out = out.select((F.row_number().over(w) - 1).alias("session_idx"), F.coalesce(F.lag("close_ns").over(w), F.col("close_ns") - C.DAY_NS).alias("prev_close_ns"), "close_ns")
        if not out.limit(1).count():
            raise CalendarCoverageError("no session in the window", 0, 1)
        return out


def load_venue_calendar(path: str) -> VenueCalendar:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    as_time = lambda v: v if isinstance(v, time) else time.fromisoformat(str(v)) if ":" in str(v) else time(int(v) // 60, int(v) % 60)  # noqa: E731  YAML reads 16:00 as minutes
    as_date = lambda v: v if isinstance(v, date) else date.fromisoformat(str(v))
    try:
        return VenueCalendar(raw["calendar_id"], raw["timezone"], as_time(raw["close"]), str(raw.get("weekmask", "1111100")), tuple(map(as_date, raw.get("holidays") or ())), {as_date(k): as_time(v) for k, v in (raw.get("early_closes") or {}).items()})
    except (KeyError, ValueError, TypeError) as e:
        raise SchemaError(f"calendar: {e}") from e
