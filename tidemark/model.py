"""Names and options that several operators share."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from datetime import datetime, timedelta

#: Pseudo partitions: of an unpartitioned table, and any partition.
NULL_PARTITION, ANY_PARTITION = "__NULL__", "__ANY__"

#: Metadata views of the catalog; as sources they have no partitions of their own.
INFORMATION_SCHEMA = "INFORMATION_SCHEMA"


@dataclass(frozen=True)
class TableRef:
    """A table by catalog, schema and name; the catalog may be left to the session."""

    schema: str
    table: str
    catalog: str | None = None

    @classmethod
    def parse(cls, name: str) -> TableRef:
        parts = name.replace("`", "").split(".")
        if not 2 <= len(parts) <= 3:
            raise ValueError(f"not a table name: {name}")
        return cls(parts[-2], parts[-1], parts[0] if len(parts) == 3 else None)

    def __str__(self) -> str:
        return ".".join(f"`{p}`" for p in (self.catalog, self.schema, self.table) if p)


_PARTS = re.compile(r"(?:(?P<ym>[+-]?\d+-\d+)(?:\s+|$))?(?:(?P<d>[+-]?\d+)(?:\s+|$))?(?P<t>[+-]?\d+:\d+(?::\d+(?:\.\d+)?)?)?")
_ISO = re.compile(r"(?P<sign>[+-]?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")
_WORDS = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*(year|month|week|day|hour|minute|second)s?", re.IGNORECASE)


def parse_interval(text: str) -> tuple[int, timedelta]:
    """(months, rest) of an interval: `1-2 3 4:05:06` (years-months days hours:minutes:seconds, any part of it), ISO 8601
    (`P1Y2M3DT4H5M6S`), or words (`1 month`, `30 minutes`)."""
    value = text.strip()
    if match := _ISO.fullmatch(value):
        sign = -1 if match["sign"] == "-" else 1
        y, m, w, d, h, minutes, s = (float(x or 0) for x in match.groups()[1:])
        if value.lstrip("+-") not in ("P", "PT"):
            return sign * int(12 * y + m), sign * timedelta(weeks=w, days=d, hours=h, minutes=minutes, seconds=s)
    elif value and (match := _PARTS.fullmatch(value)) and any(match.groups()):
        sign = lambda part: -1 if part.startswith("-") else 1
        months, rest = 0, timedelta(days=int(match["d"] or 0))
        if part := match["ym"]:
            years, over = part.lstrip("+-").split("-")
            months = sign(part) * (12 * int(years) + int(over))
        if part := match["t"]:
            h, minutes, s = [*part.lstrip("+-").split(":"), "0"][:3]
            rest += sign(part) * timedelta(hours=int(h), minutes=int(minutes), seconds=float(s))
        return months, rest
    elif value and not _WORDS.sub("", value).strip(" ,"):
        amounts = [(float(n), unit.lower()) for n, unit in _WORDS.findall(value)]
        months = sum(n * {"year": 12, "month": 1}.get(unit, 0) for n, unit in amounts)
        rest = sum((timedelta(**{f"{unit}s": n}) for n, unit in amounts if unit not in ("year", "month")), timedelta())
        return int(months), rest
    raise ValueError(f"not an interval: {text!r}")


def _spelled(name: str, value: object) -> object:
    """An option's value from its text."""
    if not isinstance(value, str):
        return value
    if name == "tolerate_staleness":
        months, rest = parse_interval(value)
        if months:
            raise ValueError("a tolerance has no months")
        return rest
    if name == "max_update_months":
        months, rest = parse_interval(value)
        if rest:
            raise ValueError("the longest range is in whole months")
        return months
    return datetime.fromisoformat(value) if name == "force_expired_at" else value


@dataclass(frozen=True)
class RefreshOptions:
    """Options of a partition refresh."""

    tolerate_staleness: timedelta = timedelta(minutes=30)
    force_expired_at: datetime | None = None
    max_update_months: int = 1
    backfill_direction: str = "backward"
    auto_recreate: str = "error_if_not_exists"
    dry_run: bool = False

    def __post_init__(self) -> None:
        if self.backfill_direction not in ("backward", "forward"):
            raise ValueError("backfill_direction is backward or forward")
        if self.auto_recreate not in ("error_if_not_exists", "replace_if_changed"):
            raise ValueError("auto_recreate is error_if_not_exists or replace_if_changed")

    @classmethod
    def of(cls, options: dict | str) -> RefreshOptions:
        """Options from a dictionary, or from JSON, with intervals and instants as texts."""
        options = json.loads(options) if isinstance(options, str) else options
        if unknown := set(options) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**{k: _spelled(k, v) for k, v in options.items()})
