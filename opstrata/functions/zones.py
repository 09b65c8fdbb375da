"""Time zones as transition tables, and local times turned into instants by them, whole arrays at a time.

The tables are read from the system's compiled zone files (RFC 9636): the changes that a file lists, then those that the rule at its end gives for
four hundred years, after which the calendar, weekdays included, begins anew. So every year has its offsets.
"""

from __future__ import annotations

import importlib.metadata
import importlib.resources
import re
import struct
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

#: Seconds after which the calendar repeats: 400 years, a whole number of weeks.
CYCLE = 146_097 * 86_400
# What zone abbreviations stand for, in minutes east of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "AKST": -540, "AKDT": -480, "HST": -600, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "AST": -240, "ADT": -180,
}


def version() -> str:
    """The release of the time zone database that the tables come from."""
    for place in TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            if (f := Path(place, name)).exists():
                return f.read_text().split("\n", 1)[0].replace("# version", "").strip()
    try:
        return importlib.metadata.version("tzdata")
    except importlib.metadata.PackageNotFoundError:
        return "unknown"


def check(expected: str) -> None:
    """Raises if this machine's zone tables are of another release than ``expected``, as instants would then depend on where a row is read."""
    if version() != expected:
        raise RuntimeError(f"time zone database {version()} here, {expected} at the driver")


def _file(zone: str) -> bytes:
    for place in TZPATH:
        if (f := Path(place, zone)).is_file():
            return f.read_bytes()
    return importlib.resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()


def _listed(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, str]:
    """(instants of changes, offsets from then on, offset before the first, rule at the end) of a compiled zone."""
    head = struct.Struct(">4sc15x6l")
    skip = 0
    _, v, isut, std, leap, times, types, chars = head.unpack_from(raw)
    wide = v >= b"2"
    if wide:  # the second block has times of 64 bits
        skip = head.size + times * 5 + types * 6 + chars + leap * 8 + std + isut
        _, v, isut, std, leap, times, types, chars = head.unpack_from(raw, skip)
    at = skip + head.size
    n = 8 if wide else 4
    changes = np.frombuffer(raw, f">i{n}", times, at).astype(np.int64)
    kinds = np.frombuffer(raw, np.uint8, times, at + times * n)
    offsets = [struct.unpack_from(">lBB", raw, at + times * (n + 1) + 6 * k)[:2] for k in range(types)]
    before = next((o for o, summer in offsets if not summer), offsets[0][0] if offsets else 0)
    rule = raw[at + times * (n + 1) + types * 6 + chars + leap * (n + 4) + std + isut :].strip(b"\n").decode() if wide else ""
    return changes, np.array([o for o, _ in offsets], np.int64)[kinds], before, rule


# The form of rules at the end of zone files (POSIX).
_NAME, _HMS = r"(?:<[^>]+>|[A-Za-z]+)", r"[+-]?\d+(?::\d+){0,2}"
_RULE = re.compile(rf"{_NAME}(?P<std>{_HMS})(?:{_NAME}(?P<dst>{_HMS})?,(?P<on>[^,/]+)(?:/(?P<on_at>{_HMS}))?,(?P<off>[^,/]+)(?:/(?P<off_at>{_HMS}))?)?")


def _seconds(text: str | None, default: int) -> int:
    if text is None:
        return default
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    total = sum(x * 60 ** (2 - i) for i, x in enumerate(parts))
    return -total if text.startswith("-") else total


def _day(rule: str, years: np.ndarray) -> np.ndarray:
    """Days since 1970 on which a date of a rule falls in each year."""
    first = (years - 1970).astype("datetime64[Y]")
    january = first.astype("datetime64[D]").astype(np.int64)
    if rule[0] == "M":
        month, week, weekday = (int(x) for x in rule[1:].split("."))
        m = first.astype("datetime64[M]") + (month - 1)
        start, end = (x.astype("datetime64[D]").astype(np.int64) for x in (m, m + 1))
        day = start + (weekday - (start + 4)) % 7 + 7 * (week - 1)  # 1970-01-01 was a Thursday, Sunday is 0
        return np.where(day >= end, day - 7, day)
    if rule[0] == "J":  # 29 February is never counted
        leap = ((first + 1).astype("datetime64[D]").astype(np.int64) - january) == 366
        return january + int(rule[1:]) - 1 + (leap & (int(rule[1:]) >= 60))
    return january + int(rule)


def _ruled(rule: str, after: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(changes, offsets, standard offset) by the rule at a file's end, for 400 years and some, from the year of instant ``after`` on."""
    m = _RULE.fullmatch(rule)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    std = -_seconds(m["std"], 0)
    if m["on"] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), std
    dst = -_seconds(m["dst"], 0) if m["dst"] else std + 3600
    year = int(np.int64(after).astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64)) + 1970
    years = np.arange(year, year + 403)
    on = _day(m["on"], years) * 86400 + _seconds(m["on_at"], 7200) - std
    off = _day(m["off"], years) * 86400 + _seconds(m["off_at"], 7200) - dst
    changes, offsets = np.concatenate([on, off]), np.repeat([dst, std], len(years))
    order = np.argsort(changes, kind="stable")
    return changes[order], offsets[order], std


@lru_cache(maxsize=1024)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(changes, offsets, end) of a zone, in seconds: offsets[i] holds from local time changes[i-1] on, before the first change offsets[0]; from ``end`` on the
    last CYCLE before it repeats. None: no such zone.

    changes are local: a change at instant t from offset a to b counts from t + max(a, b). So a local time that occurs twice is its earlier
    instant, and one that was skipped is read with the offset before the change.
    """
    try:
        ZoneInfo(zone)  # refuses names that lead out of the database
        changes, offsets, before, rule = _listed(_file(zone))
    except (KeyError, ValueError, OSError, ModuleNotFoundError):
        return None
    last = int(changes[-1]) if len(changes) else 0
    more, then, std = _ruled(rule, last)
    later = more > last
    if std is not None and not len(changes) and not len(more):
        before = std
    changes, offsets = np.concatenate([changes, more[later]]), np.concatenate([[before], offsets, then[later]])
    real = np.append(True, np.diff(offsets) != 0)  # changes of the name alone don't count
    changes, offsets = changes[real[1:]], offsets[real]
    end = int(changes[-1]) if len(more) else 1 << 60
    return changes + np.maximum(offsets[:-1], offsets[1:]), offsets, end


def local_to_utc(seconds: np.ndarray, zone: str) -> tuple[np.ndarray, bool]:
    """Local seconds since 1970 to UTC seconds; False: the zone is unknown."""
    table = transitions(zone)
    if table is None:
        return seconds, False
    changes, offsets, end = table
    far = seconds - -(-np.maximum(seconds - (end - 86_400), 0) // CYCLE) * CYCLE  # the same place of the calendar within the table
    return seconds - offsets[np.searchsorted(changes, far, "right")], True
