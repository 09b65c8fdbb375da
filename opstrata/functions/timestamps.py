"""Texts of many timestamp formats to UTC microseconds, a column at a time.

Every text is reduced to its shape mask: digits become 9, letters a, all else stays. Texts of one mask have the same fields at the same places,
so a mask is matched with the grammar below once (kept per worker), and all texts of the mask are then read as a byte matrix.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from opstrata.functions.zones import ABBREVIATIONS, local_to_utc

_MASK = np.arange(256, dtype=np.uint8)
_MASK[48:58] = 57
_MASK[65:91] = _MASK[97:123] = 97
# The month names of RFC 5322.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_TIME = r"(?P<H>99):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_ZONE = r"(?: ?(?P<off>[+-]99(?::?99)?)| ?(?P<abbr>a{1,5}))?(?:\[(?P<zone>[^\]]+)\])?"
#: Shapes of timestamps; several may fit a mask, the first counts.
GRAMMAR = [
    re.compile(p)
    for p in (
        rf"(?P<Y>9999)(?P<s>[-/])(?P<m>99)(?P=s)(?P<d>99)(?:(?P<T>[a ]){_TIME}{_ZONE})?",
        rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<T>a)(?P<H>99)(?P<M>99)(?P<S>99)?{_ZONE}",
        rf"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999)(?: {_TIME}{_ZONE})?",
        rf"(?P<m>99?)/(?P<d>99?)/(?P<Y>9999)(?: {_TIME.replace('99', '99?', 1)}(?: ?(?P<half>aa)(?= |\[|$))?{_ZONE})?",
        rf"(?:aaa,? )?(?P<d>99?) (?P<mon>aaa) (?P<Y>9999) {_TIME}{_ZONE}",
        r"(?P<epoch>9{10})(?:\.(?P<f>9+))?",
        r"(?P<milli>9{13})",
        r"(?P<micro>9{16})",
    )
]
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"


@lru_cache(maxsize=65536)
def layout(mask: bytes) -> dict[str, tuple[int, int]] | None:
    """The places of the fields in texts of this mask; None: no timestamp has this shape."""
    text = mask.decode("latin-1")
    for g in GRAMMAR:
        if m := g.fullmatch(text):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "s"}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (y >= 1) & (d >= 1)
    month = np.where(ok, (y - 1970) * 12 + m - 1, 0).astype("datetime64[M]")
    first = month.astype("datetime64[D]").astype(np.int64)
    ok &= d <= (month + 1).astype("datetime64[D]").astype(np.int64) - first
    return first + d - 1, ok


def _read(chars: np.ndarray, where: dict[str, tuple[int, int]], host_zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of the texts of one mask (a row of ``chars`` each), and which of them denote an instant."""
    n = len(chars)

    def number(field: str, default: int = 0) -> np.ndarray:
        if field not in where:
            return np.full(n, default, np.int64)
        a, b = where[field]
        out = np.zeros(n, np.int64)
        for i in range(a, b):
            out = out * 10 + (chars[:, i] - 48)
        return out

    def words(field: str) -> np.ndarray:
        a, b = where[field]
        return np.ascontiguousarray(chars[:, a:b]).view(f"S{b - a}")[:, 0]

    fraction = np.zeros(n, np.int64)
    if "f" in where:
        a, b = where["f"]
        where = {**where, "f": (a, min(b, a + 6))}
        fraction = number("f") * 10 ** (6 - (where["f"][1] - a))
    yes = np.ones(n, bool)
    for unit, scale in (("epoch", 1_000_000), ("milli", 1000), ("micro", 1)):
        if unit in where:
            return number(unit) * scale + fraction, yes
    ok = yes.copy()
    month = number("m")
    if "mon" in where:
        names, at = np.unique(words("mon"), return_inverse=True)
        month = np.array([MONTHS.index(x) + 1 if (x := w.decode().lower()) in MONTHS else 0 for w in names])[at]
    days, good = _days(number("Y"), month, number("d"))
    ok &= good
    if "T" in where:
        sep = chars[:, where["T"][0]]
        ok &= (sep == 84) | (sep == 116) | (sep == 32)
    hour, minute, second = number("H"), number("M"), number("S")
    if "half" in where:
        half = np.char.lower(words("half"))
        ok &= ((half == b"am") | (half == b"pm")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == b"pm")
    ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
    local = days * 86400 + hour * 3600 + minute * 60 + second

    if "off" in where:
        a, b = where["off"]
        digits = [i for i in range(a + 1, b) if i != a + 3 or b - a != 6]
        v = chars[:, digits].astype(np.int64) - 48
        hours, rest = v[:, 0] * 10 + v[:, 1], v[:, 2] * 10 + v[:, 3] if len(digits) == 4 else np.zeros(n, np.int64)
        minutes = hours * 60 + rest
        ok &= (hours < 24) & (rest < 60)
        return (local - np.where(chars[:, a] == 45, -1, 1) * minutes * 60) * 1_000_000 + fraction, ok
    out = local.copy()
    if "abbr" in where:
        names, at = np.unique(words("abbr"), return_inverse=True)
        fixed = [ABBREVIATIONS.get(w.decode().upper()) for w in names]
        ok &= np.array([f is not None for f in fixed])[at]
        out = local - 60 * np.array([f or 0 for f in fixed])[at]
    else:
        zones = words("zone") if "zone" in where else host_zone
        names, at = np.unique(zones, return_inverse=True)
        for k, w in enumerate(names):
            here = at == k
            out[here], known = local_to_utc(local[here], w.decode() if isinstance(w, bytes) else w)
            ok[here] &= known
    return out * 1_000_000 + fraction, ok


def to_utc_micros(texts: pa.Array, host_zones: pa.Array) -> pa.Array:
    """Microseconds since 1970-01-01 UTC of each text, null where it denotes no instant (null, blank, a word, no such date, no such zone).

    An offset in the text (less than a day, else there is no instant) counts first, then a zone it names, else its host's zone; without any, a local time denotes none. Outer white space is ignored.
    """
    texts = pc.utf8_trim_whitespace(texts.fill_null(""))
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    masks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, raw.buffers()[1], pa.py_buffer(_MASK[data])], offset=raw.offset).dictionary_encode()
    code, shapes = masks.indices.to_numpy(), masks.dictionary.to_pylist()
    zones = np.array(host_zones.fill_null("").to_pylist(), object).astype(str) if len(texts) else np.zeros(0, str)
    out, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(shapes))) if len(shapes) else []
    begin = 0
    for shape, end in zip(shapes, ends, strict=True):
        rows, begin = order[begin:end], end
        if where := layout(shape):
            chars = data[offsets[rows][:, None] + np.arange(len(shape))]
            out[rows], found[rows] = _read(chars, where, zones[rows])
    return pa.array(out, mask=~found)
