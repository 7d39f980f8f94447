"""Mixed timestamp spellings and zones to one instant (problem 1).

Every value gets the array of its valid interpretations; a Viterbi pass over each source's record order then picks one per value. The pass is exact and
distributed: rows are cut into blocks of ``2**BITS`` consecutive record ids, every block is reduced to a min-plus matrix between the interpretations of its first
and its last row, blocks are reduced again until one task holds a source's remaining matrices, and the choices are handed down again. A block with more rows than
ids, as some ids repeat, is cut into parts of ``2**BITS`` rows first. So no task ever holds more than ``2**BITS`` rows of a source, however large the source is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.storage import written

#: Record ids per block and per step of the hierarchy, as a power of two.
BITS = 16
#: Cost of an interpretation that the feed's declaration speaks against, of the second of two equal local times, of another spelling than the row before, of going back by more than BACK_US.
RULE_COST, FOLD_COST, SWITCH_COST, BACK_COST, BACK_US = 50.0, 20.0, 1.0, 1.0, 86_400_000_000

# Usual zone abbreviations in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "PKT": 300, "NPT": 345, "ICT": 420, "WIB": 420, "HKT": 480, "SGT": 480, "AWST": 480, "PHT": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600,
    "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300,
    "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "SAST": 120,
}
# Month names by their first three letters.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_FULL = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept"} | set(MONTHS)

_VALUE = re.compile(
    r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
    r"(?:(?P<Y>\d{4})(?P<sep>[-/.])(?P<M>\d{1,2})(?P=sep)(?P<D>\d{1,2})"
    r"|(?P<a>\d{1,2})(?P<sep2>[/.])(?P<b>\d{1,2})(?P=sep2)(?P<Y2>\d{4})"
    r"|(?P<d3>\d{1,2})(?:st|nd|rd|th)?[\s-]+(?P<mon3>[a-z]{3,9})\.?,?[\s-]+(?P<Y3>\d{4})"
    r"|(?P<mon4>[a-z]{3,9})\.?\s+(?P<d4>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<Y4>\d{4})"
    r"|(?P<c>\d{8})(?=t\d))"
    r"(?:(?:\s*t\s*|,?\s+(?:at\s+)?)"
    r"(?:(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?|(?P<hc>\d{2})(?P<mc>\d{2})(?P<sc>\d{2})?(?:[.,](?P<fc>\d+))?)"
    r"(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?)?"
    r"(?:\s*(?P<zn1>utc|gmt)?(?P<off>[+-]\d{2}(?::?\d{2})?))?"
    r"(?:\s*(?P<zone>[a-z]{1,5}|[a-z_]+/[a-z_/+-]+\d*|\[[a-z0-9_/+-]+\]|\([a-z0-9_/+-]+\)))?"
)
# The most frequent spellings, in a form that matches fast; all of them also match _VALUE.
_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[t ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)? ?(?:(z|utc)|([+-]\d\d):?(\d\d)?)?")
_TRAILING = re.compile(r"(\d{1,2})([/.])(\d{1,2})[/.](\d{4}) (\d{1,2}):(\d\d)(?::(\d\d))?(?: ?([ap])m)?")
_DIGITS = re.compile(r"(\d+)(?:[.,](\d+))?")
_EPOCH, _DAY_US = datetime(1970, 1, 1), 86_400_000_000
_DECADE = (1_577_836_800, 1_893_456_000)
_EPOCH_ORD = date(1970, 1, 1).toordinal()
_zones: dict[str, ZoneInfo | None] = {}
_days: dict[tuple[int, int, int], int | None] = {}


def zone(name: str | None) -> ZoneInfo | None:
    """The IANA zone of that name in any letter case, or None."""
    if name not in _zones:
        found = None
        for x in (name, name.title(), "/".join("_".join(w.capitalize() for w in p.split("_")) for p in name.split("/")), name.upper()) if name else ():
            try:
                found = ZoneInfo(x)
                break
            except Exception:
                continue
        _zones[name] = found
    return _zones[name]


def _day(y: int, m: int, d: int) -> int | None:
    """Days since 1970, or None for an impossible date."""
    k = (y, m, d)
    if k not in _days:
        if len(_days) > 100_000:
            _days.clear()
        try:
            _days[k] = date(y, m, d).toordinal() - _EPOCH_ORD
        except ValueError:
            _days[k] = None
    return _days[k]


_steady: dict[tuple[str, int], int | None] = {}


def _steady_offset(day: int, tz: ZoneInfo) -> int | None:
    """Microseconds that the zone is ahead of UTC around a day on which its clocks don't change, else None."""
    k = (tz.key, day)
    if k not in _steady:
        if len(_steady) > 200_000:
            _steady.clear()
        _steady[k] = None
        try:
            ends = [tz.utcoffset(_EPOCH + timedelta(days=day + x)) for x in (-1, 0, 1, 2)]
            if len(set(ends)) == 1:
                _steady[k] = int(ends[0].total_seconds() * 1_000_000)
        except OverflowError:
            pass
    return _steady[k]


def _local(day: int, us: int, tz: ZoneInfo) -> list[tuple[int, float]]:
    """Instants of a local time: first the earlier of two, or the time moved on over a gap; a second one costs FOLD_COST."""
    if (o := _steady_offset(day, tz)) is not None:
        return [(day * _DAY_US + us - o, 0.0)]
    at = _EPOCH + timedelta(days=day, microseconds=us)
    try:
        first, second = (int(tz.utcoffset(at.replace(tzinfo=tz, fold=k)).total_seconds() * 1_000_000) for k in (0, 1))
    except OverflowError:
        return []
    t = day * _DAY_US + us
    return [(t - first, 0.0)] + ([(t - second, FOLD_COST)] if first > second else [])


def _clock(h: int, mi: int, s: int, frac: str | None, ap: str | None) -> int | None:
    if ap:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (ap == "p")
    if h > 23 or mi > 59 or s > 59:
        return None
    return ((h * 60 + mi) * 60 + s) * 1_000_000 + (int(frac[:6].ljust(6, "0")) if frac else 0)


def _trailing(y: int, a: int, b: int, sep: str, order: str | None) -> list[tuple[int | None, int, float]]:
    """(day, spelling, cost) of the dates that two numbers and a trailing year can mean."""
    if sep == ".":
        return [(_day(y, b, a), 4, 0.0)]
    dmy, mdy = (_day(y, b, a), 5, 0.0), (_day(y, a, b), 6, 0.0)
    if order in ("dmy", "mdy"):
        first, other = (dmy, mdy) if order == "dmy" else (mdy, dmy)
        return [first] + ([(other[0], other[1], RULE_COST)] if first[0] is not None and other[0] != first[0] else [])
    return [dmy] + ([mdy] if mdy[0] != dmy[0] else [])


def _placed(days: list[tuple[int | None, int, float]], us: int, fixed: int | None, tz: ZoneInfo) -> list[tuple[int, int, float]]:
    out = []
    for day, kind, cost in days:
        if day is None:
            continue
        if fixed is not None:
            out.append((day * _DAY_US + us - fixed * 60_000_000, kind, cost))
        else:
            out += [(t, kind, cost + c) for t, c in _local(day, us, tz)]
    return out


def interpretations(value: str | None, feed_zone: str | None = None, order: str | None = None) -> list[tuple[int, int, float]]:
    """(microseconds since 1970 UTC, spelling, cost) of each valid reading of ``value``, the declared one first; empty when it isn't readable.

    A zone in the value wins over ``feed_zone``; without either it is UTC. Where slashes and a trailing year leave the order of day and month open, ``order``
    (dmy, mdy) decides: the other order is only listed at RULE_COST, and a date that is impossible in the declared order isn't readable. Without a declared
    order both are listed at no cost, so that the neighbours decide. Null, empty and blank values have no reading.
    """
    v = " ".join(value.split()).lower() if value else ""
    if not v:
        return []
    tz = zone(feed_zone) or zone("UTC")
    if m := _ISO.fullmatch(v):
        y, mo, d, h, mi, s, f, z, o, om = m.groups()
        day, us = _day(int(y), int(mo), int(d)), _clock(int(h), int(mi), int(s or 0), f, None) if h else 0
        if day is None or us is None:
            return []
        if z:
            return [(day * _DAY_US + us, 1, 0.0)]
        if o:
            east = int(o[1:]) * 60 + int(om or 0)
            return [] if east > 1080 or int(om or 0) > 59 else [(day * _DAY_US + us + (east if o[0] == "-" else -east) * 60_000_000, 1, 0.0)]
        return [(t, 1, c) for t, c in _local(day, us, tz)]
    if (m := _TRAILING.fullmatch(v)) and order in ("dmy", "mdy", "ymd"):
        a, sep, b, y, h, mi, s, ap = m.groups()
        us = _clock(int(h), int(mi), int(s or 0), None, ap)
        return [] if us is None else _placed(_trailing(int(y), int(a), int(b), sep, order), us, None, tz)
    if m := _DIGITS.fullmatch(v):
        whole, frac = m.groups()
        n, out = int(whole), []
        for kind, per in ((20, 1), (21, 1_000), (22, 1_000_000)):
            if _DECADE[0] <= n // per < _DECADE[1]:
                us = 1_000_000 // per
                out.append((n * us + (int((frac + "000000")[:6]) // per if frac else 0), kind, 0.0))
        if frac is None and len(whole) in (8, 12, 14):
            day = _day(int(whole[:4]), int(whole[4:6]), int(whole[6:8]))
            us = _clock(int(whole[8:10] or 0), int(whole[10:12] or 0), int(whole[12:14] or 0), None, None)
            if day is not None and us is not None:
                out += [(t, 23, c) for t, c in _local(day, us, tz)]
        return out
    m = _VALUE.fullmatch(v)
    if not m:
        return []
    g = m.groupdict()
    if g["h"] is not None:
        us = _clock(int(g["h"]), int(g["mi"]), int(g["s"] or 0), g["f"], g["ap"])
    elif g["hc"] is not None:
        us = _clock(int(g["hc"]), int(g["mc"]), int(g["sc"] or 0), g["fc"], g["ap"])
    else:
        us = 0
    if us is None:
        return []
    if g["off"]:
        o = g["off"].replace(":", "")
        minutes = int(o[1:3]) * 60 + int(o[3:5] or 0)
        if minutes > 18 * 60 or int(o[3:5] or 0) > 59:
            return []
        fixed = minutes * (-1 if o[0] == "-" else 1)
        if g["zone"] and g["zone"].strip("[]()").upper() not in ABBREVIATIONS and zone(g["zone"].strip("[]()")) is None:
            return []
    elif g["zone"]:
        name = g["zone"].strip("[]()")
        fixed = ABBREVIATIONS.get(name.upper())
        if fixed is None:
            tz = zone(name)
            if tz is None:
                return []
    else:
        fixed = None
    days: list[tuple[int, int, float]] = []
    if g["Y"]:
        days = [(_day(int(g["Y"]), int(g["M"]), int(g["D"])), {"-": 1, "/": 2, ".": 3}[g["sep"]], 0.0)]
    elif g["Y2"]:
        days = _trailing(int(g["Y2"]), int(g["a"]), int(g["b"]), g["sep2"], order)
    elif g["c"]:
        days = [(_day(int(g["c"][:4]), int(g["c"][4:6]), int(g["c"][6:])), 9, 0.0)]
    else:
        name = g["mon3"] or g["mon4"]
        if name not in _FULL:
            return []
        days = [(_day(int(g["Y3"] or g["Y4"]), MONTHS[name[:3]], int(g["d3"] or g["d4"])), 7 if g["mon3"] else 8, 0.0)]
    return _placed(days, us, fixed, tz)


_LISTS = [("t", pa.list_(pa.int64())), ("f", pa.list_(pa.int32())), ("c", pa.list_(pa.float32()))]
_SPACES = r"[\t\n\x0b\x0c\r\x1c-\x1f]|  "


#: Places in a value: year, month, day, the two numbers before a trailing year, eight digits of a date, hour, minute, second, fraction, hours and minutes of an offset, digits alone.
_PLACES = ("y", "m", "d", "a", "b", "c", "h", "mi", "s", "f", "oh", "om", "n")
_ISO_LIKE, _TRAIL, _NUMBER = 1, 2, 3


def _shape(signature: str) -> list[int] | None:
    """How all values with one signature are read, a signature being the value with every digit as 9: the patterns tell digits apart by place only, so the
    places of year, month and so on are the same in all of them. Gives (form, spelling, point, half, month, signs, fixed, minutes east, zone, then start and
    width of each of _PLACES), or None for what isn't readable."""
    at: dict[str, tuple[int, int] | None] = {}
    form, kind, point, half, month, sign, fixed, east, tz = _ISO_LIKE, 1, 0, 0, 0, 0, 0, 0, -1
    if m := _DIGITS.fullmatch(signature):
        if m.end(1) > 18:
            return None
        form, at = _NUMBER, {"n": m.span(1), "f": m.span(2) if m[2] else None}
    elif m := _VALUE.fullmatch(signature):
        g = m.groupdict()
        at = {p: next((m.span(n) for n in names if g[n] is not None), None) for p, names in
              {"y": ("Y", "Y2", "Y3", "Y4"), "m": ("M",), "d": ("D", "d3", "d4"), "a": ("a",), "b": ("b",), "c": ("c",), "h": ("h", "hc"), "mi": ("mi", "mc"), "s": ("s", "sc"), "f": ("f", "fc")}.items()}
        kind = {"-": 1, "/": 2, ".": 3}[g["sep"]] if g["Y"] else 9 if g["c"] else 7 if g["mon3"] else 8
        form, point, half = _TRAIL if g["a"] else _ISO_LIKE, int(g["sep2"] == "."), {None: 0, "a": 1, "p": 2}[g["ap"]]
        if name := g["mon3"] or g["mon4"]:
            if name not in _FULL:
                return None
            month = MONTHS[name[:3]]
        if g["zone"]:
            place = g["zone"].strip("[]()")
            minutes, own = ABBREVIATIONS.get(place.upper()), zone(place)
            if minutes is None and own is None:
                return None
            fixed, east = int(minutes is not None), minutes or 0
            if minutes is None and not g["off"]:
                tz = _zone_number(own.key)
        if g["off"]:
            a, b = m.span("off")
            sign, fixed, at["oh"], at["om"] = -1 if g["off"][0] == "-" else 1, 1, (a + 1, a + 3), (b - 2, b) if b - a > 3 else None
    else:
        return None
    spans = [at.get(p) or (0, 0) for p in _PLACES]
    return [form, kind, point, half, month, sign, fixed, east, tz, *(x for a, b in spans for x in (a, b - a))]


_shapes: dict[str, list[int] | None] = {}
_numbers: dict[str, int] = {}
_years: dict[tuple[int, int], np.ndarray] = {}
_UNSTEADY = np.iinfo(np.int64).min


def _zone_number(name: str | None) -> int:
    """A number for the zone of that name, UTC where there is none."""
    key = (zone(name) or zone("UTC")).key
    return _numbers.setdefault(key, len(_numbers))


def _shapes_of(signatures: list[str]) -> np.ndarray:
    if len(_shapes) > 50_000:
        _shapes.clear()
    out = []
    for x in signatures:
        if x in _shapes:
            shape = _shapes[x]
        else:
            shape = _shape(x) if x.isascii() else None
            if len(x) < 200:  # long texts aren't kept
                _shapes[x] = shape
        out.append(shape or [0] * (9 + 2 * len(_PLACES)))
    return np.array(out, np.int64).reshape(-1, 9 + 2 * len(_PLACES))


def _days_of(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether the date exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = ((np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1).astype("datetime64[M]")
    first, following = month.astype("datetime64[D]").astype(np.int64), (month + 1).astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (first + d - 1 < following)


def _year_offsets(number: int, year: int) -> np.ndarray:
    """Microseconds ahead of UTC for each day of a year, _UNSTEADY for days around a change of the clocks."""
    if (number, year) not in _years:
        tz = ZoneInfo(next(k for k, n in _numbers.items() if n == number))
        try:
            first, following = (date(y, 1, 1).toordinal() - _EPOCH_ORD for y in (year, year + 1))
            o = np.array([int(tz.utcoffset(_EPOCH + timedelta(days=x)).total_seconds() * 1_000_000) for x in range(first - 1, following + 2)])
            _years[number, year] = np.where((o[:-3] == o[1:-2]) & (o[:-3] == o[2:-1]) & (o[:-3] == o[3:]), o[:-3], _UNSTEADY)
        except (OverflowError, ValueError):
            _years[number, year] = np.full(366, _UNSTEADY)
    return _years[number, year]


def _ahead(day: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Microseconds ahead of UTC of each (day, zone), _UNSTEADY where the clock decides."""
    year = day.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970
    key, back = np.unique(number * 20_000 + year, return_inverse=True)
    out = np.empty(len(day), np.int64)
    by = np.argsort(back, kind="stable")
    edges = np.searchsorted(back[by], np.arange(len(key) + 1))
    for k, x in enumerate(key.tolist()):
        rows = by[edges[k] : edges[k + 1]]
        first = date(x % 20_000, 1, 1).toordinal() - _EPOCH_ORD
        out[rows] = _year_offsets(x // 20_000, x % 20_000)[day[rows] - first]
    return out


class _Readings:
    """Readings of one batch as they are found: row, place in the row's list, instant, spelling, cost."""

    def __init__(self, rows: int):
        self.rows, self.parts = rows, []

    def add(self, row, place, t, kind, cost) -> None:
        self.parts.append((row, *(np.broadcast_to(np.asarray(x, d), len(row)) for x, d in ((place, np.int64), (t, np.int64), (kind, np.int32), (cost, np.float32)))))

    def local(self, row, place, day, us, number, kind, cost) -> None:
        """Instants of local times in the zones of those numbers; only days with a change of the clocks are looked at one by one."""
        place, kind, cost = (np.broadcast_to(x, len(row)) for x in (place, kind, cost))
        ahead = _ahead(day, number)
        calm = ahead != _UNSTEADY
        self.add(row[calm], place[calm], (day * _DAY_US + us)[calm] - ahead[calm], kind[calm], cost[calm])
        names = {n: k for k, n in _numbers.items()}
        single = [(row[k], place[k] + j, t, kind[k], cost[k] + c) for k in np.nonzero(~calm)[0].tolist() for j, (t, c) in enumerate(_local(int(day[k]), int(us[k]), zone(names[int(number[k])])))]
        if single:
            self.add(*(np.array(x) for x in zip(*single)))

    def lists(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Offsets of the rows and the flat columns t, f and c."""
        if not self.parts:
            return np.zeros(self.rows + 1, np.int32), [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)]
        row, place, *flat = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((place, row))
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.rows))]).astype(np.int32), [x[order] for x in flat]


def _coded(a: pa.Array) -> tuple[np.ndarray, list]:
    """Each row's place in a list of the distinct values, null last."""
    d = a.dictionary_encode()
    values = d.dictionary.to_pylist()
    return pc.fill_null(d.indices, len(values)).to_numpy(zero_copy_only=False).astype(np.int64), [*values, None]


def _read(values: pa.Array, zones: pa.Array, orders: pa.Array) -> _Readings:
    """Readings of a batch of values, the same as ``interpretations`` gives one by one; patterns run once per signature, all else in whole columns."""
    out = _Readings(len(values))
    plain = pc.fill_null(pc.string_is_ascii(values), True)
    for k in np.nonzero(~plain.to_numpy(zero_copy_only=False))[0]:
        for j, (t, kind, cost) in enumerate(interpretations(values[k].as_py(), zones[k].as_py(), orders[k].as_py())):
            out.add(np.array([k]), j, t, kind, cost)
    v = pc.ascii_lower(values)
    if pc.any(pc.match_substring_regex(v, _SPACES)).as_py():
        v = pc.replace_substring_regex(v, r"[\t\n\x0b\x0c\r\x1c-\x1f ]+", " ")
    v = pc.fill_null(pc.ascii_trim(v, " "), "")
    if not len(v) or not v.buffers()[2]:
        return out
    offsets = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
    data = np.frombuffer(v.buffers()[2], np.uint8)
    nine = pa.py_buffer(np.where((data >= 48) & (data <= 57), np.uint8(57), data).tobytes())
    coded = pa.StringArray.from_buffers(len(v), v.buffers()[1], nine, None, 0, v.offset).dictionary_encode()
    table = _shapes_of(coded.dictionary.to_pylist())
    shape = table[coded.indices.to_numpy()]
    row = np.nonzero(shape[:, 0])[0]
    if not len(row):
        return out
    shape, start = shape[row], offsets[:-1][row]
    data = np.concatenate([data, np.full(20, 48, np.uint8)])

    def num(place: str, most: int = 18) -> np.ndarray:
        k = 9 + 2 * _PLACES.index(place)
        at, width = start + shape[:, k], np.minimum(shape[:, k + 1], most)
        n = np.zeros(len(row), np.int64)
        for j in range(int(width.max())):
            n = np.where(j < width, n * 10 + (data[at + j] - 48), n)
        return n

    width_f = shape[:, 9 + 2 * _PLACES.index("f") + 1]
    frac = num("f", 6) * np.power(10, 6 - np.minimum(width_f, 6))
    form, half, sign = shape[:, 0], shape[:, 3], shape[:, 5]
    zone_of, zone_names = _coded(zones)
    own_zone = np.array([_zone_number(x) for x in zone_names])[zone_of[row]]
    n, width_n = num("n"), shape[:, 9 + 2 * _PLACES.index("n") + 1]
    digits = form == _NUMBER
    for kind, per in ((20, 1), (21, 1_000), (22, 1_000_000)):
        ok = digits & (n // per >= _DECADE[0]) & (n // per < _DECADE[1])
        out.add(row[ok], kind - 20, (n * (1_000_000 // per) + np.where(width_f > 0, frac // per, 0))[ok], kind, 0.0)
    dated = digits & (width_f == 0) & np.isin(width_n, (8, 12, 14))
    full = np.where(dated, n * np.power(10, np.maximum(14 - width_n, 0)), 0)
    c = num("c")
    compact = c > 0
    y, m, d = (np.where(dated, full // 10**p % q, np.where(compact, c // 10 ** (p - 6) % q, num(x))) for x, p, q in (("y", 10, 10_000), ("m", 8, 100), ("d", 6, 100)))
    m = np.where(shape[:, 4] > 0, shape[:, 4], m)
    h, mi, sec = (np.where(dated, full // 10**p % 100, num(x)) for x, p in (("h", 4), ("mi", 2), ("s", 0)))
    good = ~digits | dated
    good &= (half == 0) | ((h >= 1) & (h <= 12))
    h = np.where(half > 0, h % 12 + 12 * (half == 2), h)
    oh, om = num("oh"), num("om")
    good &= (h < 24) & (mi < 60) & (sec < 60) & (oh * 60 + om <= 1080) & (om < 60)
    us = ((h * 60 + mi) * 60 + sec) * 1_000_000 + np.where(dated, 0, frac)
    east = np.where(sign != 0, (oh * 60 + om) * sign, shape[:, 7])
    fixed = shape[:, 6] > 0
    number = np.where(shape[:, 8] >= 0, shape[:, 8], own_zone)

    def place(day, ok, at, kind, cost) -> None:
        a, b = ok & fixed, ok & ~fixed
        at, kind, cost = (np.broadcast_to(x, len(row)) for x in (at, kind, cost))
        out.add(row[a], at[a], day[a] * _DAY_US + us[a] - east[a] * 60_000_000, kind[a], cost[a])
        if b.any():
            out.local(row[b], at[b], day[b], us[b], number[b], kind[b], cost[b])

    day, real = _days_of(y, m, d)
    place(day, good & real & (form != _TRAIL), np.where(dated, 3, 0), np.where(dated, 23, shape[:, 1]), 0.0)
    trail = good & (form == _TRAIL)
    if trail.any():
        a, b = num("a"), num("b")
        order_of, order_names = _coded(orders)
        declared = np.array([{"dmy": 1, "mdy": 2}.get(x, 0) for x in order_names])[order_of[row]]
        point = shape[:, 2] > 0
        swap = (declared == 2) & ~point
        one, one_real = _days_of(y, np.where(swap, a, b), np.where(swap, b, a))
        two, two_real = _days_of(y, np.where(swap, b, a), np.where(swap, a, b))
        kinds = np.where(point, 4, np.where(swap, 6, 5))
        place(one, trail & one_real, 0, kinds, 0.0)
        other = trail & ~point & two_real & ~(one_real & (one == two)) & (one_real | (declared == 0))
        place(two, other, 2, 11 - kinds, np.where(declared > 0, RULE_COST, 0.0))
    return out


def _whole(b: pa.RecordBatch) -> tuple[dict, _Readings]:
    cols = {n: b.column(n) for n in b.schema.names}
    v, z, o = (cols.pop(n) for n in ("__v", "__z", "__o"))
    return cols, _read(v.cast(pa.string()), z.cast(pa.string()), o.cast(pa.string()))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols, found = _whole(b)
        ends, flat = found.lists()
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, k.value_type)) for x, (_, k) in zip(flat, _LISTS)]
        yield pa.RecordBatch.from_arrays([*cols.values(), *lists], names=[*cols, "t", "f", "c"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols, found = _whole(b)
        ends, flat = found.lists()
        none = np.diff(ends) == 0
        first = pa.array(np.append(flat[0], 0)[np.where(none, len(flat[0]), ends[:-1])], pa.int64(), mask=none)
        yield pa.RecordBatch.from_arrays([*cols.values(), first], names=[*cols, "utc_us"])


def _parsed(df: DataFrame, value: str | Column, feed_zone: str | Column, order: str | Column, keep: tuple[Column, ...], run, added: str) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    kept = df.select(*keep)
    src = df.select(*keep, as_col(value).cast("string").alias("__v"), as_col(feed_zone).alias("__z"), F.lower(as_col(order)).alias("__o"))
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema.fields)
    return src.mapInArrow(run, f"{fields}, {added}")


def candidates(df: DataFrame, value: str | Column, feed_zone: str | Column, order: str | Column, *keep: Column) -> DataFrame:
    """``keep`` columns with arrays t (instants), f (spellings) and c (costs) of each value's readings."""
    return _parsed(df, value, feed_zone, order, keep, _batches, "t array<bigint>, f array<int>, c array<float>")


def with_feeds(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """``df`` with the zone and date order of each row's feed as feed_zone and feed_order, in place of columns so called; a feed that isn't listed leaves both null."""
    f = feeds.groupBy(F.col("feed").alias("__feed")).agg(F.first("time_zone").alias("feed_zone"), F.first("date_order").alias("feed_order"))
    df = df.drop("feed_zone", "feed_order")
    return df.join(f, df["feed"] == f["__feed"], "left").drop("__feed")


def declared_instant(df: DataFrame, feeds: DataFrame, value: str, *keep: Column) -> DataFrame:
    """``keep`` columns and utc_us, the reading that the feed's declaration gives (null when unreadable), without a look at the neighbours."""
    return _parsed(with_feeds(df, feeds), value, "feed_zone", "feed_order", keep, _firsts, "utc_us bigint")


# --- min-plus Viterbi ----------------------------------------------------------------------------------------------------------------------------------


class _Items:
    """Runs of rows: readings of their first and last row and the least cost between each pair of those."""

    def __init__(self, et, ef, xt, xf, m):
        self.et, self.ef, self.xt, self.xf, self.m = et, ef, xt, xf, m

    def __len__(self):
        return len(self.m)

    def __getitem__(self, k):
        return _Items(self.et[k], self.ef[k], self.xt[k], self.xf[k], self.m[k])


def _bridge(a: _Items, b: _Items) -> np.ndarray:
    back = (b.et[:, None, :] < a.xt[:, :, None] - BACK_US) * BACK_COST
    return back + (b.ef[:, None, :] != a.xf[:, :, None]) * SWITCH_COST


def _pair(a: _Items, b: _Items) -> _Items:
    at = (a.m[:, :, :, None] + _bridge(a, b)[:, None, :, :]).min(2)
    return _Items(a.et, a.ef, b.xt, b.xf, (at[:, :, :, None] + b.m[:, None, :, :]).min(2))


def _cat(a: _Items, b: _Items) -> _Items:
    return _Items(*(np.concatenate([getattr(a, n), getattr(b, n)]) for n in ("et", "ef", "xt", "xf", "m")))


def _levels(items: _Items) -> list[_Items]:
    out = [items]
    while len(x := out[-1]) > 1:
        n = len(x) // 2
        y = _pair(x[0 : 2 * n : 2], x[1 : 2 * n : 2])
        out.append(_cat(y, x[2 * n :]) if len(x) % 2 else y)
    return out


def _descend(levels: list[_Items], i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exit reading of every run at the bottom, given those of the whole."""
    en, ex = np.array([i]), np.array([j])
    for x in reversed(levels[:-1]):
        n = len(x) // 2
        a, b = x[0 : 2 * n : 2], x[1 : 2 * n : 2]
        r = np.arange(n)
        cost = a.m[r, en[:n]][:, :, None] + _bridge(a, b) + b.m[r, :, ex[:n]][:, None, :]
        k = cost.shape[2]
        best = cost.reshape(n, -1).argmin(1)
        low_en, low_ex = np.empty(len(x), int), np.empty(len(x), int)
        low_en[0 : 2 * n : 2], low_ex[0 : 2 * n : 2] = en[:n], best // k
        low_en[1 : 2 * n : 2], low_ex[1 : 2 * n : 2] = best % k, ex[:n]
        if len(x) % 2:
            low_en[-1], low_ex[-1] = en[-1], ex[-1]
        en, ex = low_en, low_ex
    return en, ex


def _pad(col: pa.ChunkedArray | pa.Array, fill, dtype, k: int | None = None) -> np.ndarray:
    """A list column as a matrix, short lists filled up."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks)
    n = np.diff(a.offsets.to_numpy())
    k = k or int(n.max(initial=1))
    out = np.full((len(a), k), fill, dtype)
    out[np.arange(k) < n[:, None]] = a.flatten().to_numpy(zero_copy_only=False)
    return out


def _leaves(t: pa.Table) -> _Items:
    c = _pad(t["c"], np.inf, np.float32)
    k = c.shape[1]
    ts, fs = _pad(t["t"], 0, np.int64, k), _pad(t["f"], -1, np.int32, k)
    m = np.full((len(c), k, k), np.inf, np.float32)
    m[:, np.arange(k), np.arange(k)] = c
    return _Items(ts, fs, ts, fs, m)


def _runs(t: pa.Table) -> _Items:
    """Runs as written by _up; every list has the same stride of its block, so pad to the widest."""
    k = max(int(np.diff(x.offsets.to_numpy()).max(initial=1)) for n in ("et", "xt") for x in [pa.concat_arrays(t[n].chunks)])
    m = np.full((t.num_rows, k, k), np.inf, np.float32)
    for i, (row, w) in enumerate(zip(t["m"].to_pylist(), t["w"].to_pylist())):
        m[i, :w, :w] = np.array(row, np.float32).reshape(w, w)
    return _Items(_pad(t["et"], 0, np.int64, k), _pad(t["ef"], -1, np.int32, k), _pad(t["xt"], 0, np.int64, k), _pad(t["xf"], -1, np.int32, k), m)


_RUN = "src string, feed string, b bigint, s bigint, w int, et array<bigint>, ef array<int>, xt array<bigint>, xf array<int>, m array<float>"
_STATE = "src string, feed string, b bigint, s bigint, en int, ex int"
_PLACE = [("b", "ascending"), ("s", "ascending")]


def _up(key, t: pa.Table, leaf: bool) -> pa.Table:
    t = t.sort_by("at" if leaf else _PLACE)
    x = _levels(_leaves(t) if leaf else _runs(t))[-1]
    k = x.m.shape[1]
    return pa.table({"src": pa.array([key[0].as_py()], pa.string()), "feed": pa.array([key[1].as_py()], pa.string()), "b": pa.array([key[2].as_py()], pa.int64()), "s": pa.array([key[3].as_py()], pa.int64()), "w": pa.array([k], pa.int32()),
                     "et": pa.array([x.et[0].tolist()], pa.list_(pa.int64())), "ef": pa.array([x.ef[0].tolist()], pa.list_(pa.int32())),
                     "xt": pa.array([x.xt[0].tolist()], pa.list_(pa.int64())), "xf": pa.array([x.xf[0].tolist()], pa.list_(pa.int32())),
                     "m": pa.array([x.m[0].ravel().tolist()], pa.list_(pa.float32()))})


def _up_leaf(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    return _up(key, t, True)


def _up_run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    return _up(key, t, False)


def _states(t: pa.Table, en: np.ndarray, ex: np.ndarray) -> pa.Table:
    return pa.table({"src": t["src"], "feed": t["feed"], "b": t["b"], "s": t["s"], "en": pa.array(en, pa.int32()), "ex": pa.array(ex, pa.int32())})


def _down_root(t: pa.Table) -> pa.Table:
    t = t.sort_by(_PLACE)
    levels = _levels(_runs(t))
    m = levels[-1].m[0]
    return _states(t, *_descend(levels, *divmod(int(m.argmin()), m.shape[1])))


def _down_run(t: pa.Table, state: pa.Table) -> pa.Table:
    t = t.sort_by(_PLACE)
    return _states(t, *_descend(_levels(_runs(t)), state["en"][0].as_py(), state["ex"][0].as_py()))


def _down_leaf(t: pa.Table, state: pa.Table) -> pa.Table:
    if not t.num_rows:
        return pa.table({"src": pa.array([], pa.string()), "row_id": pa.array([], pa.int64()), "utc_us": pa.array([], pa.int64())})
    t = t.sort_by("at")
    x = _leaves(t)
    en, _ = _descend(_levels(x), state["en"][0].as_py(), state["ex"][0].as_py())
    several = np.isfinite(x.m[:, np.arange(x.m.shape[1]), np.arange(x.m.shape[1])]).sum(1) > 1
    return pa.table({"src": t["src"], "row_id": t["row_id"], "utc_us": pa.array(x.et[np.arange(len(en)), en], pa.int64())}).filter(pa.array(several))


#: Order of the rows of a source; rows that agree in all of this are the same to the Viterbi pass.
_ORDER = ("row_id", "t", "f", "c")


def _in_parts(placed: DataFrame, crowded: DataFrame) -> DataFrame:
    """``placed`` with s, a row's number in its block by _ORDER without the last BITS bits; ``crowded`` are the blocks (src, feed, b) with more than 2**BITS rows, so all others are one
    part. A sort over all tasks numbers the rows of crowded blocks, copies of one row spread like others, so that no task holds a block however often an id repeats."""
    key = ["src", "feed", "b"]
    crowded = written(crowded, "crowded").withColumnsRenamed({k: f"__{k}" for k in key})
    same = F.col("src").eqNullSafe(F.col("__src")) & (F.col("feed") == F.col("__feed")) & (F.col("b") == F.col("__b"))
    rows = placed.withColumn("__copy", F.monotonically_increasing_id()).join(crowded, same, "left_semi")
    rows = written(rows.orderBy(*key, *_ORDER, "__copy").drop("__copy").withColumn("__at", F.monotonically_increasing_id()), "sorted").withColumn("__task", F.shiftright("__at", 33))
    held = rows.groupBy(*key, "__task").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("__task")) - F.col("n")
    held = written(held.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__task").alias("task"), (before - F.col("first")).alias("__shift")), "held")
    rows = rows.join(held, same & (F.col("__task") == F.col("task"))).withColumn("s", F.shiftright(F.col("__at") + F.col("__shift"), BITS))
    whole = placed.join(crowded, same, "left_anti").withColumn("s", F.lit(0).cast("bigint"))
    return whole.unionByName(rows.select(whole.columns))


def normalise(readings: DataFrame) -> DataFrame:
    """(src, row_id, utc_us): one instant per readable row of ``readings`` (src, feed, row_id, t, f, c), chosen over each feed's row_id order.

    A row with one reading has nothing to choose, so only rows with several, and the rows around them, take part in the Viterbi pass: the cost of what lies
    between two rows with one reading is the same for every choice elsewhere.
    Rows without a reading give no row. A null feed is a source of its own. Rows that repeat a row_id stand side by side in the order of their readings, however
    many they are. Rows whose row_id is null have no place in the order and get their cheapest, then first reading. Ties go to the reading listed first, so to
    the declared one. An empty table gives an empty one.
    """
    c = written(readings.filter(F.size("t") > 0).select("src", F.coalesce("feed", F.lit("")).alias("feed"), "row_id", "t", "f", "c"), "readings")
    cheapest = F.get("t", F.array_position("c", F.array_min("c")).cast("int") - 1).alias("utc_us")
    out = c.filter((F.size("t") == 1) | F.col("row_id").isNull()).select("src", "row_id", cheapest)
    placed = c.filter(F.col("row_id").isNotNull()).withColumn("b", F.shiftright("row_id", BITS))
    blocks = placed.groupBy("src", "feed", "b").agg(F.count(F.lit(1)).alias("n"))
    low, high, most = blocks.agg(F.min("b"), F.max("b"), F.max("n")).first()
    if low is None:
        return out
    crowded = blocks.filter(F.col("n") > 2**BITS).select("src", "feed", "b")
    parts = _in_parts(placed, crowded) if most > 2**BITS else placed.withColumn("s", F.lit(0).cast("bigint"))
    key = ["src", "feed", "b", "s"]
    w = Window.partitionBy(*key).orderBy(*_ORDER)
    n = F.size("t")
    near = parts.withColumns({"__n": n, "__p": F.lag(n).over(w), "__q": F.lead(n).over(w), "at": F.row_number().over(w)})
    leaves = written(near.filter("__n > 1 OR __p > 1 OR __q > 1 OR __p IS NULL OR __q IS NULL").drop("__n", "__p", "__q"), "leaves")
    lifts, deep, spread = [], (most - 1) >> BITS, high - low
    while deep:  # the parts of every block
        deep >>= BITS
        lifts.append({"ub": F.col("b"), "us": F.shiftright("s", BITS)})
    while spread >> BITS:
        spread >>= BITS
        lifts.append({"ub": F.shiftright("b", BITS), "us": F.lit(0).cast("bigint")})
    above = ["src", "feed", "ub", "us"]
    steps = [written(leaves.groupBy(*key).applyInArrow(_up_leaf, _RUN), "runs")]
    for up in lifts:
        steps.append(steps[-1].withColumns(up).groupBy(*above).applyInArrow(_up_run, _RUN))
    state = steps[-1].groupBy("src", "feed").applyInArrow(_down_root, _STATE)
    for runs, up in zip(reversed(steps[:-1]), reversed(lifts)):
        state = state.withColumnsRenamed({"b": "ub", "s": "us"}).groupBy(*above)
        state = runs.withColumns(up).groupBy(*above).cogroup(state).applyInArrow(_down_run, _STATE)
    chosen = leaves.groupBy(*key).cogroup(state.groupBy(*key)).applyInArrow(_down_leaf, "src string, row_id bigint, utc_us bigint")
    return out.unionByName(chosen)
