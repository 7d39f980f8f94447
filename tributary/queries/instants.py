"""The instants of the feeds' declared readings as SQL, against which queries that rest on them are compared."""

from __future__ import annotations

from tributary.operators.timestamps import _DECADE, _FULL, ABBREVIATIONS, MONTHS

_FIELDS = "y1 p1 m1 p2 d1 a s1 b s2 y2 d3 n3 y3 n4 d4 y4 c h1 i1 x1 f1 h2 i2 x2 f2 ap off place".split()
_PATTERN = (
    r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +)?(?:(\d{4})([-/.])(\d{1,2})([-/.])(\d{1,2})|(\d{1,2})([/.])(\d{1,2})([/.])(\d{4})|(\d{1,2})(?:st|nd|rd|th)?[ -]+([a-z]{3,9})\.?,?[ -]+(\d{4})"
    r"|([a-z]{3,9})\.? +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})|(\d{8}))(?:(?: *t *|,? +(?:at +)?)(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?)(?: *([ap])\.?m\b\.?)?)?"
    r"(?: *(?:utc|gmt)?([+-]\d{2}(?::?\d{2})?))?(?: *([a-z]{1,5}|[a-z_]+/[a-z_/+-]+\d*|\[[a-z0-9_/+-]+\]|\([a-z0-9_/+-]+\)))?$"
)
_ZONES = ", ".join(f"('{k.lower()}', {v})" for k, v in ABBREVIATIONS.items())
_MONTHS = ", ".join(f"('{name}', {MONTHS[name[:3]]})" for name in sorted(_FULL))


def instants(table: str, key: str, value: str, name: str = "inst") -> str:
    """Named CTEs that end in ``name`` (key, utc_us): one row per row of ``table``, utc_us null where the value isn't readable."""
    d0, d1 = _DECADE
    got = "regexp_extract(v, '" + _PATTERN.replace("'", "''") + "', [" + ", ".join(f"'{f}'" for f in _FIELDS) + "])"
    digits = r"^(\d+)(?:[.,](\d+))?$"
    return f"""
zone_minutes(z, east) AS (VALUES {_ZONES}), month_names(name, mm) AS (VALUES {_MONTHS}), zone_names AS (SELECT lower(name) AS z, min(name) AS iana FROM pg_timezone_names() GROUP BY 1),
{name}_v AS (SELECT t.{key} AS k, trim(regexp_replace(lower(t.{value}), '\\s+', ' ', 'g')) AS v, coalesce(f.time_zone, 'UTC') AS tz, f.date_order AS o FROM {table} t LEFT JOIN feeds f USING (feed)),
{name}_d AS (SELECT *, TRY_CAST(regexp_extract(v, '{digits}', 1) AS BIGINT) AS n, regexp_extract(v, '{digits}', 2) AS nf, {got} AS g FROM {name}_v),
{name}_e AS (SELECT k, v, tz, o, n, CAST(rpad(left(nf, 6), 6, '0') AS BIGINT) AS nf, nf = '' AS bare, length(CASE WHEN n IS NOT NULL THEN regexp_extract(v, '{digits}', 1) ELSE '' END) AS w, g, trim(g.place, '[]()') AS place FROM {name}_d),
{name}_f AS (SELECT e.*, z.east, i.iana, mn.mm,
  CASE WHEN n IS NOT NULL AND bare AND w IN (8, 12, 14) THEN left(v, 4) || '-' || substr(v, 5, 2) || '-' || substr(v, 7, 2)
       WHEN g.y1 <> '' AND g.p1 = g.p2 THEN g.y1 || '-' || g.m1 || '-' || g.d1
       WHEN g.a <> '' AND g.s1 = g.s2 THEN CASE WHEN g.s1 = '/' AND o = 'mdy' THEN g.y2 || '-' || g.a || '-' || g.b ELSE g.y2 || '-' || g.b || '-' || g.a END
       WHEN mn.mm IS NOT NULL THEN g.y3 || g.y4 || '-' || mn.mm || '-' || g.d3 || g.d4
       WHEN g.c <> '' AND regexp_matches(v, '\\d{{8}} *t *\\d') THEN left(g.c, 4) || '-' || substr(g.c, 5, 2) || '-' || substr(g.c, 7, 2) END AS day_text,
  TRY_CAST(CASE WHEN n IS NOT NULL THEN coalesce(nullif(substr(v, 9, 2), ''), '0') ELSE coalesce(nullif(g.h1 || g.h2, ''), '0') END AS BIGINT) AS hh, TRY_CAST(CASE WHEN n IS NOT NULL THEN coalesce(nullif(substr(v, 11, 2), ''), '0') ELSE coalesce(nullif(g.i1 || g.i2, ''), '0') END AS BIGINT) AS mi,
  TRY_CAST(CASE WHEN n IS NOT NULL THEN coalesce(nullif(substr(v, 13, 2), ''), '0') ELSE coalesce(nullif(g.x1 || g.x2, ''), '0') END AS BIGINT) AS ss, CASE WHEN n IS NOT NULL THEN 0 ELSE CAST(rpad(left(g.f1 || g.f2, 6), 6, '0') AS BIGINT) END AS fr
  FROM {name}_e e LEFT JOIN zone_minutes z ON z.z = e.place LEFT JOIN zone_names i ON i.z = e.place LEFT JOIN month_names mn ON mn.name = e.g.n3 || e.g.n4 AND e.g.n3 || e.g.n4 <> ''),
{name}_g AS (SELECT k, n, nf, CASE WHEN g.ap <> '' THEN hh % 12 + CASE WHEN g.ap = 'p' THEN 12 ELSE 0 END ELSE hh END AS h24, mi, ss, fr,
  hh <= 23 AND mi <= 59 AND ss <= 59 AND (g.ap = '' OR hh BETWEEN 1 AND 12) AND (place = '' OR east IS NOT NULL OR iana IS NOT NULL) AS good, epoch_us(TRY_CAST(CASE WHEN length(split_part(day_text, '-', 1)) = 4 THEN day_text END AS DATE)) AS day_us,
  CASE WHEN g.off <> '' THEN (CAST(substr(g.off, 2, 2) AS BIGINT) * 60 + CAST(coalesce(nullif(substr(replace(g.off, ':', ''), 4, 2), ''), '0') AS BIGINT)) * CASE WHEN g.off[1] = '-' THEN -1 ELSE 1 END ELSE east END AS east,
  CASE WHEN iana IS NOT NULL AND east IS NULL THEN iana ELSE tz END AS tz FROM {name}_f),
{name}_h AS (SELECT *, CASE WHEN good AND day_us IS NOT NULL THEN day_us + ((h24 * 60 + mi) * 60 + ss) * 1000000 + fr END AS loc FROM {name}_g),
{name}_i AS (SELECT *, epoch_us(timezone(tz, make_timestamp(loc))) AS late FROM {name}_h),
{name} AS (SELECT k AS {key}, CASE WHEN n >= {d0} AND n < {d1} THEN n * 1000000 + nf WHEN n // 1000 >= {d0} AND n // 1000 < {d1} THEN n * 1000 + nf // 1000 WHEN n // 1000000 >= {d0} AND n // 1000000 < {d1} THEN n
  WHEN east IS NOT NULL THEN loc - east * 60000000 WHEN epoch_us(timezone(tz, make_timestamptz(late - 3600000000))) = loc THEN late - 3600000000 ELSE late END AS utc_us FROM {name}_i)"""
