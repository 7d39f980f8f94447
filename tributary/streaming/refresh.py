"""When stored tables are refreshed: intervals and cron lines, driven by a thread of the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime, timedelta

from tributary.errors import EngineError

_FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


class Cron:
    """minute hour day month weekday, with ``*``, lists, ranges and steps; day and weekday are alternatives when both are given."""

    def __init__(self, line: str):
        parts = line.split()
        if len(parts) != 5:
            raise EngineError("CONFIG_DURATION", f"a cron line has five fields: {line!r}")
        self.sets = [self._field(p, lo, hi) for p, (lo, hi) in zip(parts, _FIELDS)]
        self.sets[4] = {d % 7 for d in self.sets[4]}
        self.either = parts[2] != "*" and parts[4] != "*"

    @staticmethod
    def _field(text: str, lo: int, hi: int) -> set[int]:
        out: set[int] = set()
        for item in text.split(","):
            span, _, step = item.partition("/")
            try:
                a, b = (lo, hi) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
                if step and "-" not in span and span != "*":
                    b = hi
                values = range(a, b + 1, int(step or 1))
            except ValueError as e:
                raise EngineError("CONFIG_DURATION", f"bad cron field {item!r}") from e
            if not values or values[0] < lo or values[-1] > hi:
                raise EngineError("CONFIG_DURATION", f"bad cron field {item!r}")
            out |= set(values)
        return out

    def next(self, after: datetime) -> datetime:
        t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
        for _ in range(366 * 5):
            day, weekday = t.day in self.sets[2], (t.weekday() + 1) % 7 in self.sets[4]
            if t.month in self.sets[3] and (day or weekday if self.either else day and weekday):
                for h in sorted(x for x in self.sets[1] if x >= t.hour):
                    for m in sorted(x for x in self.sets[0] if h > t.hour or x >= t.minute):
                        return t.replace(hour=h, minute=m)
            t = (t + timedelta(days=1)).replace(hour=0, minute=0)
        raise EngineError("CONFIG_DURATION", "the cron line never comes due")


class Refresher:
    """Runs ``refresh`` every ``seconds`` or when ``cron`` is due. The first tick waits a whole interval; ticks that a slow refresh misses are skipped."""

    def __init__(self, refresh: Callable[[], None], seconds: float | None = None, cron: str | None = None):
        self.refresh, self.seconds, self.cron, self.errors = refresh, seconds, Cron(cron) if cron else None, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _wait(self) -> float:
        if self.cron:
            now = datetime.now()
            return (self.cron.next(now) - now).total_seconds()
        return self.seconds

    def _run(self) -> None:
        while not self._stop.wait(self._wait()):
            try:
                self.refresh()
            except Exception as e:
                self.errors.append(e)

    def start(self) -> Refresher:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join(timeout=10)
