"""Keyed state machines over events, exactly: limiter, breaker, cache, spend.

Each state machine is a plain function from (state, event) to (state, decision).
The batch form folds it over the events of a key in order of time; the streaming
form (``quarry.streaming.gates``) keeps the same state between micro-batches.  A
key's events are read in batches, so a busy key takes no more memory than its
state.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from quarry import rules


@dataclass
class Limiter:
    """Accepted requests of the last minute and day; rejected ones leave no trace."""

    tier: str
    accepted: list[float] = field(default_factory=list)

    def decide(self, now: float) -> str:
        per_minute, per_day = rules.TIER_LIMITS.get(self.tier, rules.TIER_LIMITS["anonymous"])
        del self.accepted[: bisect_left(self.accepted, now - 86400)]
        in_minute = len(self.accepted) - bisect_left(self.accepted, now - 60)
        if per_day is not None and len(self.accepted) >= per_day:
            return "soft_wall" if self.tier == "anonymous" else "day_cap"
        if in_minute >= per_minute:
            return "minute_cap"
        self.accepted.append(now)
        return "ok"


@dataclass
class Subnet:
    """Anonymous requests of a subnet; a third breach in a day flags it for a week."""

    accepted: list[float] = field(default_factory=list)
    breaches: list[float] = field(default_factory=list)
    flagged_until: float = 0.0

    def decide(self, now: float) -> str:
        del self.accepted[: bisect_left(self.accepted, now - 86400)]
        in_hour = len(self.accepted) - bisect_left(self.accepted, now - 3600)
        if in_hour >= rules.SUBNET_HOUR or len(self.accepted) >= rules.SUBNET_DAY:
            del self.breaches[: bisect_left(self.breaches, now - 86400)]
            self.breaches.append(now)
            if len(self.breaches) >= rules.SUBNET_BREACHES:
                self.flagged_until = now + rules.FLAG_SECONDS
            return "subnet_cap"
        self.accepted.append(now)
        return "ok"

    def flagged(self, now: float) -> bool:
        return now < self.flagged_until


@dataclass
class Breaker:
    """Opens at five failures in a minute; success clears them but never shortens an open period."""

    window: float = rules.BREAKER_WINDOW
    hold: float = rules.BREAKER_OPEN
    failures: list[float] = field(default_factory=list)
    open_until: float = 0.0

    def is_open(self, now: float) -> bool:
        if self.open_until and now >= self.open_until:
            self.open_until, self.failures = 0.0, []
        return bool(self.open_until)

    def record(self, now: float, failed: bool) -> str:
        was_open = self.is_open(now)
        if not failed:
            self.failures = []
        else:
            self.failures = [t for t in self.failures if t >= now - self.window] + [now]
            if len(self.failures) >= rules.BREAKER_FAILURES and not self.open_until:
                self.open_until = now + self.hold
        return "open" if was_open or self.open_until else "closed"


@dataclass
class Cache:
    """One answer of a key: a hit within its lifetime, else stored anew."""

    created: float | None = None

    def look_up(self, now: float, ttl: float = rules.CACHE_TTL_DAYS * 86400) -> str:
        if self.created is not None and now - self.created <= ttl:
            return "hit"
        out = "miss" if self.created is None else "stale"
        self.created = now
        return out


def fold(events: DataFrame, key: str, step: Callable[[dict, pd.Series], str], new: Callable[[pd.Series], object]) -> DataFrame:
    """``decision`` of each event; ``events`` has the key, ``event_id`` and ``ts``.

    Keys are partitioned and sorted by time, and each partition is read as a
    stream of batches; only the current key's state is held.
    """
    columns = events.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields) + ", decision string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if k != current:
                    current, state = k, new(row)
                out.append(step(state, row))
            yield b[columns].assign(decision=out)

    ordered = events.repartition(key).sortWithinPartitions(key, "ts", "event_id")
    return ordered.mapInPandas(run, schema)


def _seconds(row) -> float:
    return row.ts.timestamp()


def limit_requests(events: DataFrame, key: str, tier: str) -> DataFrame:
    return fold(events, key, lambda s, r: s.decide(_seconds(r)), lambda r: Limiter(getattr(r, tier)))


def limit_subnets(events: DataFrame, key: str) -> DataFrame:
    return fold(events, key, lambda s, r: s.decide(_seconds(r)), lambda r: Subnet())


def break_circuits(events: DataFrame, key: str, failed: str, window: float = rules.BREAKER_WINDOW, hold: float = rules.BREAKER_OPEN) -> DataFrame:
    return fold(events, key, lambda s, r: s.record(_seconds(r), bool(getattr(r, failed))), lambda r: Breaker(window, hold))


def cache_lookups(events: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    return fold(events, key, lambda s, r: s.look_up(_seconds(r), ttl_seconds), lambda r: Cache())
