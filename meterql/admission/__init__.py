"""Admission control: who may spend how much, and when.

Limiters work on the driver in plain Python with an injected clock; the shared
one leaves its state, and the clock, to a store that several drivers use.
"""

from __future__ import annotations

import math
import sqlite3
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

Clock = Callable[[], float]


@dataclass(frozen=True)
class Quota:
    """rate tokens a second, up to burst."""

    rate: float
    burst: int


@dataclass(frozen=True)
class Quotas:
    """A default and what differs by tenant."""

    default: Quota
    by_tenant: dict[str, Quota] = field(default_factory=dict)

    def of(self, tenant: str) -> Quota:
        return self.by_tenant.get(tenant, self.default)


@dataclass(frozen=True)
class Decision:
    allowed: bool
    remaining: int
    retry_after: float = 0.0  # seconds; 0 if waiting does not help


class Limiter(Protocol):
    def allow(self, tenant: str, cost: int) -> Decision: ...


def tokens_for(cost: float, cost_per_token: float = 10.0) -> int:
    """Tokens that a price takes: at least one."""
    return max(1, math.ceil(cost / cost_per_token))


def _checked(cost: int) -> int:
    if cost < 0:
        raise ValueError("cost must not be negative")
    return cost


def bucket_step(tokens: float, elapsed: float, cost: int, quota: Quota) -> tuple[Decision, float]:
    """One decision of a token bucket and the tokens left; a denial takes nothing."""
    tokens = min(float(quota.burst), tokens + max(0.0, elapsed) * quota.rate)
    if cost <= tokens:
        return Decision(True, int(tokens - cost)), tokens - cost
    return Decision(False, int(tokens), (cost - tokens) / quota.rate if quota.rate > 0 else 0.0), tokens


class TokenBucket:
    """In-process token buckets; a new tenant's is full."""

    def __init__(self, quotas: Quotas, clock: Clock = time.monotonic) -> None:
        self.quotas, self.clock, self._lock = quotas, clock, threading.Lock()
        self._state: dict[str, tuple[float, float]] = {}

    def allow(self, tenant: str, cost: int) -> Decision:
        """A cost of zero is a look that takes nothing."""
        _checked(cost)
        quota = self.quotas.of(tenant)
        with self._lock:
            now = self.clock()
            tokens, at = self._state.get(tenant, (float(quota.burst), now))
            decision, tokens = bucket_step(tokens, now - at, cost, quota)
            self._state[tenant] = tokens, max(now, at)
            return decision


class SlidingWindow:
    """At most `burst` tokens in a window of burst / rate seconds (or a given one); the window before counts by what still overlaps."""

    def __init__(self, quotas: Quotas, window: float | None = None, clock: Clock = time.monotonic) -> None:
        self.quotas, self.window, self.clock, self._lock = quotas, window, clock, threading.Lock()
        self._state: dict[str, tuple[float, float, float]] = {}  # start, spent before, spent now

    def allow(self, tenant: str, cost: int) -> Decision:
        _checked(cost)
        quota = self.quotas.of(tenant)
        window = self.window or (quota.burst / quota.rate if quota.rate > 0 else math.inf)
        with self._lock:
            now = self.clock()
            start, before, spent = self._state.get(tenant, (now, 0.0, 0.0))
            passed = int((now - start) // window) if window < math.inf else 0
            if passed == 1:
                start, before, spent = start + window, spent, 0.0
            elif passed > 1:
                start, before, spent = now, 0.0, 0.0
            elapsed = max(0.0, now - start)
            used = before * (1 - elapsed / window if window < math.inf else 1) + spent
            allowed = used + cost <= quota.burst
            self._state[tenant] = start, before, spent + cost if allowed else spent
            left = quota.burst - used - (cost if allowed else 0)
            return Decision(allowed, max(0, int(left)), 0.0 if allowed or window == math.inf else window - elapsed)


class Store(Protocol):
    """What several drivers share: one decision is one atomic step on the store's own clock."""

    def step(self, key: str, cost: int, quota: Quota) -> Decision: ...


def _lifetime(quota: Quota) -> float:
    """Seconds for which a bucket is worth keeping: it outlives its refill by a second."""
    return (quota.burst / quota.rate if quota.rate > 0 else 3600.0) + 1


class SharedTokenBucket:
    """Token buckets in a shared store."""

    def __init__(self, quotas: Quotas, store: Store, prefix: str = "meterql:") -> None:
        self.quotas, self.store, self.prefix = quotas, store, prefix

    def allow(self, tenant: str, cost: int) -> Decision:
        return self.store.step(self.prefix + tenant, _checked(cost), self.quotas.of(tenant))


class MemoryStore:
    """A store for one process, and for tests."""

    def __init__(self, clock: Clock = time.time) -> None:
        self.clock, self._lock = clock, threading.Lock()
        self._data: dict[str, tuple[float, float, float]] = {}  # tokens, at, until

    def step(self, key: str, cost: int, quota: Quota) -> Decision:
        with self._lock:
            now = self.clock()
            tokens, at, until = self._data.get(key, (float(quota.burst), now, math.inf))
            if until <= now:
                tokens, at = float(quota.burst), now
            decision, left = bucket_step(tokens, now - at, cost, quota)
            self._data[key] = left, max(now, at), now + _lifetime(quota)
            return decision


class FileStore:
    """A store in one SQLite file, for services of one host: a step is a transaction that locks the file before it reads."""

    def __init__(self, path: str, clock: Clock = time.time, wait_seconds: float = 30.0) -> None:
        self.path, self.clock, self.wait = path, clock, wait_seconds
        with self._open() as link:
            link.execute("CREATE TABLE IF NOT EXISTS buckets (key TEXT PRIMARY KEY, tokens REAL NOT NULL, at REAL NOT NULL, until REAL NOT NULL)")

    @contextmanager
    def _open(self):
        link = sqlite3.connect(self.path, timeout=self.wait, isolation_level=None)
        try:
            link.execute("BEGIN IMMEDIATE")
            yield link
            link.execute("COMMIT")
        finally:
            link.close()  # a transaction that has not got so far is undone

    def step(self, key: str, cost: int, quota: Quota) -> Decision:
        with self._open() as link:
            now = self.clock()
            tokens, at = link.execute("SELECT tokens, at FROM buckets WHERE key = ? AND until > ?", (key, now)).fetchone() or (float(quota.burst), now)
            decision, left = bucket_step(tokens, now - at, cost, quota)
            link.execute("INSERT OR REPLACE INTO buckets VALUES (?, ?, ?, ?)", (key, left, max(now, at), now + _lifetime(quota)))
            return decision


#: The step of bucket_step as a script that the server runs as one, on its own clock. Numbers are handed back as text, as the server cuts fractions off.
REDIS_STEP = """
local rate, burst, cost = tonumber(ARGV[1]), tonumber(ARGV[2]), tonumber(ARGV[3])
local clock = redis.call('TIME')
local now = tonumber(clock[1]) + tonumber(clock[2]) / 1000000
local known = redis.call('HMGET', KEYS[1], 'tokens', 'at')
local tokens, at = tonumber(known[1]) or burst, tonumber(known[2]) or now
tokens = math.min(burst, tokens + math.max(0, now - at) * rate)
local allowed = cost <= tokens
if allowed then tokens = tokens - cost end
redis.call('HSET', KEYS[1], 'tokens', string.format('%.17g', tokens), 'at', string.format('%.17g', math.max(now, at)))
redis.call('PEXPIRE', KEYS[1], ARGV[4])
return {allowed and 1 or 0, string.format('%.17g', tokens)}
"""


class RedisStore:
    """The store over a Redis client (redis-py's interface): a step is one script call."""

    def __init__(self, client) -> None:
        self.client = client

    def step(self, key: str, cost: int, quota: Quota) -> Decision:
        allowed, text = self.client.eval(REDIS_STEP, 1, key, repr(float(quota.rate)), repr(float(quota.burst)), cost, int(_lifetime(quota) * 1000))
        tokens = float(text)
        wait = 0.0 if allowed or quota.rate <= 0 else (cost - tokens) / quota.rate
        return Decision(bool(allowed), int(tokens), wait)


def open_store(url: str) -> Store:
    """A store by its address: file:PATH, redis://..., or memory: (one process)."""
    kind, _, rest = url.partition(":")
    if kind == "file" and rest:
        return FileStore(rest.removeprefix("//"))
    if kind == "memory":
        return MemoryStore()
    if kind in ("redis", "rediss"):
        try:
            import redis
        except ModuleNotFoundError as e:
            if e.name != "redis":
                raise
            raise ValueError("a redis store needs the redis package") from None
        return RedisStore(redis.Redis.from_url(url))
    raise ValueError(f'unknown store "{url}" (file:PATH, redis://HOST or memory:)')
