"""The service's settings, from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from meterql.admission import Limiter, Quota, Quotas, SharedTokenBucket, SlidingWindow, Store, TokenBucket, open_store
from meterql.errors import QueryError

COST_PER_TOKEN, PAGE_ROWS = 10.0, 10_000
LIMITERS = ("bucket", "window", "shared")


@dataclass(frozen=True)
class Config:
    """limiter: bucket (in process), window (in process), or shared (over the store that `store` addresses).

    page_rows: results of more rows are streamed, a partition at a time.
    """

    data_dir: str
    tenants: dict[str, str]  # by API key
    quotas: Quotas
    cost_per_token: float = COST_PER_TOKEN
    limiter: str = "bucket"
    timeout_seconds: float = 0.0
    store: str = ""
    page_rows: int = PAGE_ROWS
    keys: dict = field(default_factory=dict)

    def make_limiter(self, store: Store | None = None, clock: Callable[[], float] | None = None) -> Limiter:
        given = {"clock": clock} if clock else {}
        if self.limiter == "shared":
            if store is None and not self.store:
                raise QueryError("config: the shared limiter needs a store")
            try:
                return SharedTokenBucket(self.quotas, store or open_store(self.store))
            except ValueError as e:
                raise QueryError(f"config: {e}") from None
        return (SlidingWindow if self.limiter == "window" else TokenBucket)(self.quotas, **given)


def development(data_dir: str = "./testdata") -> Config:
    return Config(data_dir, {"dev-key": "dev"}, Quotas(Quota(10, 100)))


def _quota(raw: dict, where: str) -> Quota:
    try:
        quota = Quota(float(raw["rate"]), int(raw["burst"]))
    except (KeyError, TypeError, ValueError):
        raise QueryError(f"config: {where} needs a numeric rate and burst") from None
    if quota.rate < 0 or quota.burst < 0:
        raise QueryError(f"config: {where} must not be negative")
    return quota


def parse(text: str) -> Config:
    """Settings from JSON; two keys of one tenant may not disagree on its quota."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise QueryError(f"parse config: {e}") from None
    if unknown := set(raw) - {"data_dir", "default_quota", "api_keys", "cost_per_token", "limiter", "timeout_seconds", "store", "page_rows"}:
        raise QueryError(f"config: unknown setting {min(unknown)!r}")
    if not raw.get("data_dir"):
        raise QueryError("config: data_dir is required")
    if not raw.get("api_keys"):
        raise QueryError("config: at least one api key is required")
    if raw.get("limiter", "bucket") not in LIMITERS:
        raise QueryError(f"config: limiter must be one of {', '.join(LIMITERS)}")
    default = _quota(raw["default_quota"], "default_quota") if raw.get("default_quota") else Quota(10, 100)
    tenants, own, seen = {}, {}, {}
    for key, entry in raw["api_keys"].items():
        tenant = entry.get("tenant")
        if not tenant:
            raise QueryError(f'config: api key "{key}" has no tenant')
        quota = _quota(entry["quota"], f'quota of "{key}"') if entry.get("quota") else None
        if tenant in seen and seen[tenant] != quota:
            raise QueryError(f'config: the keys of tenant "{tenant}" disagree on its quota')
        tenants[key], seen[tenant] = tenant, quota
        if quota:
            own[tenant] = quota
    return Config(raw["data_dir"], tenants, Quotas(default, own), float(raw.get("cost_per_token") or COST_PER_TOKEN), raw.get("limiter", "bucket"), float(raw.get("timeout_seconds") or 0),
                  str(raw.get("store") or ""), int(raw.get("page_rows") or PAGE_ROWS))


def load(path: str) -> Config:
    try:
        with open(path) as f:
            return parse(f.read())
    except OSError as e:
        raise QueryError(f'read config "{path}": {e.strerror}') from None
