"""What the service counts: for scraping and for the stats page."""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections import Counter, deque
from dataclasses import asdict, dataclass, field

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
COST_BOUNDS = (10, 50, 100, 500)
KEPT = 100


@dataclass(frozen=True)
class Event:
    request_id: str
    time: str
    tenant: str
    sql: str
    outcome: str  # ok, throttled or error
    estimated_cost: float
    tokens: int
    rows: int
    latency_ms: int


@dataclass
class Usage:
    """tokens_requested counts refused queries too; tokens_charged does not."""

    tenant: str
    queries: int = 0
    throttled: int = 0
    tokens_requested: int = 0
    tokens_charged: int = 0


@dataclass
class Metrics:
    _lock: threading.Lock = field(default_factory=threading.Lock)
    queries: Counter = field(default_factory=Counter)
    tokens: Counter = field(default_factory=Counter)
    seconds: dict[str, list[float]] = field(default_factory=dict)
    usage: dict[str, Usage] = field(default_factory=dict)
    costs: list[int] = field(default_factory=lambda: [0] * (len(COST_BOUNDS) + 1))
    recent: deque = field(default_factory=lambda: deque(maxlen=KEPT))

    def record(self, event: Event, seconds: float) -> None:
        with self._lock:
            self.queries[event.tenant, event.outcome] += 1
            own = self.seconds.setdefault(event.tenant, [0.0] * (len(BUCKETS) + 2))
            own[bisect_left(BUCKETS, seconds)] += 1
            own[-1] += seconds
            used = self.usage.setdefault(event.tenant, Usage(event.tenant))
            used.queries += 1
            used.tokens_requested += event.tokens
            if event.outcome == "throttled":
                used.throttled += 1
            else:
                used.tokens_charged += event.tokens
            if event.outcome == "ok":
                self.tokens[event.tenant] += event.tokens
            self.costs[bisect_left(COST_BOUNDS, event.estimated_cost)] += 1
            self.recent.appendleft(event)

    def snapshot(self) -> dict:
        labels = ["0–10", *(f"{a}–{b}" for a, b in zip(COST_BOUNDS, COST_BOUNDS[1:])), f"{COST_BOUNDS[-1]}+"]
        with self._lock:
            return {
                "total_queries": sum(u.queries for u in self.usage.values()), "total_throttled": sum(u.throttled for u in self.usage.values()),
                "tenants": [asdict(u) for u in self.usage.values()], "cost_buckets": [{"label": a, "count": n} for a, n in zip(labels, self.costs)],
                "recent": [asdict(e) for e in self.recent],
            }

    def exposition(self) -> str:
        """The Prometheus text format."""
        quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        out = []
        with self._lock:
            out += ["# HELP meterql_queries_total Queries by tenant and outcome.", "# TYPE meterql_queries_total counter"]
            out += [f'meterql_queries_total{{tenant="{quote(t)}",outcome="{o}"}} {n}' for (t, o), n in sorted(self.queries.items())]
            out += ["# HELP meterql_query_duration_seconds Time of queries.", "# TYPE meterql_query_duration_seconds histogram"]
            for t, own in sorted(self.seconds.items()):
                total = 0
                for bound, n in zip([*map(str, BUCKETS), "+Inf"], own):
                    total += int(n)
                    out.append(f'meterql_query_duration_seconds_bucket{{tenant="{quote(t)}",le="{bound}"}} {total}')
                out += [f'meterql_query_duration_seconds_sum{{tenant="{quote(t)}"}} {own[-1]}', f'meterql_query_duration_seconds_count{{tenant="{quote(t)}"}} {total}']
            out += ["# HELP meterql_tokens_consumed_total Tokens of queries that ran.", "# TYPE meterql_tokens_consumed_total counter"]
            out += [f'meterql_tokens_consumed_total{{tenant="{quote(t)}"}} {n}' for t, n in sorted(self.tokens.items())]
        return "\n".join(out) + "\n"
