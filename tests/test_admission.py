import subprocess
import sys
import tempfile
import threading
from pathlib import Path

import pytest

from meterql.admission import REDIS_STEP, FileStore, MemoryStore, Quota, Quotas, RedisStore, SharedTokenBucket, SlidingWindow, TokenBucket, bucket_step, open_store, tokens_for

ROOT = Path(__file__).resolve().parent.parent


class Clock:
    now = 100.0

    def __call__(self):
        return self.now


@pytest.mark.parametrize("tokens, elapsed, cost, allowed, left", [(10, 0, 4, True, 6), (3, 0, 3, True, 0), (2, 0, 5, False, 2), (0, 0.5, 5, True, 0), (0, 10, 1, True, 9), (10, 0, 20, False, 10), (5, -3, 5, True, 0)])
def test_bucket_step(tokens, elapsed, cost, allowed, left):
    decision, now = bucket_step(tokens, elapsed, cost, Quota(10, 10))
    assert (decision.allowed, now, decision.remaining) == (allowed, left, int(left))


def test_waiting_time():
    assert bucket_step(2, 0, 7, Quota(10, 10))[0].retry_after == 0.5 and bucket_step(2, 0, 7, Quota(0, 10))[0].retry_after == 0


@pytest.mark.parametrize("make", [lambda q, c: TokenBucket(q, c), lambda q, c: SharedTokenBucket(q, MemoryStore(c)), lambda q, c: SharedTokenBucket(q, FileStore(f"{tempfile.mkdtemp()}/b.db", c))])
def test_buckets(make):
    clock = Clock()
    limiter = make(Quotas(Quota(1, 10), {"vip": Quota(1, 100)}), clock)
    assert limiter.allow("a", 8).allowed and not limiter.allow("a", 3).allowed and limiter.allow("b", 10).allowed and limiter.allow("vip", 100).allowed
    assert limiter.allow("a", 0).remaining == 2 and limiter.allow("a", 0).remaining == 2
    clock.now += 1
    assert limiter.allow("a", 3).allowed
    with pytest.raises(ValueError):
        limiter.allow("a", -1)


def test_exactly_the_burst_under_threads():
    for limiter in (TokenBucket(Quotas(Quota(0, 200))), SharedTokenBucket(Quotas(Quota(0, 200)), MemoryStore())):
        passed = []
        threads = [threading.Thread(target=lambda: passed.append(limiter.allow("t", 7).allowed)) for _ in range(150)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert sum(passed) == 200 // 7


def test_sliding_window():
    clock = Clock()
    limiter = SlidingWindow(Quotas(Quota(10, 10)), 1.0, clock)
    assert limiter.allow("t", 10).allowed and not limiter.allow("t", 1).allowed
    clock.now += 1.5
    refused = limiter.allow("t", 6)
    assert not refused.allowed and refused.retry_after == pytest.approx(0.5) and limiter.allow("t", 5).allowed
    clock.now += 2.5
    assert limiter.allow("t", 0).remaining == 10


def test_tokens():
    assert [tokens_for(c) for c in (0, 19, 20, 20.1, 36)] == [1, 2, 2, 3, 4] and tokens_for(36, 1) == 36


class FakeRedis:
    """A server that knows one script, run as one step on the server's clock."""

    def __init__(self, clock):
        self.clock, self.data, self.ttl, self.calls = clock, {}, {}, []

    def eval(self, script, n_keys, key, rate, burst, cost, ttl):
        assert script is REDIS_STEP and n_keys == 1
        self.calls.append(key)
        tokens, at = self.data.get(key, (float(burst), self.clock()))
        decision, left = bucket_step(tokens, self.clock() - at, int(cost), Quota(float(rate), int(float(burst))))
        self.data[key], self.ttl[key] = (left, max(at, self.clock())), ttl
        return [int(decision.allowed), repr(left).encode()]


def test_redis_store():
    clock = Clock()
    client = FakeRedis(clock)
    limiter = SharedTokenBucket(Quotas(Quota(2, 10)), RedisStore(client))
    assert limiter.allow("t", 4).remaining == 6 and client.ttl == {"meterql:t": 6000}
    refused = limiter.allow("t", 7)
    assert not refused.allowed and refused.retry_after == 0.5 and len(client.calls) == 2  # one call a decision, whatever the contention
    clock.now += 0.5
    assert limiter.allow("t", 7).allowed


def test_stores_by_address(tmp_path):
    assert isinstance(open_store("memory:"), MemoryStore) and isinstance(open_store(f"file:{tmp_path}/a.db"), FileStore)
    for url, message in (("nope:x", "unknown store"), ("file:", "unknown store")):
        with pytest.raises(ValueError, match=message):
            open_store(url)


def test_a_file_store_is_shared_by_processes(tmp_path):
    path = f"{tmp_path}/buckets.db"
    code = f"from meterql.admission import *; b = SharedTokenBucket(Quotas(Quota(0, 100)), FileStore({path!r})); print(sum(b.allow('t', 7).allowed for _ in range(10)))"
    running = [subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, text=True, cwd=ROOT) for _ in range(4)]
    assert sum(int(p.communicate(timeout=60)[0]) for p in running) == 100 // 7
