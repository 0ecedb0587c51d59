"""Requests to responses, and the server around them."""

from __future__ import annotations

import json
import logging
import math
import secrets
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from meterql import __version__
from meterql.admission import Limiter, tokens_for
from meterql.engine import Engine, Prepared, plain_row
from meterql.errors import QueryError
from meterql.service.config import Config
from meterql.service.metrics import Event, Metrics

log = logging.getLogger("meterql.service")
CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type, X-API-Key, X-Request-ID"}


@dataclass
class Response:
    status: int
    body: object = None  # JSON, text as it is, or pieces of text to stream
    headers: dict[str, str] = field(default_factory=dict)


class Refused(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


class App:
    """All endpoints over one engine; `handle` needs no socket."""

    def __init__(self, engine: Engine, config: Config, limiter: Limiter | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.engine, self.config, self.clock = engine, config, clock
        self.limiter, self.metrics = limiter or config.make_limiter(), Metrics()
        self.routes = {("GET", "/health"): (self.health, False), ("GET", "/metrics"): (self.exposition, False), ("POST", "/query"): (self.query, True), ("POST", "/explain"): (self.explain, True),
                       ("POST", "/plan"): (self.plan, True), ("GET", "/tables"): (self.tables, True), ("GET", "/quota"): (self.quota, True), ("GET", "/stats"): (self.stats, True)}

    def handle(self, method: str, path: str, headers: dict[str, str], body: bytes = b"") -> Response:
        own = {k.lower(): v for k, v in headers.items()}
        request_id = own.get("x-request-id") or secrets.token_hex(8)
        response = self._answer(method, path.partition("?")[0], own, body, request_id)
        response.headers = {**CORS, "X-Request-ID": request_id, **response.headers}
        return response

    def _answer(self, method: str, path: str, headers: dict[str, str], body: bytes, request_id: str) -> Response:
        if method == "OPTIONS":
            return Response(204)
        if (method, path) not in self.routes:
            known = any(p == path for _, p in self.routes)
            return Response(405 if known else 404, {"error": "method not allowed" if known else "not found"})
        action, private = self.routes[method, path]
        try:
            tenant = self.config.tenants.get(headers.get("x-api-key", "")) if private else ""
            if tenant is None:
                raise Refused(401, "missing or invalid API key")
            return action(tenant, body, request_id)
        except Refused as e:
            return Response(e.status, {"error": str(e)})
        except QueryError as e:
            return Response(400, {"error": str(e)})
        except Exception as e:
            log.exception("request %s failed", request_id)
            return Response(500, {"error": str(e).splitlines()[0] if str(e) else type(e).__name__})

    @staticmethod
    def _sql(body: bytes) -> str:
        try:
            raw = json.loads(body)
        except ValueError as e:
            raise Refused(400, f"invalid JSON body: {e}") from None
        if not isinstance(raw, dict) or (unknown := set(raw) - {"sql"}) or not isinstance(raw.get("sql", ""), str):
            raise Refused(400, f"invalid JSON body: {f'unknown field {min(unknown)!r}' if isinstance(raw, dict) and unknown else 'an object with sql is expected'}")
        if not raw.get("sql"):
            raise Refused(400, "sql is required")
        return raw["sql"]

    def health(self, *_) -> Response:
        return Response(200, {"status": "ok", "version": __version__})

    def exposition(self, *_) -> Response:
        return Response(200, self.metrics.exposition(), {"Content-Type": "text/plain; version=0.0.4; charset=utf-8"})

    def query(self, tenant: str, body: bytes, request_id: str) -> Response:
        """Prepare, charge, run: what cannot be prepared costs nothing, what fails later is not refunded."""
        sql, began = self._sql(body), self.clock()
        prepared = self.engine.prepare(sql)
        tokens = tokens_for(prepared.price, self.config.cost_per_token)
        decision = self.limiter.allow(tenant, tokens)

        def note(outcome: str, rows: int = 0) -> None:
            seconds = self.clock() - began
            self.metrics.record(Event(request_id, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), tenant, sql, outcome, prepared.price, tokens, rows, int(seconds * 1000)), seconds)
            log.info("query %s: request %s tenant %s cost %s tokens %s rows %s", outcome, request_id, tenant, prepared.price, tokens, rows)

        if not decision.allowed:
            wait = math.ceil(decision.retry_after)
            note("throttled")
            return Response(429, {"error": "rate limit exceeded", "estimated_cost": prepared.price, "tokens_required": tokens, "remaining": decision.remaining, "retry_after_seconds": wait}, {"Retry-After": str(wait)})
        try:
            with self._tagged(request_id):
                page = self.engine.page(prepared, self.config.page_rows)
        except Exception:
            note("error")
            raise
        if page is not None:
            note("ok", len(page.rows))
            return Response(200, page.to_json())
        return Response(200, self._pieces(prepared, request_id, note))

    def _pieces(self, prepared: Prepared, request_id: str, note: Callable) -> Iterator[str]:
        """The JSON of a large result, row by row; an error on the way ends it unclosed, which no reader takes for a whole answer."""
        n = 0
        try:
            with self._tagged(request_id):
                yield f'{{"columns": {json.dumps([f.to_json() for f in prepared.fields])}, "rows": ['
                for row in self.engine.stream(prepared):
                    yield (", " if n else "") + json.dumps(plain_row(row))
                    n += 1
                yield f'], "row_count": {n}}}'
        except BaseException:
            note("error", n)
            raise
        note("ok", n)

    @contextmanager
    def _tagged(self, request_id: str):
        """Jobs run under the request's tag, which a timeout interrupts."""
        spark, limit = self.engine.spark, self.config.timeout_seconds
        tag = f"meterql-{request_id}".replace(",", "_")
        spark.addTag(tag)
        timer = threading.Timer(limit, spark.interruptTag, [tag]) if limit > 0 else None
        try:
            if timer:
                timer.start()
            yield
        finally:
            if timer:
                timer.cancel()
            spark.removeTag(tag)

    def explain(self, tenant: str, body: bytes, request_id: str) -> Response:
        priced = self.engine.priced(self._sql(body))
        return Response(200, {"plan": priced.explain(), "cost": priced.price})

    def plan(self, tenant: str, body: bytes, request_id: str) -> Response:
        return Response(200, self.engine.plan_tree(self._sql(body)))

    def tables(self, *_) -> Response:
        return Response(200, {"tables": [{"name": t, "columns": [f.to_json() for f in self.engine.table_schema(t)]} for t in self.engine.tables()]})

    def quota(self, tenant: str, *_) -> Response:
        quota = self.config.quotas.of(tenant)
        return Response(200, {"tenant": tenant, "remaining": self.limiter.allow(tenant, 0).remaining, "rate": quota.rate, "burst": quota.burst})

    def stats(self, *_) -> Response:
        return Response(200, self.metrics.snapshot())


def server(app: App, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _serve(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            response = app.handle(self.command, self.path, dict(self.headers.items()), body)
            if isinstance(response.body, Iterator):
                return self._stream(response)
            data = b"" if response.body is None else response.body.encode() if isinstance(response.body, str) else json.dumps(response.body).encode()
            self.send_response(response.status)
            for name, value in {"Content-Type": "application/json", **response.headers, "Content-Length": str(len(data))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def _stream(self, response: Response) -> None:
            self.send_response(response.status)
            for name, value in {"Content-Type": "application/json", **response.headers, "Transfer-Encoding": "chunked"}.items():
                self.send_header(name, value)
            self.end_headers()
            try:
                for piece in response.body:
                    data = piece.encode()
                    self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
                self.wfile.write(b"0\r\n\r\n")
            except Exception:
                log.exception("a streamed answer was cut off")
                self.close_connection = True

        do_GET = do_POST = do_OPTIONS = do_PUT = do_DELETE = _serve

        def log_message(self, text: str, *args: object) -> None:
            log.debug(text, *args)

    return ThreadingHTTPServer((host, port), Handler)
