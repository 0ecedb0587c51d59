import http.client
import json
import threading

import pytest

from meterql import cli
from meterql.admission import Quota, Quotas
from meterql.engine import Engine
from meterql.errors import QueryError
from meterql.service import config as settings
from meterql.service.app import App, server
from tests.fixtures import write_tables

KEY = {"X-API-Key": "k"}
GROUPED = "SELECT name, COUNT(*) AS n FROM orders GROUP BY name"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, write_tables(tmp_path_factory.mktemp("tables")), strict=True)


@pytest.fixture
def app(engine):
    return App(engine, settings.Config("", {"k": "acme", "poor": "poor"}, Quotas(Quota(0, 100), {"poor": Quota(0.5, 3)})))


def post(app, path, sql, headers=KEY):
    return app.handle("POST", path, headers, json.dumps({"sql": sql}).encode())


def test_public_and_private(app):
    assert app.handle("GET", "/health", {}).body["status"] == "ok" and app.handle("GET", "/metrics", {}).status == 200
    assert app.handle("GET", "/tables", {}).status == 401 and app.handle("GET", "/tables", {"x-api-key": "no"}).body == {"error": "missing or invalid API key"}
    assert app.handle("OPTIONS", "/query", {}).status == 204 and app.handle("GET", "/nope", KEY).status == 404 and app.handle("GET", "/query", KEY).status == 405
    response = app.handle("GET", "/health", {"X-Request-ID": "mine"})
    assert response.headers["X-Request-ID"] == "mine" and response.headers["Access-Control-Allow-Origin"] == "*" and len(app.handle("GET", "/health", {}).headers["X-Request-ID"]) == 16


def test_query_charges_and_refuses(app):
    ok = post(app, "/query", GROUPED + " ORDER BY name")
    assert ok.status == 200 and ok.body["rows"] == [["Alice", 3], ["Bob", 3], ["Carol", 2]] and ok.body["row_count"] == 3
    assert app.handle("GET", "/quota", KEY).body == {"tenant": "acme", "remaining": 98 - 1, "rate": 0, "burst": 100}
    poor = {"X-API-Key": "poor"}
    assert post(app, "/query", "SELECT id FROM orders LIMIT 1", poor).status == 200
    refused = post(app, "/query", GROUPED, poor)
    assert refused.status == 429 and refused.headers["Retry-After"] == str(refused.body["retry_after_seconds"]) and refused.body["retry_after_seconds"] >= 1
    assert {k: refused.body[k] for k in ("error", "estimated_cost", "tokens_required", "remaining")} == {"error": "rate limit exceeded", "estimated_cost": 19.0, "tokens_required": 2, "remaining": 1}
    stats = app.handle("GET", "/stats", KEY).body
    used = {u["tenant"]: u for u in stats["tenants"]}
    assert (stats["total_queries"], stats["total_throttled"], used["poor"]["tokens_requested"], used["poor"]["tokens_charged"]) == (3, 1, 4, 2)
    assert stats["recent"][0]["outcome"] == "throttled" and [b["count"] for b in stats["cost_buckets"]] == [0, 3, 0, 0, 0]
    text = app.handle("GET", "/metrics", {}).body
    assert 'meterql_queries_total{tenant="poor",outcome="throttled"} 1' in text and 'meterql_tokens_consumed_total{tenant="poor"} 2' in text and 'le="+Inf"} 2' in text


@pytest.mark.parametrize("body, message", [(b"{", "invalid JSON body"), (b'{"sql": "SELECT 1", "x": 1}', "unknown field"), (b"{}", "sql is required"), (b'{"sql": ""}', "sql is required"), (b'{"sql": "SELECT nope FROM orders"}', "unknown column"),
                                           (b'{"sql": "SELECT o.id FROM orders o RIGHT JOIN customers c ON o.name = c.name"}', "RIGHT joins are not supported yet")])
def test_errors_cost_nothing(app, body, message):
    response = app.handle("POST", "/query", KEY, body)
    assert response.status == 400 and message in response.body["error"] and app.handle("GET", "/quota", KEY).body["remaining"] == 100


def test_explain_plan_tables(app):
    assert post(app, "/explain", GROUPED).body["cost"] == 19 and "Total cost: 19.0" in post(app, "/explain", GROUPED).body["plan"]
    assert post(app, "/explain", "SELECT o.id FROM orders o RIGHT JOIN customers c ON o.name = c.name").status == 200
    assert post(app, "/plan", GROUPED).body["label"].startswith("Project") and post(app, "/plan", "SELECT").status == 400
    tables = {t["name"]: t["columns"] for t in app.handle("GET", "/tables", KEY).body["tables"]}
    assert tables["customers"][0] == {"name": "name", "type": "STRING", "nullable": True}


def test_fairness(engine):
    app = App(engine, settings.Config("", {"c": "cheap", "e": "dear"}, Quotas(Quota(0, 200)), cost_per_token=1))
    dear = "SELECT o.name, COUNT(*) FROM orders o JOIN customers c ON o.name = c.name GROUP BY o.name"
    passed = [sum(post(app, "/query", sql, {"X-API-Key": k}).status == 200 for _ in range(n)) for k, sql, n in (("c", "SELECT id FROM orders LIMIT 1", 13), ("e", dear, 7))]
    assert passed == [200 // 17, 200 // 36]


def test_over_a_socket(app):
    http_server = server(app, port=0)
    threading.Thread(target=http_server.serve_forever, daemon=True).start()
    try:
        link = http.client.HTTPConnection(*http_server.server_address, timeout=30)
        link.request("POST", "/query", json.dumps({"sql": "SELECT COUNT(*) FROM orders"}), KEY)
        reply = link.getresponse()
        assert reply.status == 200 and json.loads(reply.read())["rows"] == [[8]]
    finally:
        http_server.shutdown()
        http_server.server_close()


def test_large_results_are_streamed(engine):
    app = App(engine, settings.Config("", {"k": "acme"}, Quotas(Quota(0, 1000)), page_rows=5))
    small = post(app, "/query", GROUPED)
    assert small.body["row_count"] == 3
    large = post(app, "/query", "SELECT id, name FROM orders ORDER BY id")
    whole = json.loads("".join(large.body))
    assert whole["row_count"] == 8 and [r[0] for r in whole["rows"]] == sorted(r[0] for r in whole["rows"]) and whole["columns"][0]["name"] == "id"
    assert [e["rows"] for e in app.handle("GET", "/stats", KEY).body["recent"]] == [8, 3]
    http_server = server(app, port=0)
    threading.Thread(target=http_server.serve_forever, daemon=True).start()
    try:
        link = http.client.HTTPConnection(*http_server.server_address, timeout=60)
        for _ in range(2):  # the connection stays usable
            link.request("POST", "/query", json.dumps({"sql": "SELECT * FROM orders"}), KEY)
            reply = link.getresponse()
            assert reply.headers["Transfer-Encoding"] == "chunked" and len(json.loads(reply.read())["rows"]) == 8
    finally:
        http_server.shutdown()
        http_server.server_close()


def test_the_program_starts_with_a_shared_limiter(spark, tmp_path):
    from meterql.service import __main__ as program

    folder = write_tables(tmp_path)
    (tmp_path / "c.json").write_text(json.dumps({"data_dir": folder, "api_keys": {"k": {"tenant": "t"}}, "limiter": "shared", "store": f"file:{tmp_path}/b.db", "default_quota": {"rate": 0, "burst": 5}}))
    app = program.application(settings.load(str(tmp_path / "c.json")), spark)
    other = App(app.engine, app.config)  # a second service over the same store
    assert app.handle("GET", "/quota", KEY).body["remaining"] == 5
    assert post(app, "/query", "SELECT id FROM orders LIMIT 1").status == 200 and other.handle("GET", "/quota", KEY).body["remaining"] == 3
    with pytest.raises(QueryError, match="unknown store"):
        settings.Config("", {}, Quotas(Quota(1, 1)), limiter="shared", store="x").make_limiter()


def test_settings():
    good = settings.parse('{"data_dir": "d", "api_keys": {"a": {"tenant": "t", "quota": {"rate": 1, "burst": 5}}, "b": {"tenant": "t", "quota": {"rate": 1, "burst": 5}}, "c": {"tenant": "u"}}, "cost_per_token": 4, "limiter": "window"}')
    assert good.tenants == {"a": "t", "b": "t", "c": "u"} and good.quotas.of("t") == Quota(1, 5) and good.quotas.of("u") == Quota(10, 100) and type(good.make_limiter()).__name__ == "SlidingWindow"
    for text, message in (("{", "parse config"), ("{}", "data_dir is required"), ('{"data_dir": "d"}', "at least one api key"), ('{"data_dir": "d", "api_keys": {"a": {}}}', 'api key "a" has no tenant'), ('{"data_dir": "d", "x": 1}', "unknown setting"),
                          ('{"data_dir": "d", "api_keys": {"a": {"tenant": "t"}, "b": {"tenant": "t", "quota": {"rate": 1, "burst": 5}}}}', "disagree")):
        with pytest.raises(QueryError, match=message):
            settings.parse(text)


def test_command_line(engine):
    out = []
    run = lambda *a: (out.clear(), cli.run(list(a), out.append, lambda d: engine), "".join(out))[2]
    assert run("cost", GROUPED, "--data", "x") == "19.0\n" and run("tables", "--data=x") == "customers\norders\nstaff\n" and "(3 rows)" in run("query", "--data", "x", GROUPED)
    assert run("explain", GROUPED).startswith("Project: name, COUNT(*) AS n\n") and "Total cost" in run("explain", "--cost", GROUPED) and "usage" in run() and run("version").startswith("meterql ")
    for args, message in ((["nope"], "unknown command"), (["query"], "usage"), (["query", "--x", "y"], "unknown flag"), (["tables", "--data"], "requires a directory")):
        with pytest.raises(QueryError, match=message):
            run(*args)
