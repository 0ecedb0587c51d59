"""python -m meterql.service [--addr HOST:PORT] [--config FILE] [--data DIR]"""

from __future__ import annotations

import argparse
import dataclasses
import logging
import signal
import threading

from meterql.engine import Engine
from meterql.service import config as settings
from meterql.service.app import App, server


def application(config: settings.Config, spark) -> App:
    return App(Engine(spark, config.data_dir), config)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meterql-service")
    parser.add_argument("--addr", default=":8080")
    parser.add_argument("--config")
    parser.add_argument("--data")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    config = settings.load(given.config) if given.config else settings.development()
    if given.data:
        config = dataclasses.replace(config, data_dir=given.data)
    from pyspark.sql import SparkSession

    app = application(config, SparkSession.builder.appName("meterql-service").getOrCreate())
    host, _, port = given.addr.rpartition(":")
    http = server(app, host or "0.0.0.0", int(port))
    for sign in (signal.SIGINT, signal.SIGTERM):
        signal.signal(sign, lambda *_: threading.Thread(target=http.shutdown).start())
    http.serve_forever()  # threads of requests under way are joined by close
    http.server_close()
    app.engine.spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
