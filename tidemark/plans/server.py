"""A query endpoint: one query a connection, answered in lines of text."""

from __future__ import annotations

import socketserver

from pyspark.errors import PySparkException

from tidemark.model import QueryError
from tidemark.plans.output import error_line
from tidemark.plans.planner import Engine


def serve(engine: Engine, address: tuple[str, int]) -> socketserver.ThreadingTCPServer:
    """A server that is ready for ``serve_forever``. Rows stream from the cluster partition by partition."""

    class Handler(socketserver.StreamRequestHandler):
        timeout = 10

        def handle(self) -> None:
            try:
                for row in engine.text(self.rfile.read().decode().strip("\n")).toLocalIterator():
                    self.wfile.write(f"{row['line']}\n".encode())
            except (QueryError, UnicodeDecodeError, PySparkException) as e:
                self.wfile.write(f"{error_line(e)}\n".encode())

    return socketserver.ThreadingTCPServer(address, Handler)
