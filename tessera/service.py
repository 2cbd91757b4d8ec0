"""The two correction routes over HTTP, by the standard library: python -m tessera.service [port]."""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from tessera.plans.correct import correct_before_llm, correct_final
from tessera.ship import ship

# The routes.
ROUTES = {"/v1/correct/prellm": correct_before_llm, "/v1/correct/final": correct_final}


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000, **how) -> ThreadingHTTPServer:
    """POST {"text": ...} to a route gives {"text", "llm_applied", "llm_attempted"}; 404 for another path, 422 for another body. The settings, and the
    lexicon that they name, are those of the environment at each request."""
    ship(spark)

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            route = ROUTES.get(self.path)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                given = body.get("text", "")
                valid = isinstance(given, str)
            except (ValueError, AttributeError):
                valid, given = False, ""
            if route is None:
                self.answer(404, {"detail": "Not Found"})
            elif not valid:
                self.answer(422, {"detail": "text must be a string"})
            else:
                self.answer(200, route(spark, given, **how))

        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


if __name__ == "__main__":
    server(SparkSession.builder.appName("tessera").getOrCreate(), port=int(sys.argv[1]) if len(sys.argv) > 1 else 8000).serve_forever()
