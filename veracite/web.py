"""The service over HTTP: GET /health, POST /ask and POST /search with JSON bodies. Needs no web framework.

400: a body that isn't a JSON object; 404: another path; 422: a request that isn't valid; 503: the index hasn't been built.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .service import Service

#: Bytes of a request's body at most: a question has 2000 characters.
LARGEST = 64 << 10
_FIELDS = {"/ask": {"question", "k"}, "/search": {"question", "k", "jurisdiction", "include_withdrawn"}}


def answer(service: Service, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """(status, response) of a request."""
    if (method, path) == ("GET", "/health"):
        return 200, service.health()
    if method != "POST" or path not in _FIELDS:
        return 404, {"detail": "not found"}
    try:
        fields = json.loads(body or b"{}")
    except ValueError:
        return 400, {"detail": "the body isn't JSON"}
    if not isinstance(fields, dict):
        return 400, {"detail": "the body isn't an object"}
    fields = {k: v for k, v in fields.items() if k in _FIELDS[path]}
    if "question" not in fields or not isinstance(fields.get("jurisdiction"), str | None) or not isinstance(fields.get("include_withdrawn", True), bool):
        return 422, {"detail": "question is required; jurisdiction is a string, include_withdrawn a boolean"}
    try:
        return 200, getattr(service, path[1:])(**fields)
    except ValueError as e:
        return 422, {"detail": str(e)}
    except FileNotFoundError as e:
        return 503, {"detail": str(e)}


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that serve_forever() runs; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, found = (400, {"detail": "the body is too large"}) if size > LARGEST else answer(service, self.command, self.path.partition("?")[0], self.rfile.read(size))
            data = json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
