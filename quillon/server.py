"""HTTP routes that answer with counts."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .functions.tenant import normal
from .operators.store import Store
from .plans.requests import LogRequest, MetricRequest, TraceRequest


def answer(store: Store, url: str) -> tuple[int, dict]:
    """Status and body of GET /v1/traces, /v1/traces/{id}, /v1/logs and /v1/metrics."""
    parts, query = urlsplit(url), parse_qs(urlsplit(url).query)
    get = lambda k: query.get(k, [""])[0]
    path = parts.path
    if path == "/v1/traces":
        return 200, store.count(TraceRequest(tenant_id=get("tenant"), service=get("service")))
    if path.startswith("/v1/traces/"):
        trace_id = path.removeprefix("/v1/traces/")
        if not trace_id:
            return 400, {"error": "trace id is empty"}
        return 200, {"trace_id": trace_id, "count": store.read_trace_by_id(normal(get("tenant")), trace_id).count()}
    if path == "/v1/logs":
        return 200, store.count(LogRequest(tenant_id=get("tenant"), service=get("service")))
    if path == "/v1/metrics":
        return 200, store.count(MetricRequest(tenant_id=get("tenant"), service=get("service"), metric_name=get("metric")))
    return 404, {"error": "no such route"}


def serve(store: Store, address: str) -> ThreadingHTTPServer:
    """A server bound to host:port; the caller runs serve_forever."""
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(store, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_) -> None:
            pass

    host, _, port = address.rpartition(":")
    return ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
