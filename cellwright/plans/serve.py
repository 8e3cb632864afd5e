"""A result as a page: its table, its profiles as bars, and the same as JSON; served by the standard library."""

from __future__ import annotations

import json
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from cellwright.plans.model import Expose

_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}.bar{background:#69c;display:inline-block;height:10px}"


def _bars(values: list[dict[str, Any]]) -> str:
    most = max((v["count"] for v in values), default=0) or 1
    label = lambda v: str(v["value"]) if "value" in v else f"{v['lo']:g} to {v['hi']:g}"
    return "".join(f"<div><span class=bar style='width:{200 * v['count'] // most}px'></span> {escape(label(v))}: {v['count']}</div>" for v in values)


def result_page(payload: dict[str, Any], title: str = "Result") -> str:
    """The payload of :func:`cellwright.plans.executor.result_payload` as one page without outside parts."""
    head = "".join(f"<th>{escape(c)}</th>" for c in payload["columns"])
    rows = "".join("<tr>" + "".join(f"<td>{escape('' if r[c] is None else str(r[c]))}</td>" for c in payload["columns"]) + "</tr>" for r in payload["rows"])
    parts = "".join(f"<h3>{escape(p['column'])} ({p['kind']}, {p['non_null']} of {p['rows']})</h3>{_bars(p['values'])}" for p in payload["profiles"])
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><style>{_STYLE}</style><h1>{escape(title)}</h1><table><tr>{head}</tr>{rows}</table>{parts}"


def make_server(payload: dict[str, Any], expose: Expose) -> ThreadingHTTPServer:
    """A server of the page at ``/`` and the payload at ``/api/result``; the caller runs and stops it."""
    answers = {
        "/": ("text/html; charset=utf-8", result_page(payload).encode()),
        "/api/result": ("application/json", json.dumps(payload, default=str).encode()),
    }

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            kind, body = answers.get(self.path, ("text/plain", b"not found"))
            self.send_response(200 if self.path in answers else 404)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((expose.host, expose.port), Handler)
