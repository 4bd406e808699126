"""The queries over HTTP with JSON answers, on the standard library's server."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .query import NotFound, QueryService


def answer(service: QueryService, target: str) -> tuple[int, dict]:
    """Status and body for a GET of a path."""
    parts = urlsplit(target)
    if parts.path == "/":
        return 200, {"status": "ok", "message": "urlatlas"}
    found = re.fullmatch(r"/v1/domain/([^/]+)(?:/datasets/(\d+)/urls)?", parts.path)
    if not found:
        return 404, {"detail": "not found"}
    domain = unquote(found[1])
    try:
        if found[2] is None:
            rows = service.datasets_for_domain(domain).collect()
            return 200, {"domain": domain, "datasets": [{"dataset_id": r["dataset_id"], "url_count_est": r["urls"]} for r in rows]}
        given = {k: int(v[-1]) for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k in ("offset", "limit")}
        service._limits(given.get("offset", 0), given.get("limit"))
    except IndexError as e:
        return 422, {"detail": str(e)}
    except NotFound as e:
        return 404, {"detail": str(e)}
    except ValueError as e:
        return 422, {"detail": str(e)}
    except Exception as e:
        return 500, {"detail": str(e)[:500]}
    try:
        page, following = service.urls_page(domain, int(found[2]), **given)
        return 200, {"domain": domain, "dataset_id": int(found[2]), "total_est": None, "items": [{"url_id": r["url_id"], "url": r["url"], "ts": None} for r in page.collect()], "next_offset": following}
    except NotFound as e:
        return 404, {"detail": str(e)}
    except Exception as e:
        return 500, {"detail": str(e)[:500]}


def serve(service: QueryService, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = answer(service, self.path)
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
