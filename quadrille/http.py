"""A SPARQL endpoint: GET and POST /sparql, POST /data, and a page to type queries into. Standard library only."""

from __future__ import annotations

import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .engine import Engine
from .plans.parser import SparqlSyntaxError
from .results import write as W
from .sources.files import format_of, parse_text
from .store import QuadStore

_PAGE = """<!doctype html><meta charset=utf-8><title>SPARQL</title>
<form action=/sparql><textarea name=query rows=12 cols=90>SELECT * { ?s ?p ?o } LIMIT 10</textarea><br><button>Run</button></form>"""


class Endpoint:
    """Queries go to the engine, or to the current version of the store; uploads need a store. Bodies over max_body bytes are
    refused, and connections that are silent for `timeout` seconds are closed. Results come to the driver whole: what is larger
    than its memory is written with SparqlResult.write instead."""

    def __init__(self, engine: Engine | None = None, store: QuadStore | None = None, max_body: int = 64 << 20, timeout: float = 15):
        self.engine, self.store, self.lock = engine, store, threading.Lock()
        self.max_body, self.timeout = max_body, timeout

    def query(self, text: str, accept: str | None) -> tuple[int, str, str]:
        """(status, media type, body)."""
        try:
            result = (self.store.engine() if self.engine is None else self.engine).sparql(text)
        except (SparqlSyntaxError, ValueError) as e:
            return 400, "application/json", json.dumps({"error": str(e)})
        try:
            media = W.NTRIPLES if result.kind in ("CONSTRUCT", "DESCRIBE") else W.negotiate(accept)
            return 200, media, result.serialize(media)
        except Exception as e:  # noqa: BLE001 - whatever the plan runs into goes to the client
            return 500, "application/json", json.dumps({"error": str(e).split("\n")[0]})

    def upload(self, body: bytes, media: str) -> tuple[int, str, str]:
        if self.store is None:
            return 405, "application/json", json.dumps({"error": "read only"})
        began = time.time()
        try:
            form = format_of(media)
        except ValueError as e:
            return 415, "application/json", json.dumps({"error": str(e)})
        try:
            quads = parse_text(body.decode("utf-8"), form, scope=uuid.uuid4().hex[:10] + "-")
            with self.lock:
                self.store.insert(quads)
        except ValueError as e:
            return 400, "application/json", json.dumps({"error": str(e)})
        took = max(time.time() - began, 1e-6)
        return 200, "application/json", json.dumps({"inserted": len(quads), "seconds": round(took, 3), "quads_per_second": round(len(quads) / took, 1)})

    def server(self, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
        me = self

        class Handler(BaseHTTPRequestHandler):
            timeout = me.timeout

            def reply(self, status: int, media: str, body: str) -> None:
                raw = body.encode("utf-8")
                self.send_response(status)
                for k, v in (("Content-Type", media + "; charset=utf-8"), ("Content-Length", str(len(raw))), ("Access-Control-Allow-Origin", "*")):
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(raw)

            def do_OPTIONS(self) -> None:  # noqa: N802
                self.send_response(204)
                for k, v in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "Content-Type, Accept")):
                    self.send_header("Access-Control-Allow-" + k, v)
                self.end_headers()

            def do_GET(self) -> None:  # noqa: N802
                at = urlsplit(self.path)
                if at.path == "/":
                    return self.reply(200, "text/html", _PAGE)
                found = parse_qs(at.query).get("query")
                if at.path != "/sparql":
                    return self.reply(404, "application/json", '{"error": "not found"}')
                if not found:
                    return self.reply(400, "application/json", '{"error": "no query"}')
                return self.reply(*me.query(found[0], self.headers.get("Accept")))

            def do_POST(self) -> None:  # noqa: N802
                size = self.headers.get("Content-Length") or "0"
                if not size.isdecimal() or int(size) > me.max_body:
                    self.close_connection = True
                    return self.reply(413 if size.isdecimal() else 400, "application/json", json.dumps({"error": f"a body has at most {me.max_body} bytes"}))
                body = self.rfile.read(int(size))
                media, path = self.headers.get("Content-Type") or "", urlsplit(self.path).path
                if path == "/data":
                    return self.reply(*me.upload(body, media))
                if path != "/sparql":
                    return self.reply(404, "application/json", '{"error": "not found"}')
                text = body.decode("utf-8")
                if "x-www-form-urlencoded" in media:
                    text = (parse_qs(text).get("query") or [""])[0]
                if not text.strip():
                    return self.reply(400, "application/json", '{"error": "no query"}')
                return self.reply(*me.query(text, self.headers.get("Accept")))

            def log_message(self, *_: object) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)
