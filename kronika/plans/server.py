"""A plain HTTP edge for `Service`: GET /api/books, POST /api/chat, answers and errors as JSON."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from kronika.plans.engine import Service


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(data)

        def run(self, what) -> None:
            try:
                self.answer(200, what())
            except Service.Error as error:
                self.answer(error.status, {"detail": str(error)})
            except Exception as error:  # a request must not end the server
                self.answer(500, {"detail": str(error)})

        def read(self) -> dict:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                raise Service.Error(422, "the request is no JSON") from None
            if not isinstance(body, dict):
                raise Service.Error(422, "the request is no JSON object")
            return body

        def do_GET(self) -> None:
            if self.path.rstrip("/") == "/api/books":
                self.run(service.books)
            else:
                self.answer(404, {"detail": "not found"})

        def do_POST(self) -> None:
            if self.path.rstrip("/") == "/api/chat":
                self.run(lambda: service.chat(self.read()))
            else:
                self.answer(404, {"detail": "not found"})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
