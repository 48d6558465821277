"""Serving a folder to browsers: byte ranges and cross-origin headers, on the standard library's server."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit


def byte_range(header: str | None, size: int) -> tuple[int, int] | str | None:
    """First and last byte of a single range; ``bad`` if it can't be met; nothing if there is none or it makes no sense."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", (header or "").strip())
    if not m or m[1] == m[2] == "":
        return None
    if not m[1]:
        n = min(int(m[2]), size)
        return (size - n, size - 1) if n else "bad"
    first, last = int(m[1]), int(m[2]) if m[2] else size - 1
    if last < first and m[2]:
        return None
    return (first, min(last, size - 1)) if first < size else "bad"


class RangeHandler(SimpleHTTPRequestHandler):
    """Files under ``mounts`` (by first part of the path), ``pages`` by path, the keys of ``remotes`` under ``/remote/<token>/`` and,
    at ``/api/open?store=...``, what ``opener`` says of a store. All of it is below ``base``; its root leads to ``start``."""

    mounts: dict[str, Path] = {}
    pages: dict[str, bytes] = {}
    remotes: dict[str, str] = {}
    base: str = ""
    start: str | None = None
    opener: Callable[[str], dict[str, Any]] | None = None

    def end_headers(self) -> None:
        self.send_header("Access-Control-Allow-Origin", "*")
        self.send_header("Access-Control-Allow-Headers", "Range")
        self.send_header("Access-Control-Expose-Headers", "Content-Range, Content-Length, Accept-Ranges")
        self.send_header("Accept-Ranges", "bytes")
        super().end_headers()

    def log_message(self, *args: Any) -> None:
        pass

    def do_OPTIONS(self) -> None:
        self.send_response(204)
        self.end_headers()

    def do_HEAD(self) -> None:
        self._answer(body=False)

    def do_GET(self) -> None:
        self._answer(body=True)

    def _answer(self, body: bool) -> None:
        url = urlsplit(self.path)
        if url.path != self.base and not url.path.startswith(f"{self.base}/"):
            return self.send_error(404)
        path = url.path[len(self.base) :] or "/"
        if path == "/" and self.start:
            self.send_response(302)
            self.send_header("Location", f"{self.base}{self.start}")
            self.send_header("Content-Length", "0")
            return self.end_headers()
        if path == "/api/open":
            return self._open(parse_qs(url.query).get("store", [""])[0], body)
        if (own := self.pages.get(path)) is not None:
            return self._send("text/html; charset=utf-8", len(own), lambda first, n: iter([own[first : first + n]]), body)
        _, mount, *rest = unquote(path).split("/")
        if mount == "remote" and len(rest) > 1:
            return self._relay(rest[0], rest[1:], body)
        root = self.mounts.get(mount)
        target = (root / "/".join(rest)).resolve() if root else None
        if target is None or not target.is_relative_to(root.resolve()) or not target.is_file():
            return self.send_error(404)
        return self._send(self.guess_type(str(target)), target.stat().st_size, lambda first, n: _stretches(target.open("rb"), first, n), body)

    def _relay(self, token: str, parts: list[str], body: bool) -> None:
        """A key of a remote store that was opened here: nothing outside it can be asked for."""
        from pyarrow import fs

        if token not in self.remotes or any(p in ("", ".", "..") or "\\" in p for p in parts):
            return self.send_error(404)
        try:
            system, root = fs.FileSystem.from_uri(self.remotes[token])
            key = "/".join([root.rstrip("/"), *parts])
            found = system.get_file_info(key)
            if found.type != fs.FileType.File:
                return self.send_error(404)
            source = system.open_input_file(key)
        except OSError:
            return self.send_error(502)
        return self._send("application/octet-stream", found.size, lambda first, n: _stretches(source, first, n), body)

    def _send(self, kind: str, size: int, read: Callable[[int, int], Iterator[bytes]], body: bool) -> None:
        span = byte_range(self.headers.get("Range"), size)
        if span == "bad":
            self.send_response(416)
            self.send_header("Content-Range", f"bytes */{size}")
            self.send_header("Content-Length", "0")
            return self.end_headers()
        first, last = span or (0, size - 1)
        self.send_response(206 if span else 200)
        if span:
            self.send_header("Content-Range", f"bytes {first}-{last}/{size}")
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(last - first + 1))
        self.end_headers()
        if body:
            for part in read(first, last - first + 1):
                self.wfile.write(part)

    def _open(self, store: str, body: bool) -> None:
        try:
            if not self.opener:
                raise FileNotFoundError("no stores can be opened here")
            status, text = 200, json.dumps(type(self).opener(store))
        except Exception as e:  # the page shows what went wrong
            status, text = 404 if isinstance(e, FileNotFoundError) else 400, json.dumps({"error": type(e).__name__, "message": str(e)})
        data = text.encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if body:
            self.wfile.write(data)


def _stretches(source: Any, first: int, n: int, step: int = 1 << 20) -> Iterator[bytes]:
    """Some bytes of a file, a stretch at a time."""
    with source as f:
        f.seek(first)
        while n > 0 and (part := f.read(min(step, n))):
            n -= len(part)
            yield part


def make_server(mounts: dict[str, str], port: int = 0, host: str = "127.0.0.1", opener: Callable[[str], dict[str, Any]] | None = None, pages: dict[str, str] | None = None, remotes: dict[str, str] | None = None, base: str = "", start: str | None = None) -> ThreadingHTTPServer:
    """A server of its own folders, pages and remote stores; port 0 takes a free one."""
    base = f"/{base.strip('/')}" if base.strip("/") else ""
    own = {"mounts": {k: Path(v) for k, v in mounts.items()}, "pages": {k: v.encode() for k, v in (pages or {}).items()}, "remotes": remotes or {}, "base": base, "start": start, "opener": staticmethod(opener) if opener else None}
    return ThreadingHTTPServer((host, port), type("Handler", (RangeHandler,), own))


def serve_page(html: str, mounts: dict[str, str] | None = None, **options: Any) -> ThreadingHTTPServer:
    """A server whose root leads to one page."""
    return make_server(mounts or {}, pages={"/index.html": html}, start="/index.html", **options)


def serve_viewer(spark: Any, stores: list[str], **options: Any) -> ThreadingHTTPServer:
    """A server of pyramids on this machine or remote ones, with a page; ``/api/open`` gives the configuration of one of them."""
    from .functions.display import token
    from .store import read_config
    from .viewer import browser_url, local_path, page, store_name

    here = {store_name(s): str(p) for s in stores if (p := local_path(s)) is not None}
    there = {token(s, "{}"): s for s in stores if local_path(s) is None and browser_url(s)}

    def opener(store: str) -> dict[str, Any]:
        if store not in stores:
            raise FileNotFoundError(store)
        return read_config(spark, store)

    first = read_config(spark, stores[0]) if stores else None
    return make_server(here, opener=opener, remotes=there, pages={"/index.html": page(first, store_name(stores[0]) if stores else None)}, start="/index.html", **options)
