"""What a viewer needs around a pyramid: is a store one, what is it called, where does a browser find it, and a page for it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any
from urllib.parse import quote, unquote, urlsplit

#: The outcomes of a check, with what to tell about each.
CODES = {
    "empty": "no store is named", "unsupported_scheme": "stores of this kind can't be read", "missing_dependency": "this kind of store needs a package that isn't installed", "bad_endpoint": "the endpoint isn't an address",
    "not_found": "there is nothing here", "access_denied": "reading isn't allowed", "unreachable": "the store doesn't answer", "not_zarr": "this isn't a Zarr store", "zarr_v2": "this is a Zarr store of version 2",
    "bad_metadata": "its metadata can't be read", "not_group": "this is an array, not a group", "not_pyramid": "this group has no levels", "invalid_pyramid": "its levels don't hang together",
}
SCHEMES = {"": "local", "file": "local", "s3": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs"}


@dataclass(frozen=True)
class Checked:
    """The outcome of a check: no code if the store is a pyramid."""

    code: str | None
    message: str
    root: Mapping[str, Any] | None = None

    def __bool__(self) -> bool:
        return self.code is None


def local_path(store: str) -> Path | None:
    """The path of a store on this machine."""
    url = urlsplit(store)
    if SCHEMES.get(url.scheme) != "local":
        return None
    return Path(unquote(url.path) if url.scheme else store).expanduser()


def store_name(store: str) -> str:
    """The last part of a store's place, without its ending."""
    path = str(local_path(store) or urlsplit(store).netloc + urlsplit(store).path).rstrip("/") if store else ""
    return re.sub(r"(?i)\.(zarr|parquet)$", "", path.rpartition("/")[2]) or "pyramid"


def browser_url(store: str, endpoint: str | None = None) -> str | None:
    """Where a browser reads a store in an object store; nothing for those it can't read."""
    url = urlsplit(store)
    kind, key = SCHEMES.get(url.scheme), quote(url.path.lstrip("/"))
    if url.scheme in ("http", "https"):
        return store
    if kind == "s3":
        return f"{endpoint.rstrip('/')}/{url.netloc}/{key}" if endpoint else f"https://{url.netloc}.s3.amazonaws.com/{key}"
    return f"https://storage.googleapis.com/{url.netloc}/{key}" if kind == "gs" else None


def object_store_settings(options: Mapping[str, Any] | None) -> dict[str, str]:
    """Hadoop settings for S3: the endpoint, plain HTTP if it says so, and no credentials unless they are given or in the environment."""
    options = dict(options or {})
    unknown = sorted(set(options) - {"endpoint", "region", "key", "secret", "token", "anonymous"})
    if unknown:
        raise TypeError(f"unknown storage options {unknown}")
    out = {}
    if endpoint := options.get("endpoint"):
        if not re.match(r"https?://[^/]+", endpoint):
            raise ValueError(f"not an endpoint: {endpoint!r}")
        out |= {"fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": "true", "fs.s3a.connection.ssl.enabled": str(endpoint.startswith("https")).lower()}
    if options.get("region"):
        out["fs.s3a.endpoint.region"] = options["region"]
    named = {"key": "fs.s3a.access.key", "secret": "fs.s3a.secret.key", "token": "fs.s3a.session.token"}
    out |= {setting: options[k] for k, setting in named.items() if options.get(k)}
    held = options.get("key") or any(os.environ.get(k) for k in ("AWS_ACCESS_KEY_ID", "AWS_PROFILE", "AWS_WEB_IDENTITY_TOKEN_FILE"))
    if options.get("anonymous", not held):
        out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    return out


def _document(store: str, name: str, endpoint: str | None) -> bytes | None:
    from pyarrow import fs

    path = local_path(store)
    if path is not None:
        return (path / name).read_bytes() if (path / name).is_file() else None
    url = urlsplit(store)
    if SCHEMES[url.scheme] == "s3" and endpoint:
        system, root = fs.S3FileSystem(endpoint_override=endpoint, anonymous=not os.environ.get("AWS_ACCESS_KEY_ID")), url.netloc + url.path
    else:
        system, root = fs.FileSystem.from_uri(store)
    try:
        with system.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def check_store(store: str | None, endpoint: str | None = None) -> Checked:
    """Whether a place holds a Zarr pyramid; never raises for what it finds there."""
    no = lambda code, more="": Checked(code, CODES[code] + (f": {more}" if more else ""))
    if not (store := (store or "").strip()):
        return no("empty")
    if urlsplit(store).scheme not in SCHEMES:
        return no("unsupported_scheme", urlsplit(store).scheme)
    if endpoint is not None and not re.match(r"https?://[^/]+", endpoint):
        return no("bad_endpoint", endpoint)
    path = local_path(store)
    try:
        if path is not None and not path.exists():
            return no("not_found", str(path))
        text = _document(store, "zarr.json", endpoint)
        if text is None:
            old = any(_document(store, n, endpoint) is not None for n in (".zgroup", ".zarray", ".zmetadata"))
            return no("zarr_v2" if old else "not_zarr" if path is not None else "not_found", store)
    except PermissionError as e:
        return no("access_denied", str(e))
    except ImportError as e:
        return no("missing_dependency", str(e))
    except (OSError, ValueError) as e:
        return no("access_denied" if re.search(r"(?i)denied|forbidden|\b403\b", str(e)) else "unreachable", str(e))
    try:
        root = json.loads(text)
        kind, attrs = root["node_type"], root.get("attributes") or {}
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        return no("bad_metadata", type(e).__name__)
    if kind != "group":
        return no("not_group")
    scales = attrs.get("multiscales") if isinstance(attrs, dict) else None
    layout = scales.get("layout") if isinstance(scales, dict) else None
    if not layout:
        return no("not_pyramid")
    assets = [x.get("asset") if isinstance(x, dict) else None for x in layout] if isinstance(layout, list) else [None]
    early = all(x.get("derived_from") in (None, *assets[:k]) for k, x in enumerate(layout)) if None not in assets else False
    if not early or not attrs.get("spatial:dimensions"):
        return no("invalid_pyramid")
    return Checked(None, "ok", root)


def blank_config() -> dict[str, Any]:
    """The configuration of a page that has no pyramid yet."""
    return {"title": "pyramid", "levels": [], "dims": [], "variables": [], "bbox": None, "crs": None, "global": False}


#: A plain page: the title, the levels and the variables of the configuration that is put into it.
PAGE = """<!doctype html>
<meta charset="utf-8"><title>{{title}}</title>
<style>body{font:14px sans-serif;margin:2em}td,th{padding:.2em .8em;text-align:left}</style>
<h1></h1><p id="where"></p><table id="levels"></table><table id="variables"></table>
<script type="application/json" id="config">{{config}}</script>
<script>
const config = JSON.parse(document.getElementById("config").textContent);
document.querySelector("h1").textContent = document.title;
document.getElementById("where").textContent = config.bbox ? `${(config.crs || {}).code || ""} ${config.bbox.join(", ")}` : "no pyramid is open";
function fill(id, heads, rows) {
  const table = document.getElementById(id);
  for (const cells of [heads, ...rows]) {
    const line = table.insertRow();
    for (const cell of cells) line.insertCell().textContent = cell;
  }
}
fill("levels", ["level", "rows", "columns"], config.levels.map(x => [x.asset, ...x.shape]));
fill("variables", ["variable", "unit", "from", "to"], config.variables.map(x => [x.long_name, x.units, x.vmin, x.vmax]));
</script>
"""


def page(config: Mapping[str, Any] | None = None, title: str | None = None) -> str:
    """A page with a configuration in it."""
    from .store import render_html

    return render_html(blank_config() | dict(config or {}) | ({"title": title} if title else {}), PAGE)
