"""The range server."""

import json
import threading
from http.client import HTTPConnection

import pytest

from tessera.serve import byte_range, make_server, serve_page
from tessera.viewer import browser_url, check_store, object_store_settings, page, store_name


@pytest.mark.parametrize("header,want", [(None, None), ("bytes=0-3", (0, 3)), ("bytes=4-", (4, 9)), ("bytes=-3", (7, 9)), ("bytes=10-", "bad"), ("bytes=5-2", None), ("bytes=-", None), ("bytes=2-99", (2, 9)), ("items=1-2", None), ("bytes=-0", "bad")])
def test_ranges(header, want):
    assert byte_range(header, 10) == want


def test_server(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"0123456789")
    (tmp_path / "secret").write_text("no")
    server = make_server({"m": str(tmp_path / "in")}, opener=lambda store: {"store": store} if store == "x" else 1 / 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, method="GET", **headers):
        c = HTTPConnection(*server.server_address)
        c.request(method, path, headers=headers)
        r = c.getresponse()
        return r.status, r.read(), dict(r.getheaders())

    try:
        assert ask("/m/a.bin")[:2] == (200, b"0123456789")
        status, body, headers = ask("/m/a.bin", Range="bytes=2-4")
        assert (status, body, headers["Content-Range"], headers["Access-Control-Allow-Origin"]) == (206, b"234", "bytes 2-4/10", "*")
        assert ask("/m/a.bin", Range="bytes=50-")[0] == 416
        assert ask("/m/../secret")[0] == ask("/m/%2e%2e/secret")[0] == ask("/q/a.bin")[0] == 404
        assert ask("/m/a.bin", "HEAD")[:2] == (200, b"") and ask("/m/a.bin", "OPTIONS")[0] == 204
        assert json.loads(ask("/api/open?store=x")[1]) == {"store": "x"} and ask("/api/open?store=y")[0] == 400
    finally:
        server.shutdown()


def test_pages_base_start_and_relay(tmp_path):
    (tmp_path / "far/a").mkdir(parents=True)
    (tmp_path / "far/a/k").write_bytes(bytes(range(256)) * 9000)
    (tmp_path / "secret").write_text("no")
    server = serve_page(page({"levels": [{"asset": "0", "shape": [1, 2]}]}, "a<b"), remotes={"abc": f"file://{tmp_path}/far"}, base="/x/")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, **headers):
        c = HTTPConnection(*server.server_address)
        c.request("GET", path, headers=headers)
        r = c.getresponse()
        return r.status, r.read(), dict(r.getheaders())

    try:
        assert ask("/x")[0] == 302 and ask("/x/")[2]["Location"] == "/x/index.html"
        assert b"<title>ab</title>" in ask("/x/index.html")[1] and ask("/index.html")[0] == ask("/xy")[0] == 404
        assert ask("/x/remote/abc/a/k")[1] == bytes(range(256)) * 9000 and ask("/x/remote/abc/a/k", Range="bytes=300-303")[1] == bytes([44, 45, 46, 47])
        assert {ask(f"/x/remote/{p}")[0] for p in ("abc/../secret", "abc/%2e%2e/secret", "abd/a/k", "abc/a", "abc/a/none")} == {404}
    finally:
        server.shutdown()


def test_checks_of_stores(tmp_path):
    def put(name, **files):
        for f, text in files.items():
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f.replace("_", ".")).write_text(text if isinstance(text, str) else json.dumps(text))
        return str(tmp_path / name)

    group = lambda **attrs: {"node_type": "group", "attributes": attrs}
    layout = [{"asset": "0"}, {"asset": "1", "derived_from": "0"}]
    cases = {
        None: "empty", "ftp://a/b": "unsupported_scheme", str(tmp_path / "no"): "not_found", put("plain", a_txt="x"): "not_zarr", put("old", _zgroup="{}"): "zarr_v2", put("bad", zarr_json="{"): "bad_metadata",
        put("list", zarr_json=[1]): "bad_metadata", put("array", zarr_json={"node_type": "array"}): "not_group", put("group", zarr_json=group()): "not_pyramid", put("odd", zarr_json=group(multiscales={"layout": [1]})): "invalid_pyramid",
        put("late", zarr_json=group(multiscales={"layout": layout[::-1]}, **{"spatial:dimensions": ["y", "x"]})): "invalid_pyramid", put("good", zarr_json=group(multiscales={"layout": layout}, **{"spatial:dimensions": ["y", "x"]})): None,
    }
    for store, code in cases.items():
        assert check_store(store).code == code, store
    assert check_store(f"file://{tmp_path}/good") and check_store("s3://b/k", endpoint="nowhere").code == "bad_endpoint"
    assert (store_name("/a/b.zarr/"), store_name("s3://bucket/x.zarr"), store_name("")) == ("b", "x", "pyramid")
    assert browser_url("s3://b/a k.zarr") == "https://b.s3.amazonaws.com/a%20k.zarr" and browser_url("gs://b/k") == "https://storage.googleapis.com/b/k" and browser_url("/a") is None


def test_object_store_settings(monkeypatch):
    for k in ("AWS_ACCESS_KEY_ID", "AWS_PROFILE", "AWS_WEB_IDENTITY_TOKEN_FILE"):
        monkeypatch.delenv(k, raising=False)
    got = object_store_settings({"endpoint": "http://localhost:9000"})
    assert got["fs.s3a.connection.ssl.enabled"] == "false" and "Anonymous" in got["fs.s3a.aws.credentials.provider"]
    assert "fs.s3a.aws.credentials.provider" not in object_store_settings({"key": "a", "secret": "b"})
    monkeypatch.setenv("AWS_ACCESS_KEY_ID", "a")
    assert object_store_settings({}) == {}
    for bad, error in (({"where": 1}, TypeError), ({"endpoint": "localhost"}, ValueError)):
        with pytest.raises(error):
            object_store_settings(bad)
