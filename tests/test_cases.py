import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from gridloom import cli
from gridloom.plans import cases
from gridloom.sources import geotiff, registry

CRS = "EPSG:32633"


def case(folder, name, shift=0.0, **more):
    home = folder / name
    home.mkdir(parents=True)
    g = np.random.default_rng(4)
    low, dem = np.full((16, 16), 2.0), 100 + g.random((32, 32)) * 9
    for file, values, size in (("low.tif", low, 4.0), ("dem.tif", dem, 2.0), ("true.tif", np.full((32, 32), 2.0 + shift), 2.0)):
        (home / file).write_bytes(geotiff.encode(values, size, -size, 0.0, 100.0, crs=CRS))
    spec = {"inputs": {"lowres_fp": "low.tif", "dem_fp": "dem.tif", "truth_fp": "true.tif"}, "expected": {"usual": {"params": {"model_version": "x", "max_depth": 4}, "metrics": {"precision": 3, "mase_m": 0.5, "rmse_m": 0.5}}, "hard": {"params": {"window_method": "hard"}, "metrics": {}}}, "flags": {"in_hrdem": False}, **more}
    (home / cases.SPEC).write_text(json.dumps(spec))
    return home


def test_catalogue_and_runs(spark, tmp_path, capsys):
    case(tmp_path, "a", 0.5)
    case(tmp_path, "b", 0.25)
    rows = {(r.case, r.run): r for r in cases.catalogue(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a", "usual"), ("a", "hard"), ("b", "usual"), ("b", "hard")}
    assert rows["a", "usual"].metrics == {"precision": 3.0, "mase_m": 0.5, "rmse_m": 0.5} and rows["a", "usual"].params == {"model_version": "x", "max_depth": "4"} and rows["b", "hard"].lowres.endswith("/b/low.tif")
    got = {(o.case, o.run): o for o in cases.run_all(spark, str(tmp_path), tile=8)}
    assert got["a", "usual"].agrees is True and got["b", "usual"].agrees is False and got["a", "hard"].agrees is None
    assert got["b", "hard"].metrics["mae_m"] == pytest.approx(0.25, abs=1e-5)
    assert cli.main(["cases", str(tmp_path), "--tile-size", "8"]) == 0 and "a\tusual\tas expected" in capsys.readouterr().out


def test_bad_cases(spark, tmp_path):
    home = case(tmp_path, "a")
    (home / "true.tif").write_bytes(geotiff.encode(np.ones((31, 32)), 2.0, -2.0, 0.0, 100.0, crs=CRS))
    with pytest.raises(ValueError, match="true depths"):
        cases.run_all(spark, str(tmp_path), tile=8)
    case(tmp_path, "b", inputs={"lowres_fp": "x"})
    with pytest.raises(Exception, match="lacks"):
        cases.catalogue(spark, str(tmp_path)).collect()
    assert cases.agrees({"a": 1.0}, {"b": 1.0}) is False and cases.agrees({"a": 1.04}, {"precision": 1, "a": 1.0}) is True


@pytest.fixture
def forge(monkeypatch):
    """A service of releases whose files are found by number only, with a token."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            allowed = self.headers.get("Authorization") == "Bearer secret"
            seen.append((self.path, allowed))
            base = f"http://127.0.0.1:{server.server_port}"
            if self.path == "/open.onnx":
                return self._send(200, b"open")
            if self.path == "/me/it/releases/download/v1/named.onnx" and allowed:
                return self._send(200, b"named")
            if self.path == "/api/repos/me/it/releases/tags/v1" and allowed:
                return self._send(200, json.dumps({"assets": [{"name": "m.onnx", "url": f"{base}/api/7"}]}).encode())
            if self.path == "/api/7" and allowed and self.headers.get("Accept") == "application/octet-stream":
                return self._send(200, b"numbered")
            return self._send(403 if self.path == "/closed" else 404, b"")

        def _send(self, status, data):
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(registry, "RELEASES", {f"127.0.0.1:{server.server_port}": f"http://127.0.0.1:{server.server_port}/api"})
    for k in registry.TOKENS:
        monkeypatch.delenv(k, raising=False)
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_downloads_step_by_step(forge, tmp_path, monkeypatch):
    base, seen = forge
    to, release = tmp_path / "m", f"{base}/me/it/releases/download/v1/"
    registry._from_http(f"{base}/open.onnx", to)
    assert to.read_bytes() == b"open" and seen == [("/open.onnx", False)]
    with pytest.raises(ConnectionError, match="token"):
        registry._from_http(f"{release}m.onnx", to)
    monkeypatch.setenv(registry.TOKENS[0], "secret")
    registry._from_http(f"{release}named.onnx", to)
    assert to.read_bytes() == b"named"
    registry._from_http(f"{release}m.onnx", to)
    assert to.read_bytes() == b"numbered"
    with pytest.raises(FileNotFoundError, match="other.onnx"):
        registry._from_http(f"{release}other.onnx", to)
    seen.clear()
    with pytest.raises(ConnectionError, match="403"):
        registry._from_http(f"{base}/closed", to)
    assert seen == [("/closed", False), ("/closed", True)]


def test_manifest_by_default(tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("GRIDLOOM_MANIFEST", raising=False)
    assert cli.main(["models", "list"]) == 1
    (tmp_path / "m.json").write_text(json.dumps({"models": {"v": {"file_name": "f", "url": "u", "sha256": "0"}}}))
    monkeypatch.setenv("GRIDLOOM_MANIFEST", str(tmp_path / "m.json"))
    assert cli.main(["models", "list"]) == 0 and capsys.readouterr().out == "v\tf\tu\n"
    assert cli.main(["doctor"]) == 0 and "provider\tCPUExecutionProvider" in capsys.readouterr().out
