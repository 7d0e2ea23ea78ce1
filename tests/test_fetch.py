import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from gridloom import cli
from gridloom.operators import workers
from gridloom.operators.predict import BilinearPredictor
from gridloom.sources import geotiff, stac


@pytest.fixture
def service(tmp_path):
    """A search service with two pages of items, and their files by ranges of bytes."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            base = f"http://127.0.0.1:{server.server_port}"
            item = lambda k: {"id": k, "assets": {"dtm": {"href": f"{base}/{k}.tif"}}}
            if body["collections"] == ["empty"]:
                page = {"features": []}
            elif "page" in body:
                page = {"features": [item("b"), {"id": "other", "assets": {"dsm": {"href": "x"}}}]}
            else:
                page = {"features": [item("a")], "links": [{"rel": "next", "href": f"{base}/search", "method": "POST", "body": {"page": 2}, "merge": True}]}
            self._send(200, json.dumps(page).encode())

        def do_GET(self):
            data = (tmp_path / self.path.strip("/")).read_bytes()
            first, last = self.headers["Range"].removeprefix("bytes=").split("-")
            self._send(206, data[int(first) : int(last) + 1])

        def _send(self, status, data):
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


PLACE = {"c": 500000.0, "f": 5000000.0, "crs": "EPSG:32633"}


def rasters(folder):
    (folder / "low.tif").write_bytes(geotiff.encode(np.full((16, 16), 1.0), 4.0, -4.0, **PLACE, nodata=-9999.0))
    # "a" covers everything, "b" the right half, with a gap
    (folder / "a.tif").write_bytes(geotiff.encode(np.full((80, 80), 100.0), 2.0, -2.0, 499980.0, 5000020.0, -9999.0, crs=PLACE["crs"], rows=8))
    b = np.full((32, 16), 200.0)
    b[4, 4] = -1.0
    (folder / "b.tif").write_bytes(geotiff.encode(b, 2.0, -2.0, 500032.0, 5000000.0, -1.0, crs=PLACE["crs"], rows=8))


def test_search_and_mosaic(spark, tmp_path, service):
    url, asked = service
    rasters(tmp_path)
    got = stac.fetch(" HRDEM ", spark, str(tmp_path / "low.tif"), None, str(tmp_path / "made"), url=url)
    assert got.items == ["a", "b"] and len(asked) == 2 and asked[1]["page"] == 2
    lon0, lat0, lon1, lat1 = asked[0]["bbox"]
    assert abs(lon0 - 15.0) < 1e-6 and 45 < lat0 < lat1 < 45.5 and lon0 < lon1
    data = open(got.path, "rb").read()
    values, head = geotiff.decode(data)[0], geotiff.header(data)
    want = np.full((32, 32), 100.0)
    want[:, 16:] = 200.0
    want[4, 20] = 100.0
    assert np.array_equal(values, want) and head["crs"] == PLACE["crs"] and (head["a"], head["c"], head["f"]) == (2.0, PLACE["c"], PLACE["f"])
    again = stac.fetch("hrdem", spark, str(tmp_path / "low.tif"), str(tmp_path / "copy.tif"), "", url=url)
    assert again.items == [] and len(asked) == 2 and open(again.path, "rb").read() == data
    with pytest.raises(LookupError, match="no items"):
        stac.search(url, "empty", (0, 0, 1, 1), "dtm")
    with pytest.raises(LookupError, match="asset"):
        stac.search(url, "some", (0, 0, 1, 1), "none")
    with pytest.raises(KeyError):
        stac.fetch("elsewhere")


def test_other_system(spark, tmp_path):
    """Elevations in degrees on a grid in metres."""
    rasters(tmp_path)
    (tmp_path / "d.tif").write_bytes(geotiff.encode(np.full((200, 300), 7.0), 1e-5, -1e-5, 14.9995, 45.153, -1.0, crs="EPSG:4326"))
    out = stac.mosaic(spark, str(tmp_path / "low.tif"), [str(tmp_path / "d.tif")], str(tmp_path / "m.tif"))
    head = geotiff.header(open(out, "rb").read())
    values = geotiff.decode(open(out, "rb").read())[0]
    assert head["crs"] == PLACE["crs"] and 0.5 < head["a"] < 1.5 and abs(head["c"] + head["a"] * head["width"] - 500064.0) < 1e-6
    assert set(np.unique(values)) <= {7.0, -9999.0} and (values == 7.0).any()
    (tmp_path / "far.tif").write_bytes(geotiff.encode(np.ones((4, 4)), crs=PLACE["crs"]))
    with pytest.raises(LookupError, match="valid"):
        stac.mosaic(spark, str(tmp_path / "low.tif"), [str(tmp_path / "far.tif")], str(tmp_path / "m.tif"))


def test_command_line_fetches(spark, tmp_path, service):
    url, _ = service
    rasters(tmp_path)
    stac._MADE.clear()
    rough = np.random.default_rng(6).random((80, 80)) * 50
    (tmp_path / "a.tif").write_bytes(geotiff.encode(rough, 2.0, -2.0, 499980.0, 5000020.0, crs=PLACE["crs"]))
    (tmp_path / "b.tif").write_bytes(geotiff.encode(rough[:32, :16], 2.0, -2.0, 500032.0, 5000000.0, crs=PLACE["crs"]))
    low, out, ground = str(tmp_path / "low.tif"), tmp_path / "out.tif", tmp_path / "ground.tif"
    options = ["--tile-size", "8", "--tile-overlap", "2"]
    assert cli.main(["tohr", "--in", low, "--fetch-hrdem", "--fetch-out", str(ground), "--stac-url", url, "--out", str(out), *options]) == 0
    data = out.read_bytes()
    assert ground.exists() and np.allclose(geotiff.decode(data)[0], 1.0, atol=1e-5) and geotiff.header(data)["crs"] == PLACE["crs"]
    assert cli.main(["tohr", "--in", low, "--dem", str(ground), "--fetch-out", "x.tif"]) == 1
    for both in (["--dem", str(ground), "--fetch-hrdem"], []):
        with pytest.raises(SystemExit):
            cli.main(["tohr", "--in", low, *both])
    assert cli.main(["tohr", "--in", low, "--dem", str(ground), "--out", f"{tmp_path}/tiles/", *options]) == 0
    assert [p.name for p in (tmp_path / "tiles").glob("*.tif")] == ["tile_0_0.tif"]
    (tmp_path / "moved.tif").write_bytes(geotiff.encode(rough[:32, :32], 2.0, -2.0, PLACE["c"], PLACE["f"], crs="EPSG:32632"))
    assert cli.main(["tohr", "--in", low, "--dem", str(tmp_path / "moved.tif"), "--out", str(out)]) == 1


def test_workers(tmp_path, monkeypatch):
    model = tmp_path / "m.onnx"
    model.write_bytes(b"w")
    (tmp_path / "any_name.py").write_text("from gridloom.operators.predict import BilinearPredictor\nfrom gridloom.operators.workers import worker\n\n@worker('a.1')\ndef make(path, scale):\n    return BilinearPredictor(2 * scale)\n")
    found = workers.known([tmp_path, tmp_path / "none"])
    assert "a.1" in found and "b" not in found
    with workers.predictor(model, 4, "a.1", found) as p:
        assert isinstance(p, BilinearPredictor) and p.scale == 8
    with pytest.raises(FileNotFoundError), workers.predictor(tmp_path / "none.onnx", 4, "a.1", found):
        pass
    with pytest.raises(ValueError), workers.predictor(model, 4):  # no network
        pass
    for bad in ("", " "):
        with pytest.raises(ValueError):
            workers.worker(bad)
    with pytest.raises(TypeError):
        workers.worker("c")(None)
    monkeypatch.setattr(workers, "_made", {})
    monkeypatch.setenv("GRIDLOOM_WORKERS", str(tmp_path))
    assert set(workers.known()) == {"a.1"}
    closed = []
    shut = type("Shut", (), {"scale": 1, "close": lambda self: closed.append(1)})()
    with workers.predictor(model, 1, "v", {"v": lambda path, scale: shut}) as p:
        assert p is shut and not closed
    assert closed == [1]
