import numpy as np
import pytest

from gridloom import cli
from gridloom.sources import ascii, geotiff


def test_round_trip(spark, tmp_path):
    g = np.random.default_rng(3)
    values = g.normal(size=(40, 7)) * 10.0 ** g.integers(-12, 12, (40, 7))
    rows = [(r, c, None if (r, c) == (5, 5) else float(values[r, c]), "x") for r in range(40) for c in range(7) if not 10 <= r < 30]
    df = spark.createDataFrame(rows, "r long, c long, v double, value string")
    path = str(tmp_path / "out" / "x.asc")
    for cells in (1 << 18, 14):
        ascii.STRIP_CELLS = cells
        ascii.write_raster(df, "v", path, 40, 7, -9999.0, 2.5, -2.5, 100.0, 900.0)
        got = {(r.r, r.c): r.value for r in ascii.read_cells(spark, path).collect()}
        assert got == {(r, c): None if (r, c) == (5, 5) or 10 <= r < 30 else values[r, c] for r in range(40) for c in range(7)}
    ascii.STRIP_CELLS = 1 << 18
    head = ascii.headers(spark, path).first()
    assert (head.height, head.width, head.a, head.e, head.c, head.f, head.nodata, head.crs) == (40, 7, 2.5, -2.5, 100.0, 900.0, -9999.0, None)
    with pytest.raises(ValueError, match="square"):
        ascii.write_raster(df, "v", path, 40, 7, a=1.0, e=-2.0)


def test_lines_over_many_splits(spark, tmp_path):
    """Splits of a few hundred bytes, lines cut anywhere, several files, centres instead of corners."""
    values = np.arange(60 * 11, dtype=float).reshape(60, 11)
    flat = [repr(v) for v in values.ravel().tolist()]
    body = "\n".join("  ".join(flat[k : k + 5]) for k in range(0, len(flat), 5))
    for name in ("a.asc", "b.asc"):
        (tmp_path / name).write_text(f"NCOLS 11\nNROWS 60\nXLLCENTER 5\nYLLCENTER 15\nCELLSIZE 10\nNODATA_VALUE 7\n{body}\n\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("300", "10"), strict=True):
        spark.conf.set(k, v)
    try:
        df = ascii.read_cells(spark, str(tmp_path / "*.asc"))
        assert spark.read.text(str(tmp_path / "a.asc")).rdd.getNumPartitions() > 5
        got = {(r.raster_id[-5:], r.r, r.c): r.value for r in df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(n, r, c): None if values[r, c] == 7 else values[r, c] for n in ("a.asc", "b.asc") for r in range(60) for c in range(11)}
    head = ascii.headers(spark, str(tmp_path / "a.asc")).first()
    assert (head.c, head.f) == (0.0, 610.0)


def test_wrong_numbers(spark, tmp_path):
    for text in ("ncols 2\nnrows 2\ncellsize 1\n1 2 3\n", "ncols 2\nnrows 2\n1 2 3 4 5\n", "ncols 2\n1 2\n"):
        (tmp_path / "x.asc").write_text(text)
        with pytest.raises(Exception, match="numbers"):
            ascii.read_cells(spark, str(tmp_path / "x.asc")).collect()


def test_command_line_by_extension(spark, tmp_path):
    low, high = np.full((8, 8), 1.0), np.tile(np.linspace(500, 1000, 16), (16, 1))
    (tmp_path / "low.asc").write_text("ncols 8\nnrows 8\nxllcorner 0\nyllcorner -16\ncellsize 2\n" + "\n".join(" ".join(map(str, r)) for r in low) + "\n")
    (tmp_path / "dem.tif").write_bytes(geotiff.encode(high, 1.0, -1.0, crs="EPSG:32633"))
    out = tmp_path / "out.asc"
    assert cli.main(["tohr", "--in", str(tmp_path / "low.asc"), "--dem", str(tmp_path / "dem.tif"), "--out", str(out), "--tile-size", "8", "--tile-overlap", "2"]) == 0
    assert out.read_text().startswith("ncols 16\nnrows 16\n")
    got = ascii.read_cells(spark, str(out)).collect()
    assert len(got) == 256 and all(abs(r.value - 1) < 1e-5 for r in got)
