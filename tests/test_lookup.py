"""Lookup of stored reconstructions, and PNG files."""

import struct
import zlib

import numpy as np
import pytest

from gapweave.functions import png
from gapweave.sources import lookup, npy


def filtered(a, kind):
    """An image whose lines use one filter, made from the format's definition."""
    h, w, c = a.shape
    x, raw = a.astype(int), b""
    for y in range(h):
        raw += bytes([kind])
        for i in range(w):
            for k in range(c):
                left, up, corner = x[y, i - 1, k] if i else 0, x[y - 1, i, k] if y else 0, x[y - 1, i - 1, k] if y and i else 0
                p = left + up - corner
                nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                raw += bytes([(x[y, i, k] - (0, left, up, (left + up) // 2, nearest)[kind]) % 256])
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    z = zlib.compress(raw)
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", z[:9]) + chunk(b"IDAT", z[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    a = np.random.default_rng(kind).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (png.decode(filtered(a, kind)) == a).all() and (png.decode(png.encode(a)) == a).all()


def test_png_refuses_other_files():
    good = png.encode(np.zeros((2, 2), np.uint8))
    for bad in (b"", b"no png at all", good[:20] + b"x" + good[21:]):
        with pytest.raises(ValueError):
            png.decode(bad)
    assert png.decode(good).shape == (2, 2, 1)


def test_arrays_come_before_images_and_misses_stay(spark, tmp_path):
    def put(root, folder, ids, value, suffix):
        rows = [(i, None, folder, [1, 2, 3], [value] * 6) for i in ids]
        npy.write(spark.createDataFrame(rows, "patch_id long, variant string, folder string, shape array<int>, values array<double>"), str(tmp_path / root), suffix=suffix)

    put("reconstruction_arrays", "inf/idw", [1, 2], 0.5, ".npy")
    put("reconstruction_arrays", "40/idw", [3], 0.25, ".npy")
    put("reconstruction_images", "idw", [2, 3, 4], 1.0, ".png")
    (tmp_path / "reconstruction_images/idw/0000005.png").write_bytes(b"broken")
    (tmp_path / "reconstruction_images/idw/0000001.png").write_bytes(b"must not be opened")
    wanted = spark.createDataFrame([("inf", "idw", i) for i in range(1, 7)] + [("40", "idw", 3), ("40", "dct", 3)], "noise_level string, method string, patch_id long")
    got = {(r["noise_level"], r["method"], r["patch_id"]): (r["source"], r["values"] and r["values"][0], r["error"]) for r in lookup.reconstructions(wanted, str(tmp_path)).collect()}
    none = (None, None, None)
    assert {k: v for k, v in got.items() if k[2] != 5} == {("inf", "idw", 1): ("array", 0.5, None), ("inf", "idw", 2): ("array", 0.5, None), ("inf", "idw", 3): ("image", 1.0, None), ("inf", "idw", 4): ("image", 1.0, None), ("inf", "idw", 6): none, ("40", "idw", 3): ("array", 0.25, None), ("40", "dct", 3): none}
    assert got["inf", "idw", 5][0] == "image" and "no PNG" in got["inf", "idw", 5][2]
    assert all(r["source"] is None for r in lookup.reconstructions(wanted, str(tmp_path / "nowhere")).collect())
