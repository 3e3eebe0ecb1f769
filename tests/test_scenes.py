"""Raster files of every layout against the arrays they were made from."""

import struct

import numpy as np
import pytest

from brinelog.plans.scenes import LAYOUTS, lzw, packed, picture
from brinelog.sources import codecs, rasters, scenes


def pixels_of(rows):
    return {(r.path.rsplit("/", 1)[1], r.band, r.y, r.x): r.value for r in rows}


def made():
    rng = np.random.default_rng(3)
    shapes = {"a": (8, 8, 2), "b": (37, 21, 1), "c": (5, 40, 3), "d": (70, 50, 4)}
    return {f"{n}.{layout}": (rng.integers(0, 4 if n == "d" else 1 << (16 if n in "bc" else 8), shape).astype("u2" if n in "bc" else "u1"), layout) for n, shape in shapes.items() for layout in LAYOUTS}


def test_every_layout(spark, tmp_path):
    pictures = made()
    for name, (pixels, layout) in pictures.items():
        (tmp_path / name).write_bytes(picture(pixels, layout, 10.0, 20.0))
    (tmp_path / "_hidden").write_bytes(b"x")
    for name, content in {"text.tif": b"hello", "none.tif": b"", "half.tif": picture(pictures["d.strips"][0], "strips")[:3000], "odd.png": codecs.PNG + b"\0" * 30}.items():
        (tmp_path / name).write_bytes(content)
    heads = {r.path.rsplit("/", 1)[1]: r for r in scenes.scenes(spark, str(tmp_path), "heads").collect()}
    assert heads.keys() == pictures.keys() | {"text.tif", "none.tif", "half.tif", "odd.png"}
    assert all((heads[n].error is None) == (n in pictures) for n in heads)
    found = pixels_of(scenes.scenes(spark, str(tmp_path)).collect())
    assert found == {(n, b, y, x): v for n, (p, _) in pictures.items() for (y, x, b), v in np.ndenumerate(p)}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert pixels_of(rasters.tiff_pixels(files).collect()) == found
    assert all((heads[n].width, heads[n].height, heads[n].bands, heads[n].kind) == (p.shape[1], p.shape[0], p.shape[2], p.dtype.name) for n, (p, _) in pictures.items())
    assert {heads[n].min_lon for n, (_, layout) in pictures.items() if layout != "png"} == {10.0}


def test_a_planar_picture_keeps_its_bands():
    content = picture(np.arange(8, dtype="u1").reshape(2, 2, 2), "planar")
    read = lambda o, n: content[o : o + n]
    blocks = list(scenes.blocks_of("p", codecs.layout_of(read, len(content)), read, len(content)))
    assert [b["value"].tolist() for b in blocks] == [[0, 2, 4, 6], [1, 3, 5, 7]]


def test_large_files_are_read_by_strips(tmp_path, monkeypatch):
    monkeypatch.setattr(scenes, "LARGE", 1000)
    monkeypatch.setattr(scenes, "TASK_BYTES", 4000)
    pixels = np.random.default_rng(1).integers(0, 99, (70, 50, 2)).astype("u1")
    for layout in LAYOUTS:
        (tmp_path / layout).mkdir()
        (tmp_path / layout / "big.tif").write_bytes(picture(pixels, layout))
        reader = scenes.ScenesReader(str(tmp_path / layout), False)
        parts = reader.partitions()
        assert len(parts) > 5 or layout in ("png", "tiles") and isinstance(parts[0], scenes.Part)
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert {(r["band"], r["y"], r["x"]): r["value"] for r in rows} == {(b, y, x): v for (y, x, b), v in np.ndenumerate(pixels)} and len(rows) == pixels.size
        assert len(scenes.ScenesReader(str(tmp_path / layout), True).partitions()) == 1


def test_a_strip_that_breaks_off_is_a_null(spark, tmp_path):
    content = bytearray(picture(np.full((9, 9, 1), 7, "u1"), "deflate"))
    at = content.index(b"x\x9c", 17 + 4)
    content[at : at + 6] = b"\xff" * 6
    (tmp_path / "a.tif").write_bytes(bytes(content))
    rows = scenes.scenes(spark, str(tmp_path)).collect()
    assert sorted((r.y, r.x) for r in rows if r.value is None) == [(3, 0)] and sum(r.value == 7 for r in rows) == 54


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 5000, bytes(range(256)) * 40, np.random.default_rng(4).integers(0, 256, 30000).astype("u1").tobytes()])
def test_packing_round_trips(data):
    assert codecs.unpackbits(packed(data), len(data)) == data
    if data:
        assert codecs.unlzw(lzw(data), len(data)) == data


def test_headers_with_absurd_numbers_are_refused():
    for content in (b"II" + struct.pack("<HI", 42, 4), b"II" + struct.pack("<HIH", 42, 8, 65535), b"MM\0\x2b\0\x08\0\0" + b"\xff" * 8, codecs.PNG):
        assert scenes.head_row("p", rasters.reader_of(content), len(content))[-1].startswith("unreadable")


def test_pictures_of_sparks_own_source(spark, tmp_path):
    pixels = np.random.default_rng(5).integers(0, 256, (4, 6, 3)).astype("u1")
    (tmp_path / "a.png").write_bytes(picture(pixels, "png"))
    found = pixels_of(rasters.image_pixels(spark.read.format("image").load(str(tmp_path))).collect())
    assert found == {("a.png", b, y, x): v for (y, x, b), v in np.ndenumerate(pixels)}
