"""The codec: round trips, interlace, filters, animations, damage."""

import struct
import zlib

import numpy as np
import pytest

from chromaflow.sources import png


def build(w, h, depth, colour, lines, lace=0, extra=b""):
    raw = b"".join(lines)
    return png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, lace)) + extra + png.chunk(b"IDAT", zlib.compress(raw)) + png.chunk(b"IEND", b"")


def test_packing():
    assert png.packed(np.array([[0, 1, 2, 3], [3, 2, 1, 0]]), 2) == bytes([0, 0b00011011, 0, 0b11100100])
    assert png.packed(np.array([[0, 1, 1], [0, 1, 0]]), 1) == bytes([0, 0b01100000, 0, 0b01000000])
    with pytest.raises(ValueError):
        png.packed(np.array([[2]]), 1)


@pytest.mark.parametrize("colours", [2, 3, 16, 200])
def test_indexed_round_trip(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4))
    idx = rng.integers(0, colours, (13, 9))
    for speed in (4, 10):
        got = png.decode(png.encode_indexed(idx, palette, speed, [(b"gAMA", struct.pack(">I", 45455)), (b"tEXt", b"a\0b")]))
        assert got.is_indexed and (got.still == palette[idx]).all() and {k for k, _ in got.metadata} == {b"gAMA", b"tEXt"}


def test_all_filters():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 6, 4)).astype(np.uint8)
    flat, lines = want.reshape(5, 24).astype(int), []
    for y in range(5):
        row, up = flat[y], flat[y - 1] if y else np.zeros(24, int)
        left, corner = np.append(np.zeros(4, int), row[:-4]), np.append(np.zeros(4, int), up[:-4])
        p = left + up - corner
        near = [min((abs(v - a), 0, a), (abs(v - b), 1, b), (abs(v - c), 2, c))[2] for v, a, b, c in zip(p, left, up, corner)]
        guess = [np.zeros(24, int), left, up, (left + up) // 2, np.array(near)][y]
        lines.append(bytes([y]) + bytes(((row - guess) % 256).tolist()))
    assert (png.decode(build(6, 5, 8, 6, lines)).still == want).all()


def test_grey_and_interlace():
    grey = png.decode(build(4, 1, 2, 0, [bytes([0, 0b00011011])], extra=png.chunk(b"tRNS", struct.pack(">H", 1))))
    assert grey.still[0, :, 0].tolist() == [0, 85, 170, 255] and grey.still[0, :, 3].tolist() == [255, 0, 255, 255]
    want = np.arange(25).reshape(5, 5)
    lines = []
    for x0, y0, dx, dy in png._PASSES:
        part = want[y0::dy, x0::dx]
        if part.size:
            lines += [bytes([0, *row]) for row in part.tolist()]
    assert (png.decode(build(5, 5, 8, 0, lines, lace=1)).still[..., 0] == want).all()


def test_animation_round_trip():
    red, part = np.full((2, 2, 4), 255, np.uint8), np.full((1, 1, 4), 7, np.uint8)
    own = png.Png(2, 2, None, [png.Frame(red, delay_num=1, delay_den=10), png.Frame(part, 1, 1, 2, 10, "previous", "over")], plays=3)
    got = png.decode(png.encode_animation(own))
    assert got.plays == 3 and got.has_subrect_frames and not got.is_indexed
    assert [(f.x_off, f.delay_num, f.dispose, f.blend) for f in got.frames] == [(0, 1, "none", "source"), (1, 2, "previous", "over")]
    assert (got.frames[0].rgba == red).all() and (got.frames[1].rgba == part).all()
    default = png.decode(png.encode_animation(png.Png(2, 2, red, own.frames)))
    assert default.still is not None and len(default.frames) == 2


@pytest.mark.parametrize("data", [b"", b"not a png", png.encode_rgba(np.zeros((3, 3, 4), int))[:-20], png.encode_rgba(np.zeros((3, 3, 4), int)).replace(b"IDAT", b"IDAX")])
def test_damage_is_an_error(data):
    with pytest.raises(png.PngError):
        png.decode(data)


def test_files(spark, tmp_path):
    good = png.encode_indexed(np.array([[0, 1], [1, 0]]), np.array([[1, 2, 3, 4], [5, 6, 7, 8]]))
    images = spark.createDataFrame([("a.png", good), ("sub.PNG", b"broken")], "name string, content binary")
    assert [r.status for r in png.write_images(images, "name", str(tmp_path)).collect()] == ["ok", "ok"]
    assert {r.status for r in png.write_images(images, "name", str(tmp_path)).collect()} == {"argument"}
    (tmp_path / "other.txt").write_text("x")
    files = png.read_files(spark, str(tmp_path))
    info = {r.path.rsplit("/", 1)[1]: r for r in png.image_info(files).collect()}
    assert info["a.png"].status == "ok" and info["a.png"].is_indexed and info["sub.PNG"].status == "decode"
    px = sorted((r.y, r.x, r.r, r.a) for r in png.image_pixels(files).collect())
    assert px == [(0, 0, 1, 4), (0, 1, 5, 8), (1, 0, 5, 8), (1, 1, 1, 4)]
