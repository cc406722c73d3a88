"""A folder of stills, animations and damaged files, processed at once."""

import struct
import zlib

import numpy as np

from chromaflow.plans import files, quantize
from chromaflow.sources import png


def test_process_files(spark):
    rng = np.random.default_rng(2)
    red, dot = np.tile([255, 0, 0, 255], (4, 4, 1)), np.tile([0, 0, 255, 255], (1, 2, 1))
    still = rng.integers(0, 256, (6, 5, 4))
    own = png.Png(4, 4, None, [png.Frame(red, delay_num=1, delay_den=10), png.Frame(dot, 1, 2, 1, 10)])
    indexed = png.Png(4, 4, None, [png.Frame(np.zeros((4, 4), int)), png.Frame(np.ones((1, 2), int), 1, 2)])
    palette = np.array([[255, 0, 0, 255], [0, 0, 255, 255]])
    content = {"s.png": png.encode_rgba(still), "a.png": png.encode_animation(own), "i.png": png.encode_animation(indexed, palette), "x.png": b"nothing"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")
    got = {r["path"]: r for r in files.process_files(rows, quantize.Options(speed=10, max_colours=8, dither=0.0)).collect()}
    assert set(got) == set(content)
    assert got["x.png"]["status"] == "decode" and got["x.png"]["content"] is None and got["x.png"]["exit_code"] == 4
    assert bytes(got["i.png"]["content"]) == content["i.png"] and got["i.png"]["score"] == 100
    assert png.decode(bytes(got["s.png"]["content"])).still.shape == (6, 5, 4) and got["s.png"]["colours"] <= 8
    back = png.decode(bytes(got["a.png"]["content"]))
    assert got["a.png"]["frames"] == 2 and np.abs(back.frames[1].rgba.astype(int) - dot).max() <= 4


def test_files_keep_metadata_and_plays(spark):
    """Profiles, resolutions, texts and play counts come out; colours that were converted are stated as sRGB."""
    rng = np.random.default_rng(3)
    kinds = {b"pHYs": struct.pack(">IIB", 2835, 2835, 1), b"tEXt": b"Title\0one", b"iCCP": b"own\0\0" + zlib.compress(b"profile")}
    stated = {b"gAMA": struct.pack(">I", 50000), b"cHRM": struct.pack(">8I", 31270, 32900, 64000, 33000, 21000, 71000, 15000, 6000), b"tEXt": b"Title\0two"}
    idx, palette = rng.integers(0, 4, (5, 6)), np.array([[255, 0, 0, 255], [0, 99, 0, 255], [0, 0, 255, 255], [9, 9, 9, 255]])
    red, blue = (np.tile(c, (4, 4, 1)) for c in ([255, 0, 0, 255], [0, 0, 255, 255]))
    once = png.Png(4, 4, None, [png.Frame(red, delay_num=1), png.Frame(blue, delay_num=1)], 3, list(kinds.items()))
    content = {"p.png": png.encode_indexed(idx, palette, 4, list(kinds.items())), "g.png": png.encode_indexed(idx, palette, 4, list(stated.items())), "a.png": png.encode_animation(once)}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")
    got = {r["path"]: png.decode(bytes(r["content"])) for r in files.process_files(rows, quantize.Options(speed=10, max_colours=8, dither=0.0)).collect()}
    assert dict(got["p.png"].metadata) == kinds
    assert dict(got["g.png"].metadata) == {b"sRGB": b"\0", b"tEXt": b"Title\0two"}
    assert got["a.png"].plays == 3 and dict(got["a.png"].metadata) == kinds


def test_size_gate_compares_with_the_file(spark):
    """An indexed file that cannot shrink is refused; the same pixels as RGBA shrink and pass."""
    idx = np.add.outer(np.arange(64), np.arange(64)) // 8 % 4
    palette = np.array([[255, 0, 0, 255], [0, 99, 0, 255], [0, 0, 255, 255], [9, 9, 9, 255]])
    noise = np.random.default_rng(4).integers(0, 4, (64, 64))
    content = {"i.png": png.encode_indexed(idx, palette), "r.png": png.encode_rgba(palette[noise])}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")
    got = {r["path"]: r for r in files.process_files(rows, quantize.Options(speed=10, max_colours=8, dither=0.0, skip_if_larger=True)).collect()}
    assert got["i.png"]["status"] == "output_too_large" and got["i.png"]["exit_code"] == 99
    assert got["r.png"]["status"] == "ok" and got["r.png"]["size_bytes"] < len(content["r.png"])
