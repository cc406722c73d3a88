"""PNG and APNG as Spark sources and sinks, on zlib and numpy.

Reading: ``binaryFile`` rows become images (one row each), animation frames or pixels.
Writing: grouped functions turn pixels and a palette into bytes. A file that cannot be
decoded is a row with a status, never a failed job.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Start and step (x0, y0, dx, dy) of the seven interlaced passes.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
DISPOSE, BLEND = ("none", "background", "previous"), ("source", "over")
_KEPT = (b"gAMA", b"cHRM", b"sRGB", b"pHYs", b"iCCP", b"eXIf", b"tEXt", b"zTXt", b"iTXt")


class PngError(ValueError):
    """Bytes that are no PNG that can be read."""


@dataclass
class Frame:
    """An animation frame: straight RGBA (h, w, 4) and its control data."""

    rgba: np.ndarray
    x_off: int = 0
    y_off: int = 0
    delay_num: int = 0
    delay_den: int = 100
    dispose: str = "none"
    blend: str = "source"


@dataclass
class Png:
    """A decoded file: the still image (None where only frames exist), frames, kept metadata, and how it was stored."""

    width: int
    height: int
    still: np.ndarray | None
    frames: list[Frame] = field(default_factory=list)
    plays: int = 0
    metadata: list[tuple[bytes, bytes]] = field(default_factory=list)
    is_indexed: bool = False
    has_subrect_frames: bool = False


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of each chunk; a broken check sum or cut end is an error."""
    if data[:8] != SIGNATURE:
        raise PngError("no signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise PngError("cut chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise PngError("bad chunk")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < rows * (stride + 1):
        raise PngError("too little pixel data")
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for k in range(step):
                out[y + 1, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            got, src, above = bytearray(stride), line.tolist(), up.tolist()
            for i in range(stride):
                a, b = (got[i - step] if i >= step else 0), above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[i - step] if i >= step else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got[i] = (src[i] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(got), np.uint8)
        else:
            raise PngError("unknown filter")
    return out[1:]


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    rows = len(lines)
    if depth == 16:
        return lines[:, : width * channels * 2].reshape(rows, width, channels, 2)
    if depth == 8:
        return lines[:, : width * channels].reshape(rows, width, channels)
    bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
    weights = 1 << np.arange(depth - 1, -1, -1)
    return (bits * weights).sum(2).astype(np.uint8)[:, :width].reshape(rows, width, channels)


def _pixels(body: bytes, w: int, h: int, depth: int, colour: int, interlaced: bool) -> np.ndarray:
    channels = _CHANNELS[colour]
    try:
        raw = zlib.decompressobj().decompress(body)
    except zlib.error as error:
        raise PngError(str(error)) from error
    step = max(1, channels * depth // 8)
    shape = (h, w, channels, 2) if depth == 16 else (h, w, channels)
    out = np.zeros(shape, np.uint8)
    if not interlaced:
        stride = (w * channels * depth + 7) // 8
        return _samples(_unfilter(raw, h, stride, step), w, depth, channels)
    at = 0
    for x0, y0, dx, dy in _PASSES:
        pw, ph = (w - x0 + dx - 1) // dx, (h - y0 + dy - 1) // dy
        if pw <= 0 or ph <= 0:
            continue
        stride = (pw * channels * depth + 7) // 8
        out[y0::dy, x0::dx] = _samples(_unfilter(raw[at:], ph, stride, step), pw, depth, channels)
        at += ph * (stride + 1)
    return out


def _rgba(body: bytes, w: int, h: int, header: tuple[int, int, bool], plte: bytes, trns: bytes) -> np.ndarray:
    depth, colour, interlaced = header
    s = _pixels(body, w, h, depth, colour, interlaced)
    wide = s.astype(np.int64)
    if depth == 16:
        wide, s = wide[..., 0] * 256 + wide[..., 1], s[..., 0]
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        palette = np.zeros((256, 4), np.uint8)
        n = len(plte) // 3
        palette[:n, :3] = np.frombuffer(plte, np.uint8, n * 3).reshape(n, 3)
        palette[:, 3] = 255
        palette[: len(trns), 3] = np.frombuffer(trns, np.uint8)[:256]
        if n == 0 or int(s.max(initial=0)) >= n:
            raise PngError("index outside the palette")
        return palette[s[..., 0]]
    full = 1 if depth >= 8 else 255 // ((1 << depth) - 1)
    if colour in (0, 4):
        out[..., :3] = (s[..., :1] * full).astype(np.uint8)
    else:
        out[..., :3] = s[..., :3]
    if colour in (4, 6):
        out[..., 3] = s[..., -1]
    elif trns:
        clear = np.frombuffer(trns, ">u2")[: wide.shape[2]]
        out[(wide == clear).all(2), 3] = 0
    return out


def decode(data: bytes) -> Png:
    """A still or animated file as straight 8-bit RGBA; 16-bit samples keep their high byte."""
    header = size = None
    plte = trns = b""
    still, seen_data, seen_control, animated = bytearray(), False, False, False
    frames: list[tuple[tuple, bytearray]] = []
    metadata, plays = [], 0
    for kind, body in chunks(data):
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if not w or not h or colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16):
                raise PngError("bad header")
            header, size = (depth, colour, lace == 1), (w, h)
        elif header is None:
            raise PngError("no header")
        elif kind == b"PLTE":
            plte = body
        elif kind == b"tRNS":
            trns = body
        elif kind == b"acTL":
            animated, plays = True, struct.unpack(">II", body)[1]
        elif kind == b"fcTL":
            frames.append((struct.unpack(">IIIIIHHBB", body), bytearray()))
            seen_control = seen_control or not seen_data
        elif kind == b"IDAT":
            seen_data = True
            (frames[0][1] if animated and seen_control and frames else still).extend(body)
        elif kind == b"fdAT":
            if not frames:
                raise PngError("frame data without control")
            frames[-1][1].extend(body[4:])
        elif kind in _KEPT:
            metadata.append((kind, body))
    if header is None or size is None or not seen_data:
        raise PngError("no image")
    w, h = size
    out = Png(w, h, _rgba(bytes(still), w, h, header, plte, trns) if still else None, [], plays, metadata, header[1] == 3 or bool(plte))
    if animated:
        for (_, fw, fh, x, y, num, den, dispose, blend), body in frames:
            if not fw or not fh or x + fw > w or y + fh > h or dispose > 2 or blend > 1:
                raise PngError("frame outside the canvas")
            out.has_subrect_frames |= (fw, fh) != (w, h)
            out.frames.append(Frame(_rgba(bytes(body), fw, fh, header, plte, trns), x, y, num, den, DISPOSE[dispose], BLEND[blend]))
    return out


def packed(indices: np.ndarray, depth: int) -> bytes:
    """Rows of indices, most significant bits first, each padded to a byte and led by filter 0."""
    h, w = indices.shape
    if indices.size and int(indices.max()) >= 1 << depth:
        raise ValueError("an index needs more bits")
    bits = ((indices[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8).reshape(h, w * depth)
    return np.hstack([np.zeros((h, 1), np.uint8), np.packbits(bits, axis=1)]).tobytes()


def depth_of(colours: int) -> int:
    return next(d for d in (1, 2, 4, 8) if colours <= 1 << d)


def _deflated(raw: bytes, speed: int) -> bytes:
    """The shorter of two memory levels (the first on ties); one quick try at the highest speed."""
    tries = []
    for memory in (8,) if speed >= 10 else (5, 8):
        own = zlib.compressobj(1 if speed >= 10 else 9, zlib.DEFLATED, 15, memory)
        tries.append(own.compress(raw) + own.flush())
    return min(tries, key=len)


def _palette_chunks(palette: np.ndarray) -> bytes:
    out = chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes())
    alpha = palette[:, 3].astype(np.uint8)
    some = np.flatnonzero(alpha < 255)
    return out + (chunk(b"tRNS", alpha[: some[-1] + 1].tobytes()) if len(some) else b"")


def _kept_chunks(metadata: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Metadata that goes before the palette, and texts that follow it."""
    meta = dict(metadata)
    lead = [b"pHYs", b"sRGB"] if b"sRGB" in meta else [b"pHYs", b"gAMA", b"cHRM", b"iCCP"]
    return b"".join(chunk(k, meta[k]) for k in (*lead, b"eXIf") if k in meta), b"".join(chunk(k, body) for k, body in metadata if k in (b"tEXt", b"zTXt", b"iTXt"))


def _metadata_of(rows) -> list[tuple[bytes, bytes]]:
    """(kind, body) of a metadata column's value; none of null."""
    return [(m["kind"].encode("latin-1"), bytes(m["body"])) for m in (rows if rows is not None else [])]


def encode_indexed(indices: np.ndarray, palette: np.ndarray, speed: int = 4, metadata: list[tuple[bytes, bytes]] = ()) -> bytes:
    """An indexed PNG of (h, w) indices and (n, 4) bytes."""
    h, w = indices.shape
    depth = depth_of(len(palette))
    before, after = _kept_chunks(metadata)
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 3, 0, 0, 0)) + before + _palette_chunks(palette) + after
    return out + chunk(b"IDAT", _deflated(packed(indices, depth), speed)) + chunk(b"IEND", b"")


def encode_rgba(rgba: np.ndarray, speed: int = 4) -> bytes:
    h, w, _ = rgba.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), rgba.reshape(h, w * 4).astype(np.uint8)]).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", _deflated(raw, speed)) + chunk(b"IEND", b"")


def encode_animation(png: Png, palette: np.ndarray | None = None, speed: int = 4) -> bytes:
    """An animated PNG: RGBA frames, or frames of (h, w) indices where a palette is given."""
    if not png.frames:
        raise PngError("no frames")
    first = png.frames[0]
    if png.still is None and (first.rgba.shape[:2] != (png.height, png.width) or first.x_off or first.y_off):
        raise PngError("the first frame must fill the canvas")
    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", png.width, png.height, 8, 6 if palette is None else 3, 0, 0, 0))
    before, after = _kept_chunks(png.metadata)
    out += chunk(b"acTL", struct.pack(">II", len(png.frames), png.plays)) + before
    out += (b"" if palette is None else _palette_chunks(palette)) + after

    def body(image: np.ndarray) -> bytes:
        flat = image.reshape(len(image), -1).astype(np.uint8)
        return _deflated(np.hstack([np.zeros((len(flat), 1), np.uint8), flat]).tobytes(), speed)

    if png.still is not None:
        out += chunk(b"IDAT", body(png.still))
    number = 0
    for k, f in enumerate(png.frames):
        h, w = f.rgba.shape[:2]
        control = (number, w, h, f.x_off, f.y_off, f.delay_num, f.delay_den, DISPOSE.index(f.dispose), BLEND.index(f.blend))
        out += chunk(b"fcTL", struct.pack(">IIIIIHHBB", *control))
        number += 1
        if k == 0 and png.still is None:
            out += chunk(b"IDAT", body(f.rgba))
        else:
            out += chunk(b"fdAT", struct.pack(">I", number) + body(f.rgba))
            number += 1
    return out + chunk(b"IEND", b"")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of all .png and .apng files below a folder; a folder that is missing has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string, length long, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.filter(F.lower("path").rlike(r"\.a?png$")).select("path", "length", "content")


INFO = "path string, status string, detail string, width long, height long, frames long, is_indexed boolean, has_subrect_frames boolean, plays long, metadata array<struct<kind:string,body:binary>>"
PIXELS = "path string, frame_no long, y long, x long, r long, g long, b long, a long"
FRAMES = "path string, frame_no long, w long, h long, x_off long, y_off long, delay_num long, delay_den long, dispose string, blend string"


def _each(files: DataFrame, make, schema: str) -> DataFrame:
    """One decoded file after another; content never goes past this step."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                got = make(path, bytes(content or b""))
                if len(got):
                    yield got.astype({c: object for c in got.columns if not pd.api.types.is_numeric_dtype(got[c])})

    return files.select("path", "content").mapInPandas(run, schema)


def image_info(files: DataFrame) -> DataFrame:
    def make(path, content):
        try:
            p = decode(content)
            meta = [{"kind": k.decode("latin-1"), "body": b} for k, b in p.metadata]
            row = (path, "ok", None, p.width, p.height, max(len(p.frames), 1), p.is_indexed, p.has_subrect_frames, p.plays, meta)
        except (PngError, struct.error) as error:
            row = (path, "decode", str(error), None, None, None, None, None, None, [])
        return pd.DataFrame([row], columns=[x.split()[0] for x in INFO.split(", ")])

    return _each(files, make, INFO)


def image_pixels(files: DataFrame) -> DataFrame:
    """Pixels of the still image (frame_no -1) and of each frame; none of files that cannot be decoded."""

    def make(path, content):
        try:
            p = decode(content)
        except (PngError, struct.error):
            return pd.DataFrame({c.split()[0]: [] for c in PIXELS.split(", ")})
        parts = [(-1, p.still)] if p.still is not None else []
        parts += [(k, f.rgba) for k, f in enumerate(p.frames)]
        sizes = [rgba.shape[0] * rgba.shape[1] for _, rgba in parts]
        y, x = (np.concatenate(c) for c in zip(*(np.divmod(np.arange(n), rgba.shape[1]) for n, (_, rgba) in zip(sizes, parts))))
        flat = np.concatenate([rgba.reshape(-1, 4) for _, rgba in parts]).astype(np.int64)
        numbers = np.repeat([k for k, _ in parts], sizes)
        return pd.DataFrame({"path": np.full(len(y), path, object), "frame_no": numbers, "y": y, "x": x, **dict(zip("rgba", flat.T))})

    return _each(files, make, PIXELS)


def animation_frames(files: DataFrame) -> DataFrame:
    def make(path, content):
        try:
            frames = decode(content).frames
        except (PngError, struct.error):
            frames = []
        rows = [(path, k, f.rgba.shape[1], f.rgba.shape[0], f.x_off, f.y_off, f.delay_num, f.delay_den, f.dispose, f.blend) for k, f in enumerate(frames)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FRAMES.split(", ")])

    return _each(files, make, FRAMES)


def encoded_images(indexed: DataFrame, palette: DataFrame, speed: int = 4, files: DataFrame | None = None) -> DataFrame:
    """image_id and content: an indexed PNG of (image_id, y, x, idx) and (image_id, idx, r, g, b, a), with the metadata of ``files`` (image_id, metadata)."""
    pixels, colours = indexed.select("image_id", "y", "x", "idx"), palette.select(*(F.col(c).alias(c) for c in ("image_id", "idx", *"rgba")))
    if files is not None:
        # an image's metadata goes with its first entry alone
        first = colours.groupBy("image_id").agg(F.min("idx").alias("idx"))
        colours = colours.join(first.join(files.select("image_id", "metadata"), "image_id"), ["image_id", "idx"], "left")

    def run(key: tuple, pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"image_id": [], "content": []})
        pdf, entries = pdf.sort_values(["y", "x"]), entries.sort_values("idx")
        place = pd.Series(np.arange(len(entries)), entries["idx"].to_numpy())
        h = int(pdf["y"].nunique())
        indices = place[pdf["idx"].to_numpy()].to_numpy().reshape(h, -1)
        metadata = _metadata_of(entries["metadata"].iloc[0]) if "metadata" in entries else []
        return pd.DataFrame({"image_id": [int(key[0])], "content": [encode_indexed(indices, entries[list("rgba")].to_numpy(np.int64), speed, metadata)]})

    return pixels.groupBy("image_id").cogroup(colours.groupBy("image_id")).applyInPandas(run, "image_id long, content binary")


def encoded_animations(indexed: DataFrame, frames: DataFrame, palette: DataFrame, sizes: DataFrame, speed: int = 4, files: DataFrame | None = None) -> DataFrame:
    """anim and content: an indexed APNG with one palette for all frames.

    ``indexed``: anim, frame_no (-1: a default image that is no frame), y, x, idx; ``frames``
    as :data:`FRAMES` by anim; ``palette``: anim, idx, r, g, b, a; ``sizes``: anim, width, height;
    ``files``: anim, plays, metadata, where there are files.
    An animation whose first frame does not fill the canvas and that has no default image has no content.
    """
    listed = frames.groupBy("anim").agg(F.array_sort(F.collect_list(F.struct("frame_no", "w", "h", "x_off", "y_off", "delay_num", "delay_den", "dispose", "blend"))).alias("frames"))
    colours = palette.groupBy("anim").agg(F.array_sort(F.collect_list(F.struct("idx", *"rgba"))).alias("colours"))
    heads = sizes.join(listed, "anim").join(colours, "anim")
    if files is not None:
        heads = heads.join(files.select("anim", "plays", "metadata"), "anim", "left")
    heads = heads.select(*(F.col(c).alias(c) for c in heads.columns))

    def run(key: tuple, pdf: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        if not len(head):
            return pd.DataFrame({"anim": [], "content": []})
        own = head.iloc[0]
        planes = {int(k): g.sort_values(["y", "x"])["idx"].to_numpy() for k, g in pdf.groupby("frame_no")}
        shown = [
            Frame(planes[f["frame_no"]].reshape(f["h"], f["w"]), f["x_off"], f["y_off"], f["delay_num"], f["delay_den"], f["dispose"], f["blend"])
            for f in own["frames"]
        ]
        still = planes[-1].reshape(int(own["height"]), int(own["width"])) if -1 in planes else None
        entries = np.array([[c[k] for k in "rgba"] for c in own["colours"]], np.int64)
        plays, metadata = (int(own["plays"]), _metadata_of(own["metadata"])) if "plays" in own and pd.notna(own["plays"]) else (0, [])
        try:
            content = encode_animation(Png(int(own["width"]), int(own["height"]), still, shown, plays, metadata), entries, speed)
        except PngError:
            content = None
        return pd.DataFrame({"anim": [key[0]], "content": [content]})

    kind = indexed.schema["anim"].dataType.simpleString()
    pixels = indexed.select("anim", "frame_no", "y", "x", "idx")
    return pixels.groupBy("anim").cogroup(heads.groupBy("anim")).applyInPandas(run, f"anim {kind}, content binary")


def read_standard_input(spark: SparkSession) -> DataFrame:
    """path ('-'), length, content: the one file that is the driver's standard input."""
    content = sys.stdin.buffer.read()
    return spark.createDataFrame([("-", len(content), bytearray(content))], "path string, length long, content binary")


def write_images(images: DataFrame, name: str, folder: str, force: bool = False) -> DataFrame:
    """Writes each ``content`` to folder/name where its row is; an existing file without ``force`` is an argument error. Returns name, status.

    What exists is found out before anything is written, so that a task that runs again writes what it wrote before; a file
    is whole or not there.
    """
    from pyarrow import fs

    target = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    target = re.sub("^file:/(?!/)", "file:///", target)

    def found(batches):
        system, base = fs.FileSystem.from_uri(target)
        for pdf in batches:
            there = [system.get_file_info(f"{base}/{n}").type != fs.FileType.NotFound for n in pdf["name"]]
            yield pdf.assign(there=there)

    def write(batches):
        system, base = fs.FileSystem.from_uri(target)
        system.create_dir(base, recursive=True)
        for pdf in batches:
            status = []
            for own, content, there in zip(pdf["name"], pdf["content"], pdf["there"]):
                status.append("argument" if there and not force else "ok")
                if status[-1] == "ok":
                    system.create_dir(f"{base}/{own}".rpartition("/")[0], recursive=True)
                    part = f"{base}/{own}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as out:
                        out.write(bytes(content))
                    system.move(part, f"{base}/{own}")
            yield pd.DataFrame({"name": pdf["name"], "status": status})

    listed = written(images.select(F.col(name).cast("string").alias("name")).mapInPandas(found, "name string, there boolean"), "targets")
    rows = images.select(F.col(name).cast("string").alias("name"), "content").join(listed.distinct(), "name")
    return written(rows.mapInPandas(write, "name string, status string"), "statuses")
