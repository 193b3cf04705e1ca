"""Image files: listing, header facts, sizes and crops."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from annograph.functions.text import stem_of, suffix_of
from annograph.operators.corpus import image_files
from annograph.schemas import IMAGE_SUFFIXES
from annograph.sinks.files import locate

HEAD_BYTES = 65_536  # what is read of a file first; a header that lies behind it takes the whole file
PAGE, PAGES_HELD = 4096, 64  # of a file that is read by ranges
SHORT = 16  # bytes that a slice of such a file reads at once; no format's mark is longer
#: Samples a pixel of the PNG colour types.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _decoded(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_images(
    spark: SparkSession, folder: str, recursive: bool = False, suffixes: Sequence[str] = IMAGE_SUFFIXES, content: bool = False
) -> DataFrame:
    """Image files of a folder (or one file): path, length, modificationTime, stem, suffix. A missing folder is an error.

    The bytes are read only when `content` is asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    columns = [_decoded(F.col("path")).alias("path"), "length", "modificationTime", *(["content"] if content else [])]
    return image_files(reader.load(folder).select(*columns), suffixes)


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Width, height and channels of every file of a folder as its header states them; null where none of the known formats does.

    Files are listed without their content, and tasks read the ranges that the headers lie in (`ranged_headers`).
    """
    files = spark.read.format("binaryFile").load(folder).select(_decoded(F.col("path")).alias("path"))
    out = ranged_headers(files).select("path", "width", "height", "channels")
    return out.withColumn("stem", stem_of(F.col("path"))).withColumn("suffix", suffix_of(F.col("path")))


def ranged_headers(files: DataFrame) -> DataFrame:
    """`files` plus width, height, channels, orientation and `bytes_read`. `path`: of any file system that Arrow knows.

    Only pages that the header or the way to it lies in are read: the first one for most formats, one for each segment of a
    JPEG file before its frame, the directory of a TIFF file wherever it lies.
    """
    added = T.StructType([*HEADER.fields, T.StructField("bytes_read", T.LongType())])
    schema = T.StructType([f for f in files.schema.fields if f.name not in added.names] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                system, place = locate(path)
                with system.open_input_file(place) as file:
                    data = _Pages(file).view()
                    rows.append((*(header_info(data) or (None,) * 3), exif_orientation(data), data.pages.read))
            columns = list(zip(*rows)) if rows else [()] * len(added)
            kinds = [pa.int32()] * len(HEADER) + [pa.int64()]
            kept = [(n, batch.column(n)) for n in schema.names if n not in added.names]
            new = [(n, pa.array(c, k)) for n, c, k in zip(added.names, columns, kinds)]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + new], names=schema.names)

    return files.mapInArrow(run, schema)


class _Pages:
    """A file read by pages; the last few stay."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.read = file, file.size(), 0
        self.held: dict[int, bytes] = {}

    def view(self) -> _View:
        return _View(self, 0, self.size)

    def bytes_of(self, begin: int, end: int) -> bytes:
        out = b""
        for page in range(begin // PAGE, -(-end // PAGE)):
            if page not in self.held:
                if len(self.held) >= PAGES_HELD:
                    self.held.clear()
                self.held[page] = self.file.read_at(min(PAGE, self.size - page * PAGE), page * PAGE)
                self.read += len(self.held[page])
            out += self.held[page]
        skip = begin - begin // PAGE * PAGE
        return out[skip : skip + end - begin]


class _View:
    """A range of a file that slices as bytes do: short slices are bytes, longer ones are views and read nothing."""

    def __init__(self, pages: _Pages, begin: int, end: int) -> None:
        self.pages, self.begin, self.end = pages, begin, end

    def __len__(self) -> int:
        return self.end - self.begin

    def __getitem__(self, part: slice) -> bytes | _View:
        a, b, _ = part.indices(len(self))
        b = max(a, b)
        make = self.pages.bytes_of if b - a <= SHORT else lambda x, y: _View(self.pages, x, y)
        return make(self.begin + a, self.begin + b)


class _Reader:
    """Numbers at offsets of a byte string in one byte order; offsets outside raise."""

    def __init__(self, data: bytes, order: str) -> None:
        self.data, self.order = data, order

    def at(self, offset: int, width: int, signed: bool = False) -> int:
        part = self.data[offset : offset + width]
        if offset < 0 or len(part) < width:
            raise IndexError(offset)
        return int.from_bytes(part, self.order, signed=signed)


def jpeg_segments(data: bytes) -> Iterator[tuple[int, _Reader]]:
    """Marker and payload of each segment before the picture data, by the JPEG syntax: fill bytes and markers without a
    length are passed over, a payload may be cut off by the end of `data`."""
    source, at = _Reader(data, "big"), 2
    with contextlib.suppress(IndexError):
        while True:
            while at < len(data) and 0xFF not in data[at : at + SHORT]:
                at += SHORT
            at += max(0, data[at : at + SHORT].find(0xFF))
            while source.at(at, 1) == 0xFF:
                at += 1
            marker, at = source.at(at, 1), at + 1
            if marker in (0xD9, 0xDA):
                return
            if marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
                continue
            size = source.at(at, 2)
            yield marker, _Reader(data[at + 2 : at + size], "big")
            at += size


def tiff_tags(data: bytes) -> dict[int, int]:
    """First value of each short or long entry of the first directory of a TIFF structure; broken ones end the list."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    tags: dict[int, int] = {}
    if order:
        source = _Reader(data, order)
        with contextlib.suppress(IndexError):
            start = source.at(4, 4)
            for entry in range(start + 2, start + 2 + 12 * source.at(start, 2), 12):
                tag, kind = source.at(entry, 2), source.at(entry + 2, 2)
                source.at(entry + 8, 4)
                tags.setdefault(tag, source.at(entry + 8, 4 if kind == 4 else 2))
    return tags


def exif_orientation(data: bytes) -> int:
    """Orientation tag of a JPEG, 0 when there is none. Only the first application segment of kind 1 counts."""
    first = next((s.data for marker, s in jpeg_segments(data) if marker == 0xE1), b"") if data[:2] == b"\xff\xd8" else b""
    return tiff_tags(first[6:]).get(0x0112, 0) if first[:6] == b"Exif\0\0" else 0


def _png(source: _Reader) -> tuple[int, int, int]:
    return source.at(16, 4), source.at(20, 4), PNG_CHANNELS.get(source.at(25, 1), 3)


def _jpeg(source: _Reader) -> tuple[int, int, int]:
    frames = (s for marker, s in jpeg_segments(source.data) if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC))
    frame = next(frames, _Reader(b"", "big"))
    return frame.at(3, 2), frame.at(1, 2), frame.at(5, 1)


def _webp(source: _Reader) -> tuple[int, int, int]:
    little = _Reader(source.data, "little")
    kind = source.data[12:16]
    if kind == b"VP8X":
        return little.at(24, 3) + 1, little.at(27, 3) + 1, 4 if little.at(20, 1) & 16 else 3
    if kind == b"VP8L":
        bits = little.at(21, 4)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3
    return little.at(26, 2) & 0x3FFF, little.at(28, 2) & 0x3FFF, 3


def _bmp(source: _Reader) -> tuple[int, int, int]:
    little = _Reader(source.data, "little")
    if little.at(14, 4) == 12:
        return little.at(18, 2), little.at(20, 2), 3
    return little.at(18, 4), abs(little.at(22, 4, signed=True)), 4 if little.at(28, 2) == 32 else 3


def _gif(source: _Reader) -> tuple[int, int, int]:
    little = _Reader(source.data, "little")
    return little.at(6, 2), little.at(8, 2), 3


def _tiff(source: _Reader) -> tuple[int, int, int]:
    tags = tiff_tags(source.data)
    if not {256, 257} <= tags.keys():
        raise IndexError("no size")
    return tags[256], tags[257], tags.get(277, 1)


#: Readers by the first bytes of a file, from the formats' specifications.
HEADERS = (
    (re.compile(rb"\x89PNG\r\n\x1a\n", re.S), _png), (re.compile(rb"\xff\xd8", re.S), _jpeg), (re.compile(rb"RIFF....WEBPVP8", re.S), _webp),
    (re.compile(rb"BM", re.S), _bmp), (re.compile(rb"GIF8[79]a", re.S), _gif), (re.compile(rb"II\*\0|MM\0\*", re.S), _tiff),
)


def header_info(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, channels) from the first bytes of a PNG, JPEG, WEBP, BMP, GIF or TIFF file, None if they don't hold them."""
    reader = next((read for magic, read in HEADERS if magic.match(data[:SHORT])), None)
    try:
        return reader(_Reader(data, "big")) if reader else None
    except IndexError:
        return None


HEADER = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "channels", "orientation")])


@F.pandas_udf(HEADER)
def _header_columns(head: pd.Series) -> pd.DataFrame:
    rows = [(None,) * 4 if d is None else (*(header_info(bytes(d)) or (None,) * 3), exif_orientation(bytes(d))) for d in head]
    return pd.DataFrame(rows, columns=["width", "height", "channels", "orientation"]).astype("Int32")


def image_headers(files: DataFrame, content: str = "content", decoded: DataFrame | None = None) -> DataFrame:
    """Width, height, channels and orientation from the file head; only the head travels to Python.

    A longer file whose head does not hold the sizes is read whole. Other formats take their sizes from `decoded` (see
    `image_sizes`) when it is given.
    """
    first = files.withColumn("_info", _header_columns(F.substring(F.col(content), 1, HEAD_BYTES)))
    whole = F.when(F.col("_info.width").isNull() & (F.octet_length(content) > HEAD_BYTES), F.col(content))
    both = first.withColumn("_all", _header_columns(whole))
    picked = [F.when(F.col("_all.width").isNotNull(), F.col("_all")[c]).otherwise(F.col("_info")[c]).alias(c) for c in HEADER.names]
    out = both.select(*[c for c in files.columns if c != content], *picked)
    if decoded is None:
        return out
    full = decoded.select("path", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "channels")])
    j = out.join(full, "path", "left")
    for c in ("width", "height", "channels"):
        j = j.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return j


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Turn and mirror pixels as the orientation tag asks."""
    turns = {3: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    turned = np.rot90(pixels, turns)
    if orientation in (2, 5, 7):
        turned = turned[:, ::-1]
    if orientation == 4:
        turned = turned[::-1]
    return np.ascontiguousarray(turned)


def crop_pixels(images: DataFrame, plan: DataFrame) -> DataFrame:
    """Pixels of planned regions. `images`: path, height, width, channels, data (row-major bytes), orientation.

    `plan`: path, out_name, x, y, w, h in oriented coordinates. Regions travel as one array per image, so the pixels of
    an image are shuffled once and opened once.
    """
    regions = plan.groupBy("path").agg(F.collect_list(F.struct("out_name", "x", "y", "w", "h")).alias("regions"))
    joined = images.select("path", "height", "width", "channels", "data", "orientation").join(regions, "path")

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                shape = (r.height, r.width, r.channels)
                whole = oriented(np.frombuffer(r.data, np.uint8).reshape(shape), int(r.orientation or 0))
                for g in r.regions:
                    part = whole[g["y"] : g["y"] + g["h"], g["x"] : g["x"] + g["w"]]
                    rows.append((r.path, g["out_name"], part.shape[0], part.shape[1], part.shape[2], part.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "out_name", "height", "width", "channels", "data"])

    return joined.mapInPandas(run, "path string, out_name string, height int, width int, channels int, data binary")


def _mirror(index: np.ndarray, n: int) -> np.ndarray:
    """Border reflection without repeating the edge sample."""
    if n == 1:
        return np.zeros_like(index)
    folded = np.abs(index) % (2 * (n - 1))
    return np.where(folded >= n, 2 * (n - 1) - folded, folded)


def sample_strips(pixels: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear (strip, height, width, channel) samples of parallelograms with corners 0 (origin), 1 (far right), 2 (far
    down), in 0..1. `pixels`: (strip, y, x, channel); `corners`: x0, y0, x1, y1, x2, y2 of each strip."""
    across, down = np.meshgrid(np.arange(width) / (width - 1), np.arange(height) / (height - 1))
    x0, y0, x1, y1, x2, y2 = (c[:, None, None] for c in np.asarray(corners, np.float64).T)
    px = x0 + across * (x1 - x0) + down * (x2 - x0)
    py = y0 + across * (y1 - y0) + down * (y2 - y0)
    left, top = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
    fx, fy = (px - left)[..., None], (py - top)[..., None]
    h, w = pixels.shape[1:3]
    row = np.arange(len(pixels))[:, None, None]
    at = lambda yy, xx: pixels[row, _mirror(yy, h), _mirror(xx, w)].astype(np.float64)
    upper = at(top, left) * (1 - fx) + at(top, left + 1) * fx
    lower = at(top + 1, left) * (1 - fx) + at(top + 1, left + 1) * fx
    return ((upper * (1 - fy) + lower * fy) / 255.0).astype(np.float32)


def sample_strip(pixels: np.ndarray, x0, y0, x1, y1, x2, y2, width: int, height: int) -> np.ndarray:
    """`sample_strips` of one image."""
    return sample_strips(pixels[None], np.array([[x0, y0, x1, y1, x2, y2]]), width, height)[0]


#: Bytes of image pixels, and sampled values, worked on at once.
STRIP_BYTES, STRIP_VALUES = 1 << 26, 400_000


def strip_pixels(images: DataFrame, strips: DataFrame, width: int = 96, height: int = 24) -> DataFrame:
    """Channel-first pixel strip (array<float>) along every link. `strips`: path, u, v and the corners of `link_strips`.

    One row per link; the image row is joined to its strips by path, and AQE may split a path with very many links. Links
    on images of one size are sampled together.
    """
    corners = ["x0", "y0", "x1", "y1", "x2", "y2"]
    joined = strips.select("path", "u", "v", *[F.col(c).cast("double").alias(c) for c in corners]).join(
        images.select("path", F.col("height").cast("int").alias("ih"), F.col("width").cast("int").alias("iw"), F.col("channels").cast("int").alias("channels"), "data"), "path"
    )
    schema = pa.schema([("path", pa.string()), ("u", pa.int32()), ("v", pa.int32()), ("patch", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            shapes = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("ih", "iw", "channels")], axis=1)
            places = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in corners], axis=1)
            data, keys = batch.column(batch.schema.get_field_index("data")), batch.select(["path", "u", "v"])
            for shape in np.unique(shapes, axis=0):
                same, (ih, iw, channels) = np.flatnonzero((shapes == shape).all(1)), shape.tolist()
                step = max(1, min(STRIP_BYTES // max(ih * iw * channels, 1), STRIP_VALUES // (width * height * channels)))
                for begin in range(0, len(same), step):
                    rows = same[begin : begin + step]
                    pixels = np.stack([np.frombuffer(data[r].as_buffer(), np.uint8).reshape(ih, iw, channels) for r in rows.tolist()])
                    patch = sample_strips(pixels, places[rows], width, height).transpose(0, 3, 1, 2)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (channels * width * height)), pa.array(patch.ravel()))
                    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(keys.take(pa.array(rows)).columns, schema)), listed], schema=schema)

    return joined.mapInArrow(run, "path string, u int, v int, patch array<float>")
