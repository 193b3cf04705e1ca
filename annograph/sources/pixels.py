"""Minimal PNG bytes for 8-bit images, so that crops can be stored without an image library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def png_bytes(pixels: np.ndarray) -> bytes:
    """Height x width x channels uint8 to PNG. Three channels come in blue-green-red order, as Spark's image source has them."""
    height, width, channels = pixels.shape
    if channels >= 3:
        pixels = pixels[:, :, [2, 1, 0, *range(3, channels)]]
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, COLOUR[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def encode_png(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([
        png_bytes(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))) for h, w, c, d in zip(height, width, channels, data)
    ])


def with_png(crops: DataFrame) -> DataFrame:
    """Add `content` (PNG bytes) to rows of height, width, channels, data."""
    return crops.withColumn("content", encode_png("height", "width", "channels", "data"))


def write_binary(files: DataFrame, out: str, name: str = "out_name", content: str = "content") -> None:
    """One file per row, written by the executors and renamed into place when complete."""

    def save(rows):
        import os
        import time

        os.makedirs(out, exist_ok=True)
        for row in rows:
            target = os.path.join(out, row[name])
            partial = f"{target}.{os.getpid()}.{time.time_ns()}.part"
            with open(partial, "wb") as f:
                f.write(row[content])
            os.replace(partial, target)

    files.select(name, content).foreachPartition(save)
