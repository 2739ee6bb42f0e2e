"""PNG bytes to pixels: the uploads of a table as the images that Spark's own source reads from files.

Chunks are checked and inflated, lines unfiltered and samples unpacked in numpy.  A filtered byte depends on the one before
it, the one above and the one between, so all lines are undone together along diagonals.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The signature, samples of a pixel by colour type, and first column, first row, steps of the seven passes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Images of more pixels are refused before anything is inflated.
MOST_PIXELS = 200_000_000
SCHEMA = "image_id string, height int, width int, channels int, data binary, error string"


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk up to the end chunk."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("Cannot decode image: no PNG")
    at = len(SIGNATURE)
    while True:
        if at + 12 > len(raw):
            raise ValueError("Cannot decode image: cut short")
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body, check = raw[at + 8 : at + 8 + size], raw[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError(f"Cannot decode image: broken chunk {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of lines whose first byte names their filter, ``step`` bytes to a pixel.

    Line r lies r places to the right in a skewed array, so that what a column needs (left, above, above left) is in the
    two columns before it; a pixel column is undone at once for all lines.
    """
    rows, width = lines.shape[0], (lines.shape[1] - 1) // step
    kind = lines[:, 0]
    if kind.max(initial=0) > 4:
        raise ValueError("Cannot decode image: unknown filter")
    out = np.zeros((rows + 1, width + 1, step), dtype=np.int16)  # a line and a column of zeros before
    coded = lines[:, 1:].reshape(rows, width, step).astype(np.int16)
    line = np.arange(rows)
    for d in range(rows + width - 1 if width else 0):
        r = line[max(0, d - width + 1) : d + 1]
        x = d - r
        a, b, c = out[r + 1, x], out[r, x + 1], out[r, x]
        by = kind[r][:, None]
        guess = a + b - c
        far_a, far_b, far_c = abs(guess - a), abs(guess - b), abs(guess - c)
        nearest = np.where((far_a <= far_b) & (far_a <= far_c), a, np.where(far_b <= far_c, b, c))
        add = np.where(by == 1, a, np.where(by == 2, b, np.where(by == 3, (a + b) >> 1, np.where(by == 4, nearest, 0))))
        out[r + 1, x + 1] = (coded[r, x] + add) & 255
    return out[1:, 1:].reshape(rows, width * step).astype(np.uint8)


def samples(raw: np.ndarray, width: int, height: int, depth: int, count: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, count) of inflated lines, and how many bytes they took."""
    size = (width * count * depth + 7) // 8
    used = height * (size + 1)
    if len(raw) < used:
        raise ValueError("Cannot decode image: cut short")
    lines = unfiltered(raw[:used].reshape(height, size + 1), max(1, count * depth // 8))
    if depth == 16:
        return lines.reshape(height, width, count, 2)[..., 0], used  # the high byte
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : width * count]
    return lines.reshape(height, width, count), used


def decode(raw: bytes) -> np.ndarray:
    """Height, width, 3 in BGR; grey is spread over the three, transparency is left out, 16 bits are cut to 8."""
    head, palette, packed = None, None, []
    for kind, body in chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("Cannot decode image: no header")
    width, height, depth, colour, _, _, laced = head
    if depth not in DEPTHS.get(colour, ()) or laced > 1 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("Cannot decode image: header")
    count = SAMPLES[colour]
    parts = [(0, 0, 1, 1)] if not laced else PASSES
    shapes = [(-(-(width - x) // dx), -(-(height - y) // dy)) if width > x and height > y else (0, 0) for x, y, dx, dy in parts]
    most = sum(h * ((w * count * depth + 7) // 8 + 1) for w, h in shapes if w and h)
    try:
        data = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), most), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError(f"Cannot decode image: {e}") from e
    image = np.zeros((height, width, count), dtype=np.uint8)
    for (x, y, dx, dy), (w, h) in zip(parts, shapes, strict=True):
        if w and h:
            image[y::dy, x::dx], used = samples(data, w, h, depth, count)
            data = data[used:]
    if colour == 3:
        if palette is None or int(image.max(initial=0)) >= len(palette):
            raise ValueError("Cannot decode image: palette")
        return palette[image[..., 0]][..., ::-1]
    if count < 3:
        scale = 255 // ((1 << depth) - 1) if depth < 8 else 1
        return np.repeat(image[..., :1] * np.uint8(scale), 3, axis=2)
    return image[..., 2::-1]


def encode(image: np.ndarray) -> bytes:
    """PNG of BGR or grey pixels, unfiltered."""
    image = image.reshape(*image.shape[:2], -1)
    rows = image[..., :1] if image.shape[2] < 3 else image[..., 2::-1]
    height, width, count = rows.shape
    lines = np.concatenate((np.zeros((height, 1), dtype=np.uint8), rows.reshape(height, width * count)), axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if count == 3 else 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decoded(uploads: DataFrame) -> DataFrame:
    """Images of uploads (``image_id``, ``content`` bytes): BGR pixels, or height -1 and an ``error``; the job goes on.

    Null and empty contents are errors too, rows may repeat, other columns are not read, an empty table gives none.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                try:
                    image = decode(r.content or b"")
                    out.append((r.image_id, image.shape[0], image.shape[1], 3, np.ascontiguousarray(image).tobytes(), None))
                except Exception as e:  # noqa: BLE001  reported as a row
                    out.append((r.image_id, -1, -1, -1, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return uploads.select("image_id", "content").mapInPandas(task, SCHEMA)
