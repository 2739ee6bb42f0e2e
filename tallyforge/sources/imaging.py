"""Crop, resize, type and bands of receipt images: numpy on Arrow batches.  Images are BGR bytes as Spark reads them.

All are narrow maps: an image is cut and read where it was scanned, and only its tokens go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.sources import png
from tallyforge.sources.boxes import fallback_box, find_box, green  # noqa: F401  (part of this interface)

HEIGHT = 800
#: Green of a receipt's type (hue, saturation, value), and the share of pixels above which a receipt is green.
TYPE_GREEN, GREEN_SHARE = (35, 40, 40), 0.30
SCHEMA = "image_id string, receipt_type string, x int, y int, w int, h int, height int, width int, channels int, data binary, error string, found string, seconds double"
BANDS = "image_id string, slice_idx int, field_name string, data binary, height int, width int, channels int"
READ = "image_id string, receipt_type string, error string, seconds double, tokens array<struct<field_name:string,x:int,token_idx:int,text:string,confidence:double>>"


def resize(image: np.ndarray, height: int) -> np.ndarray:
    """Bilinear, keeping proportions."""
    h, w = image.shape[:2]
    width = max(1, int(w * height / h))
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    a = image.reshape(h, w, -1).astype(np.float64)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def receipt_type(image: np.ndarray) -> str:
    if image.ndim == 2 or image.shape[2] < 3:
        return "unknown"
    return "green" if float(green(image, TYPE_GREEN).mean()) > GREEN_SHARE else "white"


def pixels(data: bytes, height: int, width: int, channels: int, error: str | None = None) -> np.ndarray:
    if error or height <= 0 or width <= 0:
        raise ValueError(error or "Cannot decode image")
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def cropped(image: np.ndarray, target_height: int = HEIGHT) -> tuple[np.ndarray, str, tuple[int, int, int, int]]:
    """The image within its box, resized unless ``target_height`` is 0; how the box was found, and the box."""
    found, (x, y, w, h) = find_box(image)
    crop = image[y : y + h, x : x + w]
    return (resize(crop, target_height) if target_height else crop), found, (x, y, w, h)


def band_rows(height: int) -> Iterator[tuple[int, str, int, int]]:
    """Number, field, top and bottom of the seven bands that are read: eighths of the height and a tenth of one beyond on
    either side."""
    size = height / len(schemas.BANDS)
    beyond = int(size * 0.1)
    for k, field in enumerate(schemas.BANDS):
        if field in schemas.FIELDS:
            yield k, field, max(0, int(k * size) - beyond), min(height, int((k + 1) * size) + beyond)


def preprocess(images: DataFrame, target_height: int = HEIGHT) -> DataFrame:
    """Images cropped to their box and resized, with receipt type, how the box was ``found`` and the ``seconds`` it took.

    What cannot be decoded keeps height -1 and has the type unknown and an ``error``; the job goes on.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                start = time.perf_counter()
                try:
                    crop, found, box = cropped(pixels(r.data, r.height, r.width, r.channels, r.error), target_height)
                    out.append((r.image_id, receipt_type(crop), *box, *crop.shape[:2], r.channels, crop.tobytes(), None, found, time.perf_counter() - start))
                except Exception as e:  # noqa: BLE001  reported as a row
                    out.append((r.image_id, "unknown", 0, 0, 0, 0, -1, -1, r.channels, None, str(e) or type(e).__name__, None, time.perf_counter() - start))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return with_error(images).mapInPandas(task, SCHEMA)


def debug_images(images: DataFrame) -> DataFrame:
    """For looking at: each image with its box drawn and its crop before resizing, as PNG (``image_id, name, content``), with
    how the box was ``found``.  Images that cannot be decoded have none.  Spark writes no single binary files, so these are
    rows of a table."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.error or r.height <= 0:
                    continue
                image = pixels(r.data, r.height, r.width, r.channels).copy()
                crop, found, (x, y, w, h) = cropped(image, 0)
                crop = png.encode(crop)
                colour = (0, 255, 0)[: r.channels] if r.channels >= 3 else (255,)
                for rows, columns in ((slice(y, y + 3), slice(x, x + w)), (slice(y + h - 3, y + h), slice(x, x + w)), (slice(y, y + h), slice(x, x + 3)), (slice(y, y + h), slice(x + w - 3, x + w))):
                    image[rows, columns, : len(colour)] = colour
                out += [(r.image_id, "box", found, png.encode(image)), (r.image_id, "crop", found, crop)]
            yield pd.DataFrame(out, columns=["image_id", "name", "found", "content"])

    return with_error(images).mapInPandas(task, "image_id string, name string, found string, content binary")


def bands(images: DataFrame) -> DataFrame:
    """The seven bands of preprocessed images as images of their own; images with an ``error`` have none."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BANDS.split(", ")]
        for frame in frames:
            for r in frame.itertuples():
                image = pixels(r.data, r.height, r.width, r.channels)
                yield pd.DataFrame([(r.image_id, k, field, image[top:bottom].tobytes(), bottom - top, r.width, r.channels) for k, field, top, bottom in band_rows(r.height)], columns=names)

    return images.where("error is null").select("image_id", "height", "width", "channels", "data").mapInPandas(task, BANDS)


Reader = Callable[[bytes, int, int, int], list[tuple[str, float, list]]]


def with_error(images: DataFrame) -> DataFrame:
    """The columns of images that are read, with the ``error`` that decoding left, if it says so."""
    error = F.col("error") if "error" in images.columns else F.lit(None).cast("string")
    return images.select("image_id", "height", "width", "channels", "data", error.alias("error"))


def read_receipts(images: DataFrame, reader: Callable[[], Reader], target_height: int = HEIGHT, crop: bool = True) -> DataFrame:
    """From images (``image_id, height, width, channels, data``) to one row each with all tokens of its bands: cropped,
    typed, cut and read in one map, so that neither image nor band is moved.

    ``reader`` makes a function (data, height, width, channels) -> [(text, confidence, box)], once per Python worker.  A
    failure anywhere in an image is its ``error``; ``seconds`` is the time it took.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for frame in frames:
            out = []
            for r in frame.itertuples():
                start, kind, tokens, error = time.perf_counter(), "unknown", [], None
                try:
                    image = pixels(r.data, r.height, r.width, r.channels, r.error)
                    image = cropped(image, target_height)[0] if crop else image
                    kind = receipt_type(image)
                    for _, field, top, bottom in band_rows(image.shape[0]):
                        found = read(image[top:bottom].tobytes(), bottom - top, image.shape[1], r.channels)
                        tokens += [{"field_name": field, "x": int(box[0][0]), "token_idx": k, "text": text.strip(), "confidence": float(c)} for k, (text, c, box) in enumerate(found) if text.strip()]
                except Exception as e:  # noqa: BLE001  reported as a row
                    kind, tokens, error = "unknown", [], str(e) or type(e).__name__
                out.append((r.image_id, kind, error, time.perf_counter() - start, tokens))
            yield pd.DataFrame(out, columns=["image_id", "receipt_type", "error", "seconds", "tokens"])

    return with_error(images).mapInPandas(task, READ)
