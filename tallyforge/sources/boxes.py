"""Where the bright block of a receipt lies: by brightness profiles, by its border, by its colour.

Each finder takes one image (numpy, grey or BGR) and gives x, y, width, height or nothing.  They run inside Arrow tasks, an
image at a time, in whole-array operations: convolution by shifts, runs of pixels in place of pixels for components, running
counts for minima and maxima.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Box = tuple[int, int, int, int]

#: Grey weights of blue, green and red in 15 bits, the tangent of 22.5 degrees in 15 bits, and the edge bounds.
GREY = (3735, 19235, 9798)
TAN_22 = 13573
LOW, HIGH = 30, 100
#: Green from (hue, saturation, value) on, hue in half degrees up to 85.
GREEN_FROM, GREEN_HUE_TO = (35, 30, 30), 85
#: Shares of the image that bound a block's area, and of its height that bound its middle.
LEAST_AREA, MOST_AREA = 0.15, 0.95
MIDDLE = (0.2, 0.8)


def fallback_box(height: int, width: int) -> Box:
    return int(width * 0.03), int(height * 0.25), int(width * 0.94), int(height * 0.50)


def grey(image: np.ndarray) -> np.ndarray:
    """Brightness 0 to 255, rounded; the only channel of grey images."""
    if image.ndim == 2 or image.shape[2] < 3:
        return image.reshape(image.shape[:2])
    b, g, r = (image[..., k].astype(np.int32) * GREY[k] for k in range(3))
    return (b + g + r + (1 << 14) >> 15).astype(np.uint8)


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in half degrees (0 to 179), saturation and value (0 to 255) of a BGR image, rounded in 12 bits."""
    b, g, r = (image[..., k].astype(np.int32) for k in range(3))
    value = np.maximum(np.maximum(b, g), r)
    span = value - np.minimum(np.minimum(b, g), r)
    per = lambda full, by: np.rint((full << 12) / np.maximum(by, 1)).astype(np.int64) * (by > 0)
    saturation = span * per(255, value) + 2048 >> 12
    turn = np.where(value == r, g - b, np.where(value == g, b - r + 2 * span, r - g + 4 * span))
    hue = turn * per(30, span) + 2048 >> 12
    return np.where(hue < 0, hue + 180, hue), saturation, value


def green(image: np.ndarray, least: tuple[int, int, int] = GREEN_FROM) -> np.ndarray:
    hue, saturation, value = hsv(image)
    return (hue >= least[0]) & (hue <= GREEN_HUE_TO) & (saturation >= least[1]) & (value >= least[2])


def smooth(values: np.ndarray, size: int) -> np.ndarray:
    return np.convolve(values, np.ones(size) / size, mode="same")


def by_projection(image: np.ndarray) -> Box | None:
    """The longest run of rows (the first of equal ones) whose smoothed brightness is 20 above the mean, if it has a fifth
    to seven tenths of the height, and from the first to the last of its columns that are 10 above theirs, if these are
    three tenths of the width.  The margin is a fiftieth of the block's height and a hundredth of its width."""
    light = grey(image)
    height, width = light.shape
    size = max(5, height // 100)
    rows = smooth(light.mean(axis=1), size)
    edges = np.diff(np.concatenate(([0], rows > rows.mean() + 20, [0])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return None
    longest = int(np.argmax(ends - starts))
    top, bottom = int(starts[longest]), int(ends[longest])
    if not height * 0.2 <= bottom - top <= height * 0.7:
        return None
    columns = smooth(light[top:bottom].mean(axis=0), size)
    lit = np.flatnonzero(columns > columns.mean() + 10)
    if len(lit) < width * 0.3:
        return None
    left, right = int(lit[0]), int(lit[-1])
    dy, dx = int((bottom - top) * 0.02), int((right - left) * 0.01)
    x, y = max(0, left - dx), max(0, top - dy)
    return x, y, min(width, right + dx) - x, min(height, bottom + dy) - y


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the smallest one that the pairs (a, b) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], low)
        np.minimum.at(hooked, label[b], low)
        while not np.array_equal(hooked, hooked[hooked]):
            hooked = hooked[hooked]
        if np.array_equal(hooked, label):
            return label
        label = hooked[label]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and column behind of each run of set pixels, row by row."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    padded[:, 1:-1] = mask
    edge = np.diff(padded, axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def components(mask: np.ndarray, reach: int = 1) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Runs of a mask and for each the first run of its component; runs of neighbouring rows are joined where they overlap
    (``reach`` 0) or also where they touch at corners (1)."""
    row, first, behind = runs(mask)
    wide = mask.shape[1] + 4  # positions of all rows on one line
    at_first, at_behind = row * wide + first, row * wide + behind
    low = np.searchsorted(at_behind, at_first + wide - reach, side="right")
    high = np.searchsorted(at_first, at_behind + wide + reach, side="left")
    count = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(row)), count)
    lower = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return (row, first, behind), labels(upper, lower, len(row))


def outer_boxes(mask: np.ndarray) -> np.ndarray:
    """x, y, width, height of the components of set pixels that do not lie in a hole of another one, a row each."""
    (row, first, behind), label = components(mask)
    if not len(row):
        return np.zeros((0, 4), dtype=np.int64)
    heads = np.flatnonzero(label == np.arange(len(label)))
    number = np.searchsorted(heads, label)
    left, right, bottom = np.full(len(heads), mask.shape[1]), np.zeros(len(heads), dtype=np.int64), np.zeros(len(heads), dtype=np.int64)
    np.minimum.at(left, number, first)
    np.maximum.at(right, number, behind)
    np.maximum.at(bottom, number, row + 1)
    # the pixel above a component's first run is background of what surrounds it: of the outside, or of a hole
    around = np.ones((mask.shape[0] + 2, mask.shape[1] + 2), dtype=bool)
    around[1:-1, 1:-1] = ~mask
    (out_row, out_first, _), out_label = components(around, reach=0)
    width = around.shape[1]
    above = np.searchsorted(out_row * width + out_first, row[heads] * width + first[heads] + 1, side="right") - 1
    free = out_label[above] == 0
    return np.stack((left, row[heads], right - left, bottom - row[heads]), axis=1)[free]


def largest(boxes: np.ndarray, fits: np.ndarray) -> Box | None:
    """The box of the largest area that fits; of equal areas that of the greatest x, y, width, height."""
    found = [(int(w * h), (int(x), int(y), int(w), int(h))) for x, y, w, h in boxes[fits]]
    return max(found)[1] if found else None


def edges(light: np.ndarray, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """Pixels on edges: gradients of at least ``low`` that are greatest across the edge, connected to one above ``high``."""
    height, width = light.shape
    a = np.pad(light.astype(np.int32), 1, mode="edge")
    part = lambda y, x: a[1 + y : 1 + y + height, 1 + x : 1 + x + width]
    dx = part(-1, 1) + 2 * part(0, 1) + part(1, 1) - part(-1, -1) - 2 * part(0, -1) - part(1, -1)
    dy = part(1, -1) + 2 * part(1, 0) + part(1, 1) - part(-1, -1) - 2 * part(-1, 0) - part(-1, 1)
    size = np.abs(dx) + np.abs(dy)
    b = np.pad(size, 1)
    near = lambda y, x: b[1 + y : 1 + y + height, 1 + x : 1 + x + width]
    steep, flat = np.abs(dy).astype(np.int64) << 15, np.abs(dx).astype(np.int64) * TAN_22
    across, along = steep < flat, steep > flat + (np.abs(dx).astype(np.int64) << 16)
    falls = (dx ^ dy) < 0
    peak = np.where(
        across, (size > near(0, -1)) & (size >= near(0, 1)),
        np.where(along, (size > near(-1, 0)) & (size >= near(1, 0)), np.where(falls, (size > near(-1, 1)) & (size > near(1, -1)), (size > near(-1, -1)) & (size > near(1, 1)))),
    )
    peak &= size > low
    (row, first, behind), label = components(peak)
    strong = np.zeros((height, width + 1), dtype=np.int64)
    strong[:, 1:] = np.cumsum(peak & (size > high), axis=1)
    kept = np.zeros(len(row), dtype=bool)
    kept[label[strong[row, behind] > strong[row, first]]] = True
    kept = kept[label]
    marks = np.zeros((height, width + 1), dtype=np.int8)
    np.add.at(marks, (row[kept], first[kept]), 1)
    np.add.at(marks, (row[kept], behind[kept]), -1)
    return np.cumsum(marks, axis=1)[:, :-1].astype(bool)


def window_counts(mask: np.ndarray, reach: int) -> np.ndarray:
    """Set pixels in the square of ``2 * reach + 1`` around each pixel, within the image."""
    for axis in (0, 1):
        n = mask.shape[axis]
        sums = np.concatenate((np.zeros_like(np.take(mask, [0], axis), dtype=np.int64), np.cumsum(mask, axis=axis, dtype=np.int64)), axis=axis)
        at = np.arange(n)
        mask = np.take(sums, np.minimum(at + reach + 1, n), axis) - np.take(sums, np.maximum(at - reach, 0), axis)
    return mask


def dilated(mask: np.ndarray, reach: int) -> np.ndarray:
    return window_counts(mask, reach) > 0


def eroded(mask: np.ndarray, reach: int) -> np.ndarray:
    return window_counts(~mask, reach) == 0


def by_edges(image: np.ndarray) -> Box | None:
    """The largest box around edges, grown by a pixel, that are connected: of 15 to 95 percent of the image, a hundredth of
    the width away from its sides and a tenth of the height from its top."""
    light = grey(image)
    height, width = light.shape
    if height < 2 or width < 2:
        return None
    boxes = outer_boxes(dilated(edges(light), 1))
    x, y, w, h = boxes.T
    area = w * h
    return largest(boxes, (area >= width * height * LEAST_AREA) & (area <= width * height * MOST_AREA) & (x >= width * 0.01) & (y >= height * 0.1) & (x + w <= width * 0.99))


def by_colour(image: np.ndarray) -> Box | None:
    """The largest region that is not green, gaps of up to eight pixels closed and specks of up to four removed: of 15 to
    95 percent of the image, its middle between a fifth and four fifths of the height.  Grey images have none."""
    if image.ndim == 2 or image.shape[2] < 3:
        return None
    height, width = image.shape[:2]
    other = eroded(dilated(~green(image), 4), 4)  # twice two pixels
    boxes = outer_boxes(dilated(eroded(other, 2), 2))
    _, y, w, h = boxes.T
    area, middle = w * h, y + h / 2
    return largest(boxes, (area >= width * height * LEAST_AREA) & (area <= width * height * MOST_AREA) & (middle >= height * MIDDLE[0]) & (middle <= height * MIDDLE[1]))


#: Tried in this order; the first that finds a box is taken.
FINDERS: dict[str, Callable[[np.ndarray], Box | None]] = {"projection": by_projection, "edges": by_edges, "colour": by_colour}


def find_box(image: np.ndarray) -> tuple[str, Box]:
    """How the box was found, and the box."""
    for name, finder in FINDERS.items():
        if box := finder(image):
            return name, box
    return "fallback", fallback_box(*image.shape[:2])
