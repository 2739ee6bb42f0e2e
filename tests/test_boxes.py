import numpy as np
import pytest

from tallyforge.sources import boxes, imaging


def rectangle(height, width, box, inside=255, outside=0, channels=3):
    image = np.full((height, width, channels), outside, dtype=np.uint8)
    x, y, w, h = box
    image[y : y + h, x : x + w] = inside
    return image


def flooded(mask, eight):
    """Components by flood fill, as sets of pixels."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    while left:
        todo = [left.pop()]
        out.append(set(todo))
        while todo:
            y, x = todo.pop()
            for p in ((y + a, x + b) for a, b in steps):
                if p in left:
                    left.remove(p)
                    out[-1].add(p)
                    todo.append(p)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_components_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 30), rng.integers(1, 40))) < (0.3, 0.45, 0.6)[seed % 3]
    for reach in (0, 1):
        (row, first, behind), label = boxes.components(mask, reach)
        found = {}
        for r, a, b, k in zip(row, first, behind, label, strict=True):
            found.setdefault(k, set()).update((int(r), int(x)) for x in range(a, b))
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, ({(int(y), int(x)) for y, x in c} for c in flooded(mask, reach == 1))))
    # components in holes of others are left out: their surroundings do not reach the border
    outside = next(c for c in flooded(np.pad(~mask, 1, constant_values=True), False) if (0, 0) in c)
    wanted = []
    for c in flooded(mask, True):
        y, x = min(c)
        if (y, x + 1) in outside:  # the pixel above, in the padded image
            ys, xs = [p[0] for p in c], [p[1] for p in c]
            wanted.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    assert sorted(map(tuple, boxes.outer_boxes(mask).tolist())) == sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in wanted)


def test_nested_components():
    mask = np.zeros((40, 40), dtype=bool)
    mask[5:35, 5:35] = True
    mask[10:30, 10:30] = False
    mask[15:20, 15:20] = True
    assert boxes.outer_boxes(mask).tolist() == [[5, 5, 30, 30]]
    assert boxes.outer_boxes(np.zeros((3, 3), dtype=bool)).shape == (0, 4)


@pytest.mark.parametrize("reach", [1, 2, 4])
def test_windows_against_loops(reach):
    mask = np.random.default_rng(reach).random((17, 23)) < 0.3
    for y in range(17):
        for x in range(23):
            part = mask[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
            assert boxes.dilated(mask, reach)[y, x] == part.any() and boxes.eroded(mask, reach)[y, x] == part.all()


def naive_edges(light):
    """Pixel by pixel: gradient, maximum across it, and growth from strong pixels."""
    h, w = light.shape
    at = lambda a, y, x: int(a[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            dx[y, x] = sum(k * (at(light, y + d, x + 1) - at(light, y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (at(light, y + 1, x + d) - at(light, y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    size = abs(dx) + abs(dy)
    near = lambda y, x: int(size[y, x]) if 0 <= y < h and 0 <= x < w else 0
    peaks = set()
    for y in range(h):
        for x in range(w):
            m, gx, gy = near(y, x), abs(int(dx[y, x])), abs(int(dy[y, x]))
            if m <= 30:
                continue
            if gy < gx * np.tan(np.pi / 8):
                hit = m > near(y, x - 1) and m >= near(y, x + 1)
            elif gy > gx * np.tan(3 * np.pi / 8):
                hit = m > near(y - 1, x) and m >= near(y + 1, x)
            else:
                s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
                hit = m > near(y - 1, x - s) and m > near(y + 1, x + s)
            if hit:
                peaks.add((y, x))
    todo = [p for p in peaks if near(*p) > 100]
    out = set(todo)
    while todo:
        y, x = todo.pop()
        for p in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            if p in peaks and p not in out:
                out.add(p)
                todo.append(p)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_edges_against_loops(seed):
    rng = np.random.default_rng(seed)
    light = boxes.smooth(rng.integers(0, 256, 24 * 31).astype(float), 3).reshape(24, 31).astype(np.uint8)
    light[6:18, 5:25] = np.minimum(255, light[6:18, 5:25].astype(int) + 60 * seed)
    assert {tuple(map(int, p)) for p in np.argwhere(boxes.edges(light))} == naive_edges(light)


@pytest.mark.parametrize("box", [(20, 60, 150, 120), (5, 34, 180, 90), (60, 100, 110, 150)])
def test_edge_box(box):
    """A thin bright border is found by edges, with the pixel that grows around it; no other finder sees it."""
    image = rectangle(300, 200, box, 90, 90)
    x, y, w, h = box
    image[[y, y + h - 1], x : x + w] = 230
    image[y : y + h, [x, x + w - 1]] = 230
    assert boxes.by_projection(image) is None and boxes.by_colour(image) is None
    got = boxes.by_edges(image)
    assert got and all(abs(a - b) <= 4 for a, b in zip(got, box, strict=True)) and boxes.find_box(image)[0] == "edges"


def test_edge_box_bounds():
    assert boxes.by_edges(np.full((100, 100, 3), 7, dtype=np.uint8)) is None  # no edge
    assert boxes.by_edges(rectangle(100, 100, (20, 30, 30, 30))) is None  # below 15 percent
    assert boxes.by_edges(rectangle(100, 100, (20, 5, 60, 60))) is None  # too near the top
    assert boxes.by_edges(rectangle(100, 100, (0, 30, 60, 60))) is None  # at the left side
    assert boxes.by_edges(rectangle(100, 100, (40, 30, 60, 60))) is None  # at the right side
    assert boxes.by_edges(rectangle(1, 50, (0, 0, 1, 1))) is None
    two = rectangle(200, 200, (10, 40, 80, 100), 255, 0)
    two[40:140, 110:190] = 255  # two of one size: the greater x is taken
    assert boxes.by_edges(two)[0] > 100


@pytest.mark.parametrize("box", [(10, 60, 180, 120), (0, 80, 200, 150)])
def test_colour_box(box):
    """A dark block on green of no greater brightness: neither profile nor, at the sides, edges find it."""
    image = np.zeros((300, 200, 3), dtype=np.uint8)
    image[:] = (40, 130, 40)
    x, y, w, h = box
    image[y : y + h, x : x + w] = (60, 60, 150)
    image[y + 20 : y + 24, x + 20 : x + 24] = (40, 130, 40)  # a gap that is closed
    image[5:8, 5:8] = (0, 0, 0)  # a speck that is removed
    assert boxes.by_colour(image) == box
    if x == 0:
        assert boxes.find_box(image) == ("colour", box)


def test_colour_box_bounds():
    assert boxes.by_colour(np.full((60, 60), 200, dtype=np.uint8)) is None  # grey images have none
    assert boxes.by_colour(np.full((60, 60, 1), 200, dtype=np.uint8)) is None
    plain = np.full((60, 60, 3), 200, dtype=np.uint8)
    assert boxes.by_colour(plain) is None  # all of it
    plain[:] = (40, 130, 40)
    assert boxes.by_colour(plain) is None  # none of it
    plain[:12] = 200
    assert boxes.by_colour(plain) is None  # its middle is too high
    assert boxes.find_box(plain[:, :, :1])[0] in ("fallback", "projection", "edges")


def test_projection_box():
    """400 of 1,000 rows and 320 of 400 columns: margins are 8 rows and 3 columns, smoothing takes 10 at a time."""
    x, y, w, h = boxes.by_projection(rectangle(1000, 400, (40, 300, 320, 400)))
    assert y == 300 - 8 and y + h == 701 + 8 and 37 <= x <= 43 and 357 <= x + w <= 363
    assert boxes.by_projection(rectangle(1000, 400, (40, 300, 320, 150))) is None
    assert boxes.by_projection(rectangle(1000, 400, (40, 100, 320, 800))) is None
    assert boxes.by_projection(rectangle(1000, 400, (40, 300, 80, 400))) is None
    both = rectangle(100, 100, (10, 5, 80, 30))
    both[60:90, 10:90] = 255
    assert boxes.by_projection(both)[1] < 10  # the first of equal runs
    assert boxes.fallback_box(2000, 1000) == (30, 500, 940, 1000)


def test_hue_and_type():
    colours = np.array([[[0, 255, 0], [0, 0, 255], [255, 0, 0], [0, 255, 255], [255, 255, 255], [0, 0, 0], [255, 0, 255]]], dtype=np.uint8)
    hue, saturation, value = boxes.hsv(colours)
    assert hue.tolist() == [[60, 0, 120, 30, 0, 0, 150]] and saturation.tolist() == [[255, 255, 255, 255, 0, 0, 255]] and value.tolist() == [[255, 255, 255, 255, 255, 0, 255]]
    assert imaging.receipt_type(np.repeat(colours[:, :1], 9, axis=0)) == "green" and imaging.receipt_type(colours[:, 4:5]) == "white" and imaging.receipt_type(colours[..., 0]) == "unknown"
    assert boxes.grey(colours).tolist() == [[150, 76, 29, 226, 255, 0, 105]]
