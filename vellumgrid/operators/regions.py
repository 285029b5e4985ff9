"""A detector's probability map to text regions: threshold, dilation, borders, rectangles, scores.

Numpy only.  Borders of 8-connected shapes and of their holes both count as
contours, in the order in which a scan by rows meets them.
"""

from __future__ import annotations

import numpy as np

from vellumgrid.operators.options import DetectOptions

# clockwise neighbours, from the left
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def binarize(prob: np.ndarray, options: DetectOptions) -> np.ndarray:
    """Bytes above the byte of the threshold; scores saturate at 0 and 255, NaN is 0."""
    level = int(np.float32(options.binarize) * np.float32(255))
    bytes_ = np.clip(np.nan_to_num(prob * np.float32(255), nan=0.0), 0, 255).astype(np.uint8)
    return bytes_ > level


def dilate(mask: np.ndarray) -> np.ndarray:
    """3 x 3 square dilation."""
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])


def borders(mask: np.ndarray) -> list[np.ndarray]:
    """Borders as (n, 2) arrays of x, y: each outer and each hole border followed once from its first pixel."""
    h, w = mask.shape
    label = np.pad(mask, 1).astype(np.int32)
    starts = np.argwhere((label[1:-1, 1:-1] == 1) & ((label[1:-1, :-2] == 0) | (label[1:-1, 2:] == 0))) + 1
    out, number = [], 1
    for y, x in starts:
        for hole in (False, True):
            if hole:
                if not (label[y, x] >= 1 and label[y, x + 1] == 0):
                    continue
                first = 4
            else:
                if not (label[y, x] == 1 and label[y, x - 1] == 0):
                    continue
                first = 0
            number += 1
            out.append(_follow(label, int(y), int(x), first, number))
    return [np.array(b) - 1 for b in out]


def _follow(label: np.ndarray, y: int, x: int, first: int, number: int) -> list[tuple[int, int]]:
    """Trace one border; pixels whose right side was seen as background are marked negative."""
    start = None
    for k in range(8):
        dy, dx = _AROUND[(first + k) % 8]
        if label[y + dy, x + dx] != 0:
            start = (y + dy, x + dx)
            break
    if start is None:
        label[y, x] = -number
        return [(x, y)]
    points, at, came = [], (y, x), start
    while True:
        points.append((at[1], at[0]))
        k0 = _AROUND.index((came[0] - at[0], came[1] - at[1]))
        right_seen = False
        nxt = None
        for k in range(1, 9):
            d = _AROUND[(k0 - k) % 8]
            p = (at[0] + d[0], at[1] + d[1])
            if label[p] != 0:
                nxt = p
                break
            if d == (0, 1):
                right_seen = True
        if right_seen:
            label[at] = -number
        elif label[at] == 1:
            label[at] = number
        if nxt == (y, x) and at == start:
            return points
        at, came = nxt, at


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, of (n, 2) points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq):
        chain: list = []
        for p in seq:
            while len(chain) > 1 and cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(pts.tolist()) + half(pts[::-1].tolist()))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around the points, cut to integers."""
    h = hull(points)
    if len(h) < 3:
        a, b = h[0], h[-1]
        return np.array([a, b, b, a])
    edges = np.roll(h, -1, axis=0) - h
    best, found = np.inf, None
    for e in edges:
        n = np.hypot(*e)
        if not n:
            continue
        u, v = e / n, np.array([-e[1], e[0]]) / n
        a, b = h @ u, h @ v
        size = (a.max() - a.min()) * (b.max() - b.min())
        if size < best - 1e-9:
            best, found = size, np.array([u * a.min() + v * b.min(), u * a.max() + v * b.min(), u * a.max() + v * b.max(), u * a.min() + v * b.max()])
    return np.floor(found + 1e-9).astype(int)


def short_side(corners: np.ndarray) -> float:
    return float(min(np.hypot(*(corners[0] - corners[1])), np.hypot(*(corners[1] - corners[2]))))


def masked_mean(prob: np.ndarray, points: np.ndarray) -> float:
    """Mean score within the filled border, 0 for none."""
    h, w = prob.shape
    x0, y0 = np.clip(points.min(0), 0, (w - 1, h - 1))
    x1, y1 = np.clip(points.max(0), 0, (w - 1, h - 1))
    mask = np.zeros((y1 - y0 + 1, x1 - x0 + 1), dtype=bool)
    rel = points - (x0, y0)
    for y in range(mask.shape[0]):  # even-odd fill by rows
        a, b = rel, np.roll(rel, -1, axis=0)
        hit = ((a[:, 1] <= y) & (b[:, 1] > y)) | ((b[:, 1] <= y) & (a[:, 1] > y))
        if hit.any():
            xs = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
            for s, e in zip(xs[::2], xs[1::2]):
                mask[y, max(0, int(np.ceil(s))) : int(np.floor(e)) + 1] = True
    inside = (rel[:, 0] >= 0) & (rel[:, 1] >= 0) & (rel[:, 0] < mask.shape[1]) & (rel[:, 1] < mask.shape[0])
    mask[rel[inside, 1], rel[inside, 0]] = True
    part = prob[y0 : y1 + 1, x0 : x1 + 1][mask]
    return float(part.astype(np.float32).mean()) if part.size else 0.0


def padded_box(corners: np.ndarray, original: tuple[int, int], resized: tuple[int, int], padding: float) -> tuple[float, float, float, float]:
    sx, sy, p = np.float32(original[0]) / np.float32(resized[0]), np.float32(original[1]) / np.float32(resized[1]), np.float32(padding)
    lo, hi = corners.min(0).astype(np.float32), corners.max(0).astype(np.float32)
    return (float(max(lo[0] * sx - p, 0)), float(max(lo[1] * sy - p, 0)), float(min(hi[0] * sx + p, original[0])), float(min(hi[1] * sy + p, original[1])))


def postprocess(prob: np.ndarray, original: tuple[int, int], resized: tuple[int, int], options: DetectOptions = DetectOptions()) -> list[tuple[tuple[float, float, float, float], float]]:
    """((x0, y0, x1, y1) in crop pixels, score) of each region of an H x W map."""
    out = []
    for points in borders(dilate(binarize(prob, options))):
        if len(points) <= 2:
            continue
        corners = least_rectangle(points)
        if short_side(corners) < options.least_side:
            continue
        score = masked_mean(prob, points)
        if score < options.least_region_score:
            continue
        again = least_rectangle(corners)
        if short_side(again) < options.least_side + 2:
            continue
        out.append((padded_box(again, original, resized, options.padding), score))
    return out
