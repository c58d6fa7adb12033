"""Smaller, larger and composed pictures against plain work on whole pictures, with several tilings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import resample, tiles

SHAPES = [(1, 1), (1, 9), (7, 1), (20, 33), (45, 38), (64, 10)]


def planes(depth, shapes=SHAPES):
    r = np.random.default_rng(depth)
    return {f"{h}x{w}": np.where(r.random((h, w)) < 0.3, (1 << depth) - 1, r.integers(0, 1 << depth, (h, w))).astype(np.int64) for h, w in shapes}


def pieces(spark, pictures, lines):
    rows = [(k, p.shape[1], p.ravel().astype(float).tolist()) for k, p in pictures.items()]
    return tiles.pieces_of(spark.createDataFrame(rows, "k string, wide int, p array<double>"), ["k"], "wide", ["p"], lines)


def whole(df):
    out = {}
    for r in resample.samples_of(df, ["k"]).collect():
        assert (r["x"], r["y"]) not in out.setdefault(r["k"], {})
        out[r["k"]][r["x"], r["y"]] = r["v0"]
    return {k: np.array([[v[x, y] for x in range(max(c[0] for c in v) + 1)] for y in range(max(c[1] for c in v) + 1)]) for k, v in out.items()}


def same(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].shape == v.shape and (got[k] == v).all(), k


def at(p, y, x):
    return int(p[min(max(y, 0), p.shape[0] - 1), min(max(x, 0), p.shape[1] - 1)])


TAPS = {-4: 2, -3: -4, -2: -8, -1: 17, 0: 57, 1: 57, 2: 17, 3: -8, 4: -4, 5: 2}


def halved(p, fmt, depth):
    h, w = p.shape
    top = (1 << depth) - 1
    across = np.array([[sum(t * at(p, y, 2 * x + k) for k, t in TAPS.items()) for x in range((w + 1) // 2)] for y in range(h)])
    if fmt == "422":
        return ((across + 64) >> 7).clip(0, top)
    lines = (across + (1 << (depth - 8))) >> (depth - 7)
    down = np.array([[sum(t * at(lines, 2 * y + k, x) for k, t in TAPS.items()) for x in range((w + 1) // 2)] for y in range((h + 1) // 2)])
    return ((down + (1 << (20 - depth))) >> (21 - depth)).clip(0, top)


@pytest.mark.parametrize(("fmt", "depth", "tile", "lines"), [("420", 8, 128, 64), ("420", 10, 8, 3), ("422", 8, 5, 200), ("422", 12, 16, 7)])
def test_halving(spark, fmt, depth, tile, lines):
    made = planes(depth)
    same(whole(resample.halve_chroma(pieces(spark, made, lines), ["k"], fmt, depth, tile)), {k: halved(p, fmt, depth) for k, p in made.items()})


FORWARD = [-1, 4, -10, 57, 18, -6, 2]


def doubled(p, fmt, w, h, depth):
    p = p >> (depth - 8)
    taps = lambda i: FORWARD[::-1] if i % 2 == 0 else FORWARD
    if fmt == "420":
        p = np.array([[sum(taps(y)[k] * at(p, y // 2 + k - 3, x) for k in range(7)) for x in range(p.shape[1])] for y in range(h)])
        return np.array([[min(max((sum(taps(x)[k] * at(p, y, x // 2 + k - 3) for k in range(7)) + 2048) >> 12, 0), 255) for x in range(w)] for y in range(h)])
    return np.array([[min(max((sum(taps(x)[k] * at(p, min(y, p.shape[0] - 1), x // 2 + k - 3) for k in range(7)) + 32) >> 6, 0), 255) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize(("fmt", "depth", "odd", "tile", "lines"), [("420", 8, 0, 128, 64), ("420", 10, 1, 8, 3), ("422", 8, 1, 5, 200)])
def test_doubling(spark, fmt, depth, odd, tile, lines):
    made = planes(depth)
    p = pieces(spark, made, lines)
    w, h = F.col("w") * 2 - odd, F.col("h") * 2 - odd if fmt == "420" else F.col("h")
    want = {k: doubled(v, fmt, 2 * v.shape[1] - odd, 2 * v.shape[0] - odd if fmt == "420" else v.shape[0], depth) for k, v in made.items()}
    same(whole(resample.double_chroma(p, ["k"], w, h, fmt, depth, tile)), want)


def resized(p, edge, top):
    longest = max(p.shape)
    if longest <= edge:
        return p
    h, w = (max(1, math.floor(n * (edge / longest) + 0.5)) for n in p.shape)

    def line(values, n):
        step = len(values) / n
        out = []
        for i in range(n):
            centre, total, weights = (i + 0.5) * step - 0.5, 0.0, 0.0
            for j in range(math.floor(centre - 3 * max(step, 1)), math.ceil(centre + 3 * max(step, 1)) + 1):
                d = (centre - j) / max(step, 1)
                g = 0.0 if abs(d) >= 3 else np.sinc(d) * np.sinc(d / 3)
                total, weights = total + g * values[min(max(j, 0), len(values) - 1)], weights + g
            out.append(total / weights)
        return out

    across = np.array([line(row, w) for row in p])
    down = np.array([line(across[:, x], h) for x in range(w)]).T
    return np.floor(down + 0.5).clip(0, top)


@pytest.mark.parametrize(("edge", "tile", "lines"), [(17, 128, 64), (30, 4, 3), (1, 8, 9), (100, 8, 9)])
def test_resizing(spark, edge, tile, lines):
    made = planes(8)
    same(whole(resample.resize_to_fit(pieces(spark, made, lines), ["k"], edge, tile=tile)), {k: resized(p, edge, 255) for k, p in made.items()})


@pytest.mark.parametrize(("tile", "lines"), [(128, 64), (7, 4)])
def test_composition(spark, tile, lines):
    shapes = {"a": (20, 30), "b": (9, 9), "c": (50, 4), "d": (5, 5)}
    made = {k: np.full(s, i + 1) + np.arange(s[1]) for i, (k, s) in enumerate(shapes.items())}
    # (layer, canvas, z, x, y): overlapping, beyond the rim, at a negative place, outside, without a canvas.
    placed = [("a", "one", 1, 3, 2), ("b", "one", 2, 10, 10), ("c", "one", 0, 5, 0), ("d", "one", 5, -9, -2), ("a", "two", 0, 25, 15), ("d", "two", 1, 40, 0), ("d", "none", 0, 0, 0), ("b", None, 0, 1, 1)]
    canvases = {"one": (40, 25, 100), "two": (28, 19, 0), "bare": (9, 3, 7), None: (12, 12, 5)}
    layers = pieces(spark, made, lines).join(spark.createDataFrame(placed, "k string, canvas string, z int, x int, y int"), "k").drop("k").withColumnRenamed("canvas", "k")
    table = spark.createDataFrame([(k, w, h, [float(f)]) for k, (w, h, f) in canvases.items()], "k string, cw int, ch int, fill array<double>")
    want = {}
    for c, (w, h, fill) in canvases.items():
        out = np.full((h, w), fill)
        for k, _, _, x, y in sorted((p for p in placed if p[1] == c), key=lambda p: p[2]):
            x, y = max(x, 0), max(y, 0)
            part = made[k][: max(0, h - y), : max(0, w - x)]
            if part.size:
                out[y : y + part.shape[0], x : x + part.shape[1]] = part
        want[c] = out
    same(whole(resample.compose(table, layers, ["k"], tile)), want)


def test_nothing(spark):
    p = pieces(spark, planes(8, [(3, 3)]), 2).limit(0)
    assert resample.halve_chroma(p, ["k"]).collect() == [] and resample.resize_to_fit(p, ["k"], 2).collect() == []
