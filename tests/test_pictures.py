"""Pictures in pieces: equal with any tiling, and equal to plain work on the whole picture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.scalars import dct_basis
from marlstone.operators import cells, panel, tiles


def picture(seed, h, w, kind="noise"):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    a = {"noise": r.integers(0, 256, (h, w)), "flat": np.full((h, w), 90), "waves": (127 + 90 * np.sin(x / 5) * np.cos(y / 7)).astype(int), "edges": ((x // 11 + y // 13) % 2) * 200 + r.integers(0, 9, (h, w))}[kind]
    return a.astype(np.float64)


def pieces(spark, pictures, lines):
    rows = [(k, p[0].shape[1], *[x.ravel().tolist() for x in p]) for k, p in pictures.items()]
    names = [f"p{i}" for i in range(len(next(iter(pictures.values()))))]
    table = spark.createDataFrame(rows, "k string, wide int, " + ", ".join(f"{n} array<double>" for n in names))
    return tiles.pieces_of(table, ["k"], "wide", names, lines)


def filtered(a, width, reach):
    return panel.smoothed(np.pad(a, reach, mode="symmetric"), width, reach)


def whole_moments(a, b, width, reach):
    ma, mb = filtered(a, width, reach), filtered(b, width, reach)
    return ma, mb, filtered(a * a, width, reach) - ma**2, filtered(b * b, width, reach) - mb**2, filtered(a * b, width, reach) - ma * mb


def whole_similarity(a, b):
    cs, ssim = [], None
    for _ in range(5):
        if min(a.shape) < 11:
            break
        ma, mb, va, vb, cov = whole_moments(a, b, 1.5, 5)
        c = (2 * cov + (0.03 * 255) ** 2) / (va + vb + (0.03 * 255) ** 2)
        ssim = float((c * (2 * ma * mb + (0.01 * 255) ** 2) / (ma**2 + mb**2 + (0.01 * 255) ** 2)).mean())
        cs.append(float(c.mean()))
        a, b = (x[: x.shape[0] // 2 * 2, : x.shape[1] // 2 * 2].reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean(axis=(1, 3)) for x in (a, b))
    if not cs:
        return 0, None
    weights = np.array(panel.SCALE_WEIGHTS[: len(cs)])
    terms = np.array([*cs[:-1], ssim]).clip(1e-8)
    return len(cs), float(np.prod(terms ** (weights / weights.sum())).clip(0, 1))


def whole_information(a, b):
    num = den = 0.0
    for s, (width, reach) in enumerate(panel.VISUAL_WINDOWS):
        if s:
            a, b = (filtered(x, width, reach)[::2, ::2] for x in (a, b))
        if min(a.shape) < 2:
            break
        _, _, va, vb, cov = whole_moments(a, b, width, reach)
        va, vb = va.clip(0), vb.clip(0)
        for v, w, c in zip(va.ravel(), vb.ravel(), cov.ravel(), strict=True):
            g, rest = (0.0, w) if v < 1e-10 else (c / (v + 1e-10), w - c / (v + 1e-10) * c)
            v = 0.0 if v < 1e-10 else v
            if w < 1e-10:
                g, rest = 0.0, 0.0
            num += math.log10(1 + g * g * v / (max(rest, 1e-10) + 2))
            den += math.log10(1 + v / 2)
    return num / den if den > 0 else None


def whole_block_error(a, b):
    d, weight, error, n = np.array(dct_basis(8)), np.array(panel.SENSITIVITY), 0.0, 0
    for y in range(0, a.shape[0] - 7, 8):
        for x in range(0, a.shape[1] - 7, 8):
            p, q = (d @ m[y : y + 8, x : x + 8] @ d.T for m in (a, b))
            energy = max(sum((c[v, u] * weight[v, u]) ** 2 for v in range(8) for u in range(8) if v + u) for c in (p, q))
            hidden = math.sqrt(energy / 64) / 16
            seen = np.abs(p - q)
            first = seen[0, 0]
            seen = np.where(seen < hidden, 0, seen - hidden)
            seen[0, 0] = first
            error, n = error + float(((seen * weight) ** 2).sum()), n + 64
    return None if not n else math.inf if error <= 0 else 10 * math.log10(65025 * n / error)


@pytest.fixture(scope="module")
def pairs():
    r = np.random.default_rng(1)
    made = {}
    for i, (kind, h, w) in enumerate([("noise", 37, 61), ("waves", 190, 181), ("edges", 176, 97), ("flat", 24, 40), ("noise", 10, 90), ("waves", 1, 30), ("waves", 11, 11), ("noise", 7, 8)]):
        a = picture(i, h, w, kind)
        made[f"{kind}{h}x{w}"] = (a, (a + r.normal(0, 6, a.shape)).round())
    made["same"] = (picture(9, 33, 50), picture(9, 33, 50))
    made["shifted"] = (picture(8, 32, 48, "waves"), picture(8, 32, 48, "waves") + 5)
    return made


@pytest.mark.parametrize(("tile", "lines"), [(128, 64), (80, 7), (16, 500)])
def test_panel_equals_whole_pictures(spark, pairs, tile, lines):
    if tile == 16:
        pairs = {k: v for k, v in pairs.items() if v[0].size < 3_000}
    p = pieces(spark, pairs, lines)
    ssim = {r["k"]: r for r in panel.multi_scale_similarity(p, ["k"], tile=tile).collect()}
    vif = {r["k"]: r["vif"] for r in panel.visual_information(p, ["k"], tile=tile).collect()}
    hvs = {r["k"]: r["psnr_hvs_m"] for r in panel.masked_block_error(p, ["k"], tile=tile).collect()}
    assert set(ssim) == set(vif) == set(hvs) == set(pairs)
    for k, (a, b) in pairs.items():
        scales, value = whole_similarity(a, b)
        assert ssim[k]["scales"] == scales and ssim[k]["ms_ssim"] == (value if value is None else pytest.approx(value, abs=1e-9)), k
        want = whole_information(a, b)
        assert vif[k] == (want if want is None else pytest.approx(want, abs=1e-9)), k
        want = whole_block_error(a, b)
        assert hvs[k] == (want if want is None or want == math.inf else pytest.approx(want, abs=1e-9)), k
    assert ssim["same"]["ms_ssim"] == pytest.approx(1, abs=1e-12) and hvs["same"] == math.inf and vif["same"] == pytest.approx(1, abs=1e-6)


def test_a_flat_picture_has_no_information_and_a_shift_has_no_masking(spark, pairs):
    flat = picture(0, 40, 40, "flat")
    p = pieces(spark, {"flat": (flat, flat + np.arange(40)), "up": (flat, flat + 4)}, 9)
    assert {r["vif"] for r in panel.visual_information(p, ["k"]).collect()} == {None}
    up = {r["k"]: r["psnr_hvs_m"] for r in panel.masked_block_error(p, ["k"]).collect()}["up"]
    # Only the mean differs, by 4 * 8 in an orthonormal block.
    assert up == pytest.approx(10 * math.log10(65025 * 64 / (32 * panel.SENSITIVITY[0][0]) ** 2))


def whole_cells(luma, cb, cr, cell, cw, ch):
    h, w = luma.shape
    p = np.pad(luma.astype(int), 1, mode="edge")
    out = {}
    for cy in range(-(-h // cell)):
        for cx in range(-(-w // cell)):
            n = edges = flats = weaks = residual = 0
            bins, own = [0] * 4, []
            for y in range(cy * cell, min(h, cy * cell + cell)):
                for x in range(cx * cell, min(w, cx * cell + cell)):
                    k = p[y : y + 3, x : x + 3]
                    gx = int(k[0, 2] + 2 * k[1, 2] + k[2, 2] - k[0, 0] - 2 * k[1, 0] - k[2, 0])
                    gy = int(k[2, 0] + 2 * k[2, 1] + k[2, 2] - k[0, 0] - 2 * k[0, 1] - k[0, 2])
                    g, n = abs(gx) + abs(gy), n + 1
                    own.append(int(k[1, 1]))
                    edges, flats = edges + (g > 48), flats + (g < 12)
                    if g > 48:
                        bins[0 if abs(gx) >= 2 * abs(gy) else 1 if abs(gy) >= 2 * abs(gx) else 2 if (gx > 0) == (gy > 0) else 3] += 1
                    if g < 24:
                        weaks, residual = weaks + 1, residual + abs(int(k[1, 1]) - int(k.sum()) // 9)
            var = lambda v: max(0, sum(i * i for i in v) // len(v) - (sum(v) // len(v)) ** 2)
            planes = [c[cy * ch : cy * ch + ch, cx * cw : cx * cw + cw].astype(int).ravel().tolist() for c in (cb, cr)] if cb is not None else []
            chroma = (min(65535, sum(map(var, planes))), *(sum(v) // len(v) for v in planes)) if all(planes) and planes else (0, 128, 128) if cb is None else (0, 0, 0)
            total = max(1, sum(bins))
            entropy = -sum(b / total * math.log2(b / total) for b in bins if b)
            out[cx, cy] = (sum(own) // n, var(own), edges * 256 // n, flats * 256 // n, residual // weaks if weaks else 0, math.floor(entropy * 128 + 0.5), max(bins) * 256 // total, (bins[0] + bins[1]) * 256 // total, *chroma)
    return out


@pytest.mark.parametrize(("fmt", "cw", "ch", "tile", "lines"), [("gray", 0, 0, 128, 64), ("420", 16, 16, 32, 5), ("422", 16, 32, 64, 200), ("444", 32, 32, 96, 33)])
def test_cells_equal_whole_pictures(spark, fmt, cw, ch, tile, lines):
    shapes = {"noise": (50, 70), "edges": (97, 65), "waves": (33, 32), "flat": (5, 3)}
    luma = {k: (picture(i, *s, k),) for i, (k, s) in enumerate(shapes.items())}
    size = lambda h, w: (-(-h // 2) if fmt == "420" else h, w if fmt == "444" else -(-w // 2))
    chroma = None if fmt == "gray" else {k: tuple(picture(i + 10 * j, *size(*s)) for j in (1, 2)) for i, (k, s) in enumerate(shapes.items())}
    got = cells.local_features(pieces(spark, luma, lines), ["k"], chroma and pieces(spark, chroma, lines), fmt, tile=tile)
    names = ["mean", "variance", "edge", "flat", "noise", "entropy", "dominance", "aligned", "chroma", "cb_mean", "cr_mean"]
    rows = {(r["k"], r["cx"], r["cy"]): tuple(r[n] for n in names) for r in got.collect()}
    want = {(k, *c): v for k, p in luma.items() for c, v in whole_cells(p[0], *(chroma[k] if chroma else (None, None)), 32, cw, ch).items()}
    assert rows == want
    fine = cells.fine_features(pieces(spark, luma, lines), ["k"], chroma and pieces(spark, chroma, lines), fmt, tile=tile).collect()
    small = {(k, *c): (v[1], v[8]) for k, p in luma.items() for c, v in whole_cells(p[0], *(chroma[k] if chroma else (None, None)), 16, cw // 2, ch // 2).items()}
    assert {(r["k"], r["cx"], r["cy"]): (r["variance"], r["chroma"]) for r in fine} == small


def test_regions_and_importance(spark):
    """Stripes of one sample are an edge class that a flat half is not, and what stands out is important."""
    stripes = np.full((64, 128), 128.0)
    stripes[:, 64:] = np.where(np.arange(64) // 2 % 2, 255, 0)
    found = cells.local_features(pieces(spark, {"s": (stripes,)}, 20), ["k"])
    out = {(r["cx"], r["cy"]): r for r in cells.with_context(found, ["k"]).collect()}
    assert out[0, 0]["region"] == "flat" and out[0, 0]["importance"] < out[3, 1]["importance"]
    assert out[3, 0]["region"] in ("text_like", "directional_edge") and out[3, 0]["dominance"] == 256
    ten = cells.local_features(pieces(spark, {"s": (stripes * 4 + 3,)}, 20), ["k"], depth=10)
    assert {(r["cx"], r["cy"]): r["variance"] for r in ten.collect()} == {c: r["variance"] for c, r in out.items()}


def test_pieces_of_odd_pictures(spark):
    rows = [("a", 3, [1.0, 2.0, 3.0, 4.0]), ("b", 0, [1.0]), ("c", 2, []), ("d", None, [1.0]), ("e", 2, None), (None, 2, [7.0, None])]
    p = tiles.pieces_of(spark.createDataFrame(rows, "k string, wide int, s array<double>"), ["k"], "wide", ["s"], 1)
    out = cells.fine_features(p.withColumn("tx", F.lit("x")), ["k"]).collect()
    assert sorted((str(r["k"]), r["variance"]) for r in out) == [("None", 49 // 2 - 9), ("a", 30 // 6 - 1)]
    assert p.where("k = 'a'").count() == 2
    assert cells.local_features(p.limit(0), ["k"]).collect() == []
