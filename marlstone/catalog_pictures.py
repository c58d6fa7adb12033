"""Queries over pictures in pieces, with their SQL.

A page's code points, 48 in a line and in 256 shades, stand in for a picture, and the same
in fewer shades for its distorted copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.catalog import _query
from marlstone.operators import cells, panel, resample, tiles
from marlstone.session import table

WIDTH = 48


def _coarse(x: Column, i: Column) -> Column:
    return F.floor(x / 8) * 8 + i % 3


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    shades = F.transform(F.filter(F.split("html", ""), lambda c: c != ""), lambda c: F.ascii(c) % 256)
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit(WIDTH).alias("width"), shades.alias("a"))
    return rows.withColumns({"b": F.transform("a", _coarse), "cb": F.transform("a", lambda x: (x * 5 + 7) % 256), "cr": F.transform("a", lambda x: (x * 3 + 11) % 256)})


def _pieces(spark: SparkSession, sf_dir: str, *planes: str) -> DataFrame:
    return tiles.pieces_of(_pictures(spark, sf_dir), ["page_id"], "width", planes)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of planes a and b as ``_pieces`` gives them, but of many lines, and read from the text itself."""
    most = panel.WHOLE // WIDTH
    thirds = (np.arange(most * WIDTH) % 3).astype(np.uint8)
    for batch in tiles.sliced(batches, "html"):
        at, out, size, keys = [], [], 0, batch.select(["page_id"])
        for i, data in enumerate(batch.column("html").cast(pa.binary()).to_pylist()):
            text = (data or b"").decode("utf-8", "replace")
            h = -(-len(text) // WIDTH)
            for y in range(0, h, most):
                # The lowest byte of a code point is its shade.
                a = np.frombuffer(text[y * WIDTH : (y + most) * WIDTH].encode("utf-32-le"), np.uint8)[::4]
                ph = min(most, h - y)
                samples = np.zeros((2, ph * WIDTH), np.uint8)
                samples[0, : len(a)] = a
                # Lines, and so pieces, begin at multiples of 3.
                samples[1, : len(a)] = (a & 248) + thirds[: len(a)]
                at.append(i)
                out.append((WIDTH, h, 0, y, WIDTH, ph, 2, samples.tobytes(), []))
                size += samples.size
                if size >= tiles.SLICE_BYTES:
                    yield tiles._batch(keys.take(pa.array(at, pa.int64())), ["page_id"], out)
                    at, out, size = [], [], 0
        yield tiles._batch(keys.take(pa.array(at, pa.int64())), ["page_id"], out)


_SAMPLES = f"""l AS (SELECT page_id, list_transform(string_split(html, ''), lambda c: unicode(c) % 256) AS s, CAST(ceil(len(string_split(html, '')) / {WIDTH}.0) AS INTEGER) AS h FROM pages WHERE html <> ''),
u AS (SELECT page_id, h, s, unnest(range(0, h * {WIDTH})) AS i FROM l),
p0 AS (SELECT page_id, {WIDTH} AS w, h, i % {WIDTH} AS x, i // {WIDTH} AS y, coalesce(s[i + 1], 0) AS a, CASE WHEN i < len(s) THEN s[i + 1] // 8 * 8 + i % 3 ELSE 0 END AS b,
  CASE WHEN i < len(s) THEN (s[i + 1] * 5 + 7) % 256 ELSE 0 END AS cb, CASE WHEN i < len(s) THEN (s[i + 1] * 3 + 11) % 256 ELSE 0 END AS cr FROM u)"""


def _mirror(at: str, size: str) -> str:
    turned = f"((({at}) % (2 * {size}) + 2 * {size}) % (2 * {size}))"
    return f"CASE WHEN {turned} < {size} THEN {turned} ELSE 2 * {size} - 1 - {turned} END"


def _window(name: str, width: float, reach: int) -> str:
    return f"{name} AS (SELECT k, exp(-0.5 * (k / {width}) ** 2) / sum(exp(-0.5 * (k / {width}) ** 2)) OVER () AS g FROM (SELECT unnest(range(-{reach}, {reach} + 1)) AS k))"


def _smooth(out: str, source: str, taps: str, columns: dict[str, str]) -> str:
    """Two passes of a separable window, mirrored at the edges."""
    first = ", ".join(f"sum(g * ({e})) AS {n}" for n, e in columns.items())
    second = ", ".join(f"sum(g * q.{n}) AS {n}" for n in columns)
    # Places are worked out before the join, so that it is one of equal values.
    return f"""{out}_x AS (SELECT p.page_id, p.w, p.h, p.x, p.y, {first} FROM (SELECT s.page_id, w, h, x, y, g, {_mirror('x + k', 'w')} AS pos FROM {source} s, {taps}) p JOIN {source} q ON q.page_id = p.page_id AND q.y = p.y AND q.x = p.pos GROUP BY ALL),
{out} AS (SELECT p.page_id, p.w, p.h, p.x, p.y, {second} FROM (SELECT s.page_id, w, h, x, y, g, {_mirror('y + k', 'h')} AS pos FROM {out}_x s, {taps}) p JOIN {out}_x q ON q.page_id = p.page_id AND q.x = p.x AND q.y = p.pos GROUP BY ALL)"""


_MOMENTS = {"ma": "q.a", "mb": "q.b", "aa": "q.a * q.a", "bb": "q.b * q.b", "ab": "q.a * q.b"}


def _ms_ssim_sql(scales: int) -> str:
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    parts = [_SAMPLES, _window("taps", panel.WINDOW, panel.REACH)]
    for s in range(scales):
        parts.append(_smooth(f"m{s}", f"p{s}", "taps", _MOMENTS))
        parts.append(f"""v{s} AS (SELECT page_id, {s} AS s, avg(cs) AS cs, avg(cs * (2 * ma * mb + {c1}) / (ma * ma + mb * mb + {c1})) AS ssim FROM
  (SELECT *, (2 * (ab - ma * mb) + {c2}) / (aa - ma * ma + bb - mb * mb + {c2}) AS cs FROM m{s}) GROUP BY page_id)""")
        parts.append(f"p{s + 1} AS (SELECT page_id, w // 2 AS w, h // 2 AS h, x // 2 AS x, y // 2 AS y, avg(a) AS a, avg(b) AS b FROM p{s} WHERE x < w // 2 * 2 AND y < h // 2 * 2 AND least(w // 2, h // 2) >= 11 GROUP BY ALL)")
    parts[0] = parts[0].replace("FROM pages WHERE", "FROM pages WHERE len(string_split(html, '')) > 10 * 48 AND")
    weights = panel.SCALE_WEIGHTS
    held = " UNION ALL ".join(f"SELECT * FROM v{s}" for s in range(scales))
    terms = "CASE s " + " ".join(f"WHEN {s} THEN {weights[s]}" for s in range(scales)) + " END"
    return f"""WITH {', '.join(parts)}, v AS (SELECT *, {terms} AS weight, max(s) OVER (PARTITION BY page_id) AS last, sum({terms}) OVER (PARTITION BY page_id) AS whole FROM ({held})),
r AS (SELECT page_id, CAST(max(s) + 1 AS INTEGER) AS scales, exp(sum(weight / whole * ln(greatest(CASE WHEN s = last THEN ssim ELSE cs END, 1e-8)))) AS v FROM v GROUP BY page_id)
SELECT page_id, coalesce(scales, 0) AS scales, round(v, 5) AS ms_ssim, round(-10 * log10(1 - v), 4) AS ms_ssim_db FROM pages LEFT JOIN r USING (page_id) WHERE html <> ''"""


@_query(_ms_ssim_sql(3))
def k1_multi_scale_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are shuffled, as a table of a few row groups is read by a few tasks.
    rows = table(spark, sf_dir, "pages").select("page_id", "html").repartition("page_id")
    out = panel.multi_scale_similarity(rows, ["page_id"], tile=80, cut=_cut)
    return out.select("page_id", "scales", F.round("ms_ssim", 5).alias("ms_ssim"), F.round("ms_ssim_db", 4).alias("ms_ssim_db"))


def _vif_sql() -> str:
    parts = [_SAMPLES]
    for s, (width, reach) in enumerate(panel.VISUAL_WINDOWS):
        parts.append(_window(f"taps{s}", width, reach))
        if s:
            parts.append(_smooth(f"f{s}", f"p{s - 1}", f"taps{s}", {"a": "q.a", "b": "q.b"}))
            parts.append(f"p{s} AS (SELECT page_id, (w + 1) // 2 AS w, (h + 1) // 2 AS h, x // 2 AS x, y // 2 AS y, a, b FROM f{s} WHERE x % 2 = 0 AND y % 2 = 0 AND least((w + 1) // 2, (h + 1) // 2) >= 2)")
        parts.append(_smooth(f"m{s}", f"p{s}", f"taps{s}", _MOMENTS))
        parts.append(f"""v{s} AS (SELECT page_id, sum(log10(1 + gain * gain * va / (rest + 2))) AS num, sum(log10(1 + va / 2)) AS den FROM (
  SELECT page_id, CASE WHEN s1 < 1e-10 OR s2 < 1e-10 THEN 0 ELSE s12 / (s1 + 1e-10) END AS gain, CASE WHEN s1 < 1e-10 THEN 0 ELSE s1 END AS va,
    greatest(CASE WHEN s2 < 1e-10 THEN 0 WHEN s1 < 1e-10 THEN s2 ELSE s2 - s12 / (s1 + 1e-10) * s12 END, 1e-10) AS rest
  FROM (SELECT page_id, greatest(aa - ma * ma, 0) AS s1, greatest(bb - mb * mb, 0) AS s2, ab - ma * mb AS s12 FROM m{s})) GROUP BY page_id)""")
    held = " UNION ALL ".join(f"SELECT * FROM v{s}" for s in range(len(panel.VISUAL_WINDOWS)))
    return f"WITH {', '.join(parts)} SELECT page_id, round(CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END, 5) AS vif FROM ({held}) GROUP BY page_id"


@_query(_vif_sql())
def k3_visual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.visual_information(_pieces(spark, sf_dir, "a", "b"), ["page_id"], tile=64)
    return out.select("page_id", F.round("vif", 5).alias("vif"))


_SENSITIVITY = ", ".join(f"({v}, {u}, {x})" for v, row in enumerate(panel.SENSITIVITY) for u, x in enumerate(row))


@_query(f"""WITH {_SAMPLES}, d AS (SELECT u, x, sqrt(CASE u WHEN 0 THEN 1 ELSE 2 END / 8.0) * cos(pi() * (2 * x + 1) * u / 16) AS d FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS x)),
  csf(v, u, c) AS (VALUES {_SENSITIVITY}),
  r AS (SELECT page_id, p.x // 8 AS bx, y, u, sum(d * a) AS a, sum(d * b) AS b FROM p0 p JOIN d ON d.x = p.x % 8 WHERE y < h // 8 * 8 GROUP BY ALL),
  t AS (SELECT page_id, bx, y // 8 AS bb, r.u, d.u AS v, sum(d * a) AS a, sum(d * b) AS b FROM r JOIN d ON d.x = r.y % 8 GROUP BY ALL),
  m AS (SELECT *, sqrt(greatest(sum(CASE WHEN u + v > 0 THEN (a * c) ** 2 ELSE 0 END) OVER (PARTITION BY page_id, bx, bb), sum(CASE WHEN u + v > 0 THEN (b * c) ** 2 ELSE 0 END) OVER (PARTITION BY page_id, bx, bb)) / 64) / 16 AS hidden FROM t JOIN csf USING (u, v)),
  e AS (SELECT page_id, avg((c * CASE WHEN u + v = 0 THEN abs(a - b) ELSE greatest(abs(a - b) - hidden, 0) END) ** 2) AS e FROM m GROUP BY page_id)
SELECT page_id, round(10 * log10(65025 / e), 4) AS psnr_hvs_m FROM pages LEFT JOIN e USING (page_id) WHERE html <> ''""")
def k4_masked_block_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel.masked_block_error(_pieces(spark, sf_dir, "a", "b"), ["page_id"], tile=64)
    return out.select("page_id", F.round("psnr_hvs_m", 4).alias("psnr_hvs_m"))


_GRADIENTS = f"""{_SAMPLES}, o AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
n AS (SELECT p.page_id, p.x, p.y, p.a, p.cb, p.cr, sum(i * (2 - abs(j)) * q.a) AS gx, sum(j * (2 - abs(i)) * q.a) AS gy, CAST(sum(q.a) AS BIGINT) // 9 AS box
  FROM (SELECT p0.*, i, j, greatest(least(x + i, w - 1), 0) AS px, greatest(least(y + j, h - 1), 0) AS py FROM p0, o) p JOIN p0 q ON q.page_id = p.page_id AND q.x = p.px AND q.y = p.py GROUP BY ALL),
g AS (SELECT page_id, x // 32 AS cx, y // 32 AS cy, a, cb, cr, abs(gx) + abs(gy) AS grad, abs(a - box) AS res, CASE WHEN abs(gx) >= 2 * abs(gy) THEN 0 WHEN abs(gy) >= 2 * abs(gx) THEN 1 WHEN (gx > 0) = (gy > 0) THEN 2 ELSE 3 END AS bin FROM n),
s AS (SELECT page_id, cx, cy, count(*) AS n, sum(a)::BIGINT AS t, sum(a * a)::BIGINT AS q, count(*) FILTER (grad > 48) AS edges, count(*) FILTER (grad < 12) AS flats, count(*) FILTER (grad < 24) AS weaks,
  coalesce(sum(res) FILTER (grad < 24), 0)::BIGINT AS residual, {', '.join(f'count(*) FILTER (grad > 48 AND bin = {k}) AS d{k}' for k in range(4))},
  sum(cb)::BIGINT AS tb, sum(cb * cb)::BIGINT AS qb, sum(cr)::BIGINT AS tr, sum(cr * cr)::BIGINT AS qr FROM g GROUP BY ALL),
c AS (SELECT page_id, cx, cy, t // n AS mean, greatest(q // n - (t // n) * (t // n), 0) AS variance, edges * 256 // n AS edge, flats * 256 // n AS flat, CASE WHEN weaks > 0 THEN residual // weaks ELSE 0 END AS noise,
  CAST(round(({' + '.join(f'CASE WHEN d{k} > 0 THEN -(d{k} / edges) * log2(d{k} / edges) ELSE 0 END' for k in range(4))}) / 2 * 256) AS BIGINT) AS entropy,
  greatest(d0, d1, d2, d3) * 256 // greatest(edges, 1) AS dominance, (d0 + d1) * 256 // greatest(edges, 1) AS aligned,
  least(greatest(qb // n - (tb // n) * (tb // n), 0) + greatest(qr // n - (tr // n) * (tr // n), 0), 65535) AS chroma, tb // n AS cb_mean, tr // n AS cr_mean FROM s)"""
_CLASSED = f"""{_GRADIENTS}, k AS (SELECT *, CASE WHEN edge >= 64 AND entropy < 110 AND aligned >= 160 AND noise < 7 THEN 'text_like' WHEN edge >= 38 AND dominance >= 128 THEN 'directional_edge' WHEN noise >= 7 AND variance < 64 THEN 'noisy'
  WHEN variance >= 64 AND entropy >= 150 THEN 'texture' WHEN variance < 12 AND edge < 13 THEN 'flat' WHEN edge < 26 THEN 'gradient' WHEN chroma >= 96 THEN 'chroma_critical' ELSE 'texture' END AS region FROM c)"""
_FEATURES = ["page_id", "cx", "cy", "mean", "variance", "edge", "flat", "noise", "entropy", "dominance", "aligned", "chroma", "cb_mean", "cr_mean", "region"]


@_query(f"WITH {_CLASSED} SELECT {', '.join(_FEATURES)} FROM k")
def agg17_cell_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cells.local_features(_pieces(spark, sf_dir, "a"), ["page_id"], _pieces(spark, sf_dir, "cb", "cr"), "444", tile=64)
    return out.select(*[F.col(c).cast("long") if c in ("cx", "cy") else F.col(c) for c in _FEATURES])


@_query(f"""WITH {_CLASSED}, f AS (SELECT page_id, sum(mean)::BIGINT // count(*) AS m, sum(cb_mean)::BIGINT // count(*) AS b, sum(cr_mean)::BIGINT // count(*) AS r FROM k GROUP BY page_id),
  e AS (SELECT a.page_id, a.cx, a.cy, sum(z.mean)::BIGINT // count(*) AS m, sum(z.cb_mean)::BIGINT // count(*) AS b, sum(z.cr_mean)::BIGINT // count(*) AS r FROM k a JOIN k z ON z.page_id = a.page_id AND abs(a.cx - z.cx) <= 1 AND abs(a.cy - z.cy) <= 1 AND (a.cx <> z.cx OR a.cy <> z.cy) GROUP BY ALL),
  v AS (SELECT k.*, least(2 * (abs(mean - f.m) + abs(cb_mean - f.b) + abs(cr_mean - f.r)), 256) AS global_contrast, coalesce(least(2 * (abs(mean - e.m) + abs(cb_mean - e.b) + abs(cr_mean - e.r)), 256), 0) AS surround FROM k JOIN f USING (page_id) LEFT JOIN e USING (page_id, cx, cy))
SELECT page_id, cx, cy, global_contrast, surround, CAST(greatest(least(edge // 2 + greatest(global_contrast, surround) + CASE WHEN region IN ('directional_edge', 'text_like') THEN 96 WHEN region = 'texture' THEN 32 ELSE 0 END - CASE WHEN noise >= 7 THEN 96 ELSE 0 END, 256), 0) AS INTEGER) AS importance FROM v""")
def agg17_cell_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells.local_features(_pieces(spark, sf_dir, "a"), ["page_id"], _pieces(spark, sf_dir, "cb", "cr"), "444")
    out = cells.with_context(found, ["page_id"])
    return out.select("page_id", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "global_contrast", "surround", "importance")


@_query(f"""WITH {_SAMPLES}, s AS (SELECT page_id, x // 16 AS cx, y // 16 AS cy, count(*) AS n, sum(a)::BIGINT AS t, sum(a * a)::BIGINT AS q, sum(cb)::BIGINT AS tb, sum(cb * cb)::BIGINT AS qb, sum(cr)::BIGINT AS tr, sum(cr * cr)::BIGINT AS qr FROM p0 GROUP BY ALL)
SELECT page_id, cx, cy, greatest(q // n - (t // n) * (t // n), 0) AS variance, least(greatest(qb // n - (tb // n) * (tb // n), 0) + greatest(qr // n - (tr // n) * (tr // n), 0), 65535) AS chroma FROM s""")
def agg19_fine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cells.fine_features(_pieces(spark, sf_dir, "a"), ["page_id"], _pieces(spark, sf_dir, "cb", "cr"), "444", tile=32)
    return out.select("page_id", F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "variance", "chroma")


def _digest(pieces: DataFrame) -> DataFrame:
    """Per picture: samples, their sum, and their sum weighed by place."""
    rows = resample.samples_of(pieces, ["page_id"])
    v = F.col("v0").cast("long")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * ((F.col("x") * 7 + F.col("y") * 13) % 101)).alias("weighed"))


def _digest_sql(samples: str) -> str:
    return f"SELECT page_id, count(*) AS n, sum(v)::BIGINT AS total, sum(v * ((x * 7 + y * 13) % 101))::BIGINT AS weighed FROM {samples} GROUP BY page_id"


_HALVED = f"""{_SAMPLES}, t AS (SELECT unnest(range(-4, 6)) AS k, unnest({resample.HALVING.tolist()}) AS c),
r AS (SELECT o.page_id, o.w, o.h, o.x, o.y, (CAST(sum(c * q.cb) AS BIGINT) + 1) >> 1 AS v FROM (SELECT *, greatest(least(2 * x + k, w - 1), 0) AS pos FROM (SELECT DISTINCT page_id, w, h, x // 2 AS x, y FROM p0), t) o JOIN p0 q ON q.page_id = o.page_id AND q.y = o.y AND q.x = o.pos GROUP BY ALL),
z AS (SELECT o.page_id, o.w, o.h, o.x, o.y, greatest(least((CAST(sum(c * q.v) AS BIGINT) + 4096) >> 13, 255), 0) AS v FROM (SELECT *, greatest(least(2 * y + k, h - 1), 0) AS pos FROM (SELECT DISTINCT page_id, w, h, x, y // 2 AS y FROM r), t) o JOIN r q ON q.page_id = o.page_id AND q.x = o.x AND q.y = o.pos GROUP BY ALL)"""


@_query(f"WITH {_HALVED} {_digest_sql('z')}")
def k8_halved_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(resample.halve_chroma(_pieces(spark, sf_dir, "cb"), ["page_id"], "420", tile=40))


def _doubling(place: str) -> str:
    taps = resample.DOUBLING.tolist()
    return f"CASE WHEN {place} % 2 = 0 THEN {taps[::-1]}[k + 4] ELSE {taps}[k + 4] END"


@_query(f"""WITH {_HALVED}, s AS (SELECT unnest(range(-3, 4)) AS k),
d AS (SELECT p.page_id, p.x, p.y, CAST(sum({_doubling('p.y')} * q.v) AS BIGINT) AS v FROM (SELECT *, greatest(least(y // 2 + k, (h + 1) // 2 - 1), 0) AS pos FROM (SELECT DISTINCT page_id, h, x // 2 AS x, y FROM p0), s) p JOIN z q ON q.page_id = p.page_id AND q.x = p.x AND q.y = p.pos GROUP BY ALL),
e AS (SELECT p.page_id, p.x, p.y, greatest(least((CAST(sum({_doubling('p.x')} * q.v) AS BIGINT) + 2048) >> 12, 255), 0) AS v FROM (SELECT p0.*, k, greatest(least(x // 2 + k, (w + 1) // 2 - 1), 0) AS pos FROM p0, s) p JOIN d q ON q.page_id = p.page_id AND q.y = p.y AND q.x = p.pos GROUP BY ALL)
{_digest_sql('e')}""")
def k9_doubled_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _pieces(spark, sf_dir, "cb")
    half = resample.halve_chroma(full, ["page_id"], "420")
    sizes = full.groupBy("page_id").agg(F.max("w").alias("full_w"), F.max("h").alias("full_h"))
    return _digest(resample.double_chroma(half.join(sizes, "page_id"), ["page_id"], F.col("full_w"), F.col("full_h"), "420", tile=40))


def _lanczos(out: str, source: str, axis: str, size: str, other: str) -> str:
    """One pass of a windowed sinc along an axis, edges repeated."""
    return f"""{out}_g AS (
  SELECT page_id, o, greatest(least(i, {size} - 1), 0) AS held, CASE WHEN abs(d) >= 3 THEN 0 WHEN abs(d) < 1e-9 THEN 1 ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS g FROM (
    SELECT page_id, {size}, o, i, (c - i) / step AS d FROM (SELECT page_id, {size}, o, step, c, unnest(range(CAST(floor(c - 3 * step) AS BIGINT), CAST(ceil(c + 3 * step) AS BIGINT) + 1)) AS i FROM (
      SELECT page_id, {size}, o, {size} * 1.0 / n{size} AS step, (o + 0.5::DOUBLE) * ({size}::DOUBLE / n{size}) - 0.5 AS c FROM (SELECT page_id, {size}, n{size}, unnest(range(0, n{size})) AS o FROM n))))),
{out}_w AS (SELECT page_id, o, held AS i, g / sum(g) OVER (PARTITION BY page_id, o) AS g FROM {out}_g),
{out} AS (SELECT s.page_id, o AS {axis}, s.{other}, sum(g * s.v) AS v FROM {out}_w t JOIN {source} s ON s.page_id = t.page_id AND s.{axis} = t.i GROUP BY ALL)"""


@_query(f"""WITH {_SAMPLES}, n AS (SELECT DISTINCT page_id, w, h, CAST(greatest(round(w * (20.0::DOUBLE / greatest(w, h))), 1) AS BIGINT) AS nw, CAST(greatest(round(h * (20.0::DOUBLE / greatest(w, h))), 1) AS BIGINT) AS nh FROM p0),
s AS (SELECT page_id, x, y, a AS v FROM p0), {_lanczos('across', 's', 'x', 'w', 'y')}, {_lanczos('down', 'across', 'y', 'h', 'x')}, f AS (SELECT page_id, x, y, greatest(least(floor(v + 0.5), 255), 0) AS v FROM down)
{_digest_sql('f')}""")
def k10_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(resample.resize_to_fit(_pieces(spark, sf_dir, "a"), ["page_id"], 20, tile=16))


@_query(f"""WITH {_SAMPLES}, q AS (SELECT page_id // 10 AS canvas, page_id % 10 AS z, greatest(page_id * 17 % 90 - 20, 0) + x AS x, greatest(page_id * 29 % 110 - 20, 0) + y AS y, a AS v FROM p0),
c AS (SELECT DISTINCT canvas, unnest(range(100)) AS x FROM q), g AS (SELECT canvas, x, unnest(range(120)) AS y FROM c),
v AS (SELECT canvas, x, y, arg_max(v, z) AS v FROM q WHERE x < 100 AND y < 120 GROUP BY ALL)
SELECT canvas AS page_id, count(*) AS n, sum(coalesce(v, 9))::BIGINT AS total, sum(coalesce(v, 9) * ((x * 7 + y * 13) % 101))::BIGINT AS weighed FROM g LEFT JOIN v USING (canvas, x, y) GROUP BY canvas""")
def k16_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    layers = _pieces(spark, sf_dir, "a").withColumns({"x": i * 17 % 90 - 20, "y": i * 29 % 110 - 20, "z": i % 10, "page_id": F.floor(i / 10)})
    canvases = layers.select("page_id").distinct().withColumns({"cw": F.lit(100), "ch": F.lit(120), "fill": F.array(F.lit(9.0))})
    return _digest(resample.compose(canvases, layers, ["page_id"], tile=32))
