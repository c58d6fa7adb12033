"""Hand-worked cases of the sweep reports."""

import math

import pytest

from marlstone.operators import sweep
from marlstone.sources import results


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_summary_skips_what_is_missing(spark):
    runs = spark.createDataFrame([("a", "1.5"), ("a", ""), ("a", "2.5"), ("b", None)], "v string, psnr string")
    assert rows(sweep.variant_summary(runs, ["v"], ["psnr"])) == [("a", 3, 2.0), ("b", 1, None)]


def test_worst_follows_the_metric(spark):
    runs = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("a", 4.0, 5.0)], "v string, psnr double, lpips double")
    out = rows(sweep.metric_summary(runs, ["v"], {"psnr": True, "lpips": False}))
    assert out == [("a", "lpips", 3.0, 3.0, 5.0, 3), ("a", "psnr", round(8 / 3, 6), 3.0, 1.0, 3)]


def test_nearest_size_takes_the_first_on_a_tie(spark):
    left = spark.createDataFrame([("i", 1, 100), ("i", 2, 130), ("k", 3, 5)], "image string, id long, size long")
    right = spark.createDataFrame([("i", 8, 90), ("i", 7, 110), ("i", 9, 110)], "image string, id long, size long")
    out = {(r["lid"], r["rid"]) for r in sweep.nearest_size(left, right, ["image"], "size", "id", "id").collect()}
    assert out == {(1, 7), (2, 7)}


def test_interpolation_does_not_extrapolate(spark):
    curve = spark.createDataFrame([("i", 1.0, 10.0), ("i", 4.0, 20.0), ("k", 1.0, 5.0)], "image string, bpp double, psnr double")
    probes = spark.createDataFrame([("i", 2.0), ("i", 0.5), ("i", 5.0), ("i", 4.0), ("k", 1.0)], "image string, bpp double")
    out = {(r[0], r[1]): r[2] for r in sweep.interpolate(probes, curve, ["image"], "bpp", "psnr").collect()}
    assert out == {("i", 2.0): 15.0, ("i", 0.5): None, ("i", 5.0): None, ("i", 4.0): 20.0, ("k", 1.0): None}


def test_equal_rate_delta(spark):
    base = spark.createDataFrame([("i", 1.0, 10.0, 1.0), ("i", 4.0, 20.0, 2.0)], "image string, bpp double, psnr double, ssim double")
    runs = spark.createDataFrame([("i", "v", 2.0, 16.0, 1.0)], "image string, variant string, bpp double, psnr double, ssim double")
    out = {r["metric"]: r["delta"] for r in sweep.equal_rate_delta(runs, base, ["image"], "bpp", ["psnr", "ssim"], ["variant"]).collect()}
    assert out == {"psnr": 1.0, "ssim": -0.5}


def test_bd_rate_of_a_scaled_curve():
    rate, quality = [100, 200, 400, 800], [30.0, 33.0, 36.0, 39.0]
    assert sweep.bd_rate_of(rate, quality, [r * 1.1 for r in rate], quality) == pytest.approx(10.0)
    assert sweep.bd_rate_of(rate[:3], quality[:3], rate, quality) is None
    assert sweep.bd_rate_of(rate, quality, rate, [q + 100 for q in quality]) is None


def test_bd_rate_per_group(spark):
    points = [(v, r * f, q) for v, f in (("base", 1.0), ("half", 0.5), ("few", 1.0)) for r, q in zip([100.0, 200.0, 400.0, 800.0], [30.0, 33.0, 36.0, 39.0], strict=True) if v != "few" or r < 300]
    runs = spark.createDataFrame([("i", *p) for p in points], "image string, variant string, rate double, psnr double")
    out = {r["variant"]: r["bd_rate_pct"] for r in sweep.bd_rate(runs, ["image"], "variant", "base", "rate", "psnr").collect()}
    assert out["half"] == pytest.approx(-50.0) and out["few"] is None


def test_resume_is_idempotent(spark):
    grid = sweep.sweep_grid(spark.createDataFrame([("a",), ("b",)], "image string"), spark.createDataFrame([(22,), (27,)], "qp int"))
    done = grid.where("image = 'a'")
    assert rows(sweep.pending(grid, done, ["image", "qp"])) == [("b", 22), ("b", 27)]
    assert sweep.pending(grid, grid, ["image", "qp"]).count() == 0


def test_results_round_trip_keeps_infinite_quality(spark, tmp_path):
    (tmp_path / "r.csv").write_text("image,qp,encode_qp,psnr_rgb\na,22,,inf\nb,27,30,\n")
    out = rows(results.read_results(spark, str(tmp_path / "r.csv"), "image STRING, qp INT, encode_qp INT, psnr_rgb DOUBLE"))
    assert out == [("a", 22, 22, math.inf), ("b", 27, 30, None)]


def test_image_list_is_ordered_and_single(spark, tmp_path):
    for name in ("b.png", "a.jpg", "c.txt", "d.JPEG"):
        (tmp_path / name).write_bytes(b"x")
    out = [r["path"].rsplit("/", 1)[1] for r in results.list_images(spark, str(tmp_path), ["*.png", "*"]).collect()]
    assert out == ["b.png", "a.jpg", "d.JPEG"]


def test_counters_from_text(spark):
    lines = spark.createDataFrame([("x", "total_us=12 waits: 3")], "run string, value string")
    assert rows(results.counters_from_text(lines, ["total_us", "waits", "none"])) == [("x", 12.0, 3.0, None)]


def test_empty_tables(spark):
    runs = spark.createDataFrame([], "image string, variant string, rate double, psnr double, id long")
    assert sweep.variant_summary(runs, ["variant"], ["psnr"]).count() == 0
    assert sweep.nearest_size(runs, runs, ["image"], "rate", "id", "id").count() == 0
    assert sweep.interpolate(runs.select("image", "rate"), runs, ["image"], "rate", "psnr").count() == 0
    assert sweep.bd_rate(runs, ["image"], "variant", "b", "rate", "psnr").count() == 0
