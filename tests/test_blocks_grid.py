"""Hand-worked cases of block and grid reports and scalar functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import blocks8, scalars
from marlstone.operators import blocks, grid


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_winner_rank_takes_the_first_of_a_tie(spark):
    rows = [(1, 1, 5.0), (1, 2, 3.0), (1, 3, 3.0), (2, 1, 4.0), (3, 1, 9.0), (3, 2, float("inf"))]
    out = {r["d"]: tuple(r)[1:] for r in blocks.winner_ranks(spark.createDataFrame(rows, "d int, pos int, cost double"), ["d"], "cost", "pos").collect()}
    assert out == {1: (2, 3.0, 3.0, 3), 2: (1, 4.0, 4.0, 1), 3: (1, 9.0, 9.0, 2)}


def test_flips_need_all_second_costs(spark):
    rows = [(1, 1, 1.0, 2.0), (1, 2, 2.0, 1.0), (2, 1, 1.0, float("nan")), (2, 2, 2.0, 1.0), (3, 1, 1.0, 1.0), (3, 2, 2.0, 2.0)]
    out = {r["d"]: r["flipped"] for r in blocks.winner_flips(spark.createDataFrame(rows, "d int, pos int, c double, c2 double"), ["d"], "c", "c2", "pos").collect()}
    assert out == {1: True, 2: None, 3: False}


def test_counters_merge_place_by_place(spark):
    parts = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3, 4]), ("b", 5, [])], "k string, n int, h array<int>")
    out = {r["k"]: (r["n"], r["h"]) for r in blocks.merge_counters(parts, ["k"], ["n"], ["h"]).collect()}
    assert out == {"a": (3, [4, 6]), "b": (5, None)}


def test_offset_map_text(spark):
    lines = ["# map", "0,0,3", "33 0 -20", "0,0,4  # again", "-1,0,2", "999,999,1", "bad", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    out = {(r["cx"], r["cy"]): r["offset"] for r in grid.parse_offsets(df, 32, 3, 2).collect()}
    assert out == {(0, 0): 4, (1, 0): -12, (2, 1): 1}


def test_neighbours_and_overlap(spark):
    cells = spark.createDataFrame([("p", x, y, 3 * x + y) for x in range(3) for y in range(3)], "p string, cx long, cy long, v long")
    out = {(r["cx"], r["cy"]): r["around"] for r in grid.neighbour_mean(cells, ["p"], "cx", "cy", "v").collect()}
    assert out[1, 1] == 4 and out[0, 0] == (1 + 3 + 4) // 3
    block = spark.createDataFrame([(1, 30, 0, 4), (2, 0, 0, 32)], "id int, x int, y int, size int")
    got = {r["id"]: (r["v"], r["cells"]) for r in grid.overlap_max(block, cells, ["id"], "x", "y", "size", 32, "v").collect()}
    assert got == {1: (3, 2), 2: (0, 1)}


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, scalars.texture_class(lit(v))) for v in (19, 20, 200, 201)] == ["smooth", "mid", "mid", "textured"]
    assert [one(spark, scalars.margin_bucket(lit(m))) for m in (0.0, 0.02, 0.3, 0.5)] == [0, 1, 4, 5]
    assert one(spark, scalars.psnr(lit(0.0))) == float("inf")
    assert one(spark, scalars.share(lit(1), lit(0))) == 0.0
    assert one(spark, scalars.entropy_q8(F.array(*map(lit, [1, 1, 1, 1])))) == 256
    # As the published harness does: no suffix, runs of other characters become one underscore.
    assert one(spark, scalars.safe_stem(lit("_a b:;/c.d.png"))) == "_a_b_c.d"
    assert one(spark, scalars.safe_stem_each(lit("é b::c.png"))) == "é_b__c" and one(spark, scalars.safe_stem(lit("a/.png"))) == "a_.png"
    assert [one(spark, scalars.importance_offset(lit(i))) for i in (0, 128, 256, 999)] == [8, 5, 1, 1]
    assert [one(spark, scalars.angular_family(lit(m))) for m in (1, 2, 9, 10, 25, 26, 34, 35)] == [None, "H", "H", "D", "D", "V", "V", None]
    assert abs(one(spark, scalars.blended_psnr(lit(40.0), lit(30.0), lit(30.0))) - 34.8812) < 1e-3
    assert one(spark, scalars.blended_psnr(lit(40.0), lit(float("inf")), lit(30.0))) == 40.0
    assert one(spark, scalars.memory_estimate(lit(5), lit(3), lit("420"))) == (15 + 2 * 6) * 2 + 60 + 1
    assert one(spark, scalars.list_items(lit(" a,,b "))) == ["a", "b"]
    assert one(spark, scalars.interpolate_log_rate(lit(2.0), lit(1.0), lit(10.0), lit(4.0), lit(20.0))) == pytest.approx(15.0)
    assert tuple(one(spark, scalars.transformed_size(lit(4), lit(3), F.array(lit("rot90"), lit("mirror"))))) == (3, 4)
    assert [one(spark, scalars.chroma_qp(lit(q))) for q in (29, 30, 42, 43)] == [29, 29, 37, 37]


def test_block_measures(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (2, 64)).astype(float)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(blocks8.ssd(F.col("a"), F.col("b")).alias("ssd"), blocks8.satd8("a", "b").alias("satd"), blocks8.dct8("a").alias("dct"), blocks8.ssim8("a", "a").alias("same")).first()
    assert r["ssd"] == pytest.approx(((a - b) ** 2).sum())
    h = blocks8._hadamard8()
    assert r["satd"] == pytest.approx(np.abs(h @ (a - b).reshape(8, 8) @ h).sum() / 4)
    assert np.square(r["dct"]).sum() == pytest.approx(np.square(a).sum()) and r["same"] == pytest.approx(1.0)
