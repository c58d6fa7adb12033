"""A null key is a group like any other in reports that join back to groups."""

from pyspark.sql import functions as F

from marlstone.operators import blocks, grid, ledger


def test_null_groups_keep_their_values(spark):
    runs = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 3, None), ("a", 4, 5.0)], "g string, o int, s double")
    assert {(r["g"], r["o"]): r["baseline_s"] for r in ledger.first_baseline(runs, ["g"], ["o"], "s").collect()} == {(None, 1): 2.0, (None, 2): 2.0, ("a", 3): 5.0, ("a", 4): 5.0}
    cells = spark.createDataFrame([(None,), (None,), ("a",)], "g string")
    table = {r["g"]: (r["work"], r["cells"]) for r in ledger.region_table(runs, "g", "o", cells).collect()}
    assert table == {None: (3, 2), "a": (7, 1)}
    parts = spark.createDataFrame([(None, 1, [1, 2]), (None, 2, [3, 4]), ("a", 5, None)], "g string, n int, h array<int>")
    assert {r["g"]: (r["n"], r["h"]) for r in blocks.merge_counters(parts, ["g"], ["n"], ["h"]).collect()} == {None: (3, [4, 6]), "a": (5, None)}
    units = ledger.heat_map(runs.withColumn("bits", F.lit(8)), cells, "g", "bits", {"late": F.col("o") > 1})
    assert {r["g"]: (r["bytes"], r["late"]) for r in units.collect()} == {None: (2.0, 1), "a": (2.0, 2)}


def test_split_table_of_a_null_bucket(spark):
    rows = [(None, 1, 1.0, 10.0), (None, 1, 3.0, 10.0), (None, 0, None, 10.0), ("b", 0, None, None)]
    out = blocks.split_table(spark.createDataFrame(rows, "k string, winner_split int, split_won_by double, leaf_cost double"), ["k"])
    assert {r["k"]: (r["n"], r["median_gain"]) for r in out.collect()} == {None: (3, 0.2), "b": (1, 0.0)}


def test_crosstabs_tell_nulls_from_columns_left_out(spark):
    winners = spark.createDataFrame([("k", None, 1, 2), ("k", "x", None, 4)], "kind string, a string, b int, winner_rank int")
    out = {(r["dimension"], r["a"], r["b"]): (r["decisions"], r["mean_rank"]) for r in blocks.rank_crosstabs(winners, "kind", ["a", "b"]).collect()}
    assert out == {("a", None, None): (1, 2.0), ("a", "x", None): (1, 4.0), ("b", None, 1): (1, 2.0), ("b", None, None): (1, 4.0)}


def test_lookup_beyond_the_map(spark):
    cells = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (1, 1, 3)], "cx long, cy long, offset int")
    points = spark.createDataFrame([(5, 5), (40, 5), (999, 999), (5, 40), (-3, 0)], "x int, y int")
    out = {(r["x"], r["y"]): r["offset"] for r in grid.clamped_lookup(points, cells, "x", "y", 32, 2, 2, "offset").collect()}
    assert out == {(5, 5): 1, (40, 5): 2, (999, 999): 3, (5, 40): None, (-3, 0): 1}
