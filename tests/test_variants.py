"""The language of variants: a table of cases, faults with their place, and grids of parsed variants."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import variants
from marlstone.operators import sweep

CASES = [
    ("texture", ("map", "texture", None, None, None, 32, None)),
    ("texture+qg16", ("map", "texture", None, None, None, 16, None)),
    ("cli:two-pass", ("cli", None, "two-pass", None, None, 32, None)),
    ("cli:autovar+qg16", ("cli", None, "autovar", None, None, 16, None)),
    ("psy:1.5", ("psy", None, None, 1.5, 0.0, 32, None)),
    ("psy:1.5:0.5", ("psy", None, None, 1.5, 0.5, 32, None)),
    ("psy:2:aq=autovar", ("psy", None, "autovar", 2.0, 0.0, 32, None)),
    ("psy:2:1:aq=autovar+qg16", ("psy", None, "autovar", 2.0, 1.0, 16, None)),
    ("psy:2:1:aq=a:aq=b", ("psy", None, "a", 2.0, 1.0, 32, None)),
    ("psy:", (None,) * 6 + (5,)),
    ("psy:x:1", (None,) * 6 + (5,)),
    ("psy:12:y", (None,) * 6 + (8,)),
    ("cli:", (None,) * 6 + (5,)),
    ("+qg16", (None,) * 6 + (1,)),
    ("", (None,) * 6 + (1,)),
]


@pytest.mark.parametrize(("token", "want"), CASES)
def test_variant(spark, token, want):
    row = spark.createDataFrame([(token,)], "t string").select(variants.variant(F.col("t")).alias("v")).first()["v"]
    assert tuple(row) == want


def test_names_and_strengths(spark):
    tokens = spark.createDataFrame([("cli:autovar+qg16",), ("psy:1:0.5:aq=x",), ("edges",)], "token string")
    out = {(r["variant"], r["strength"]) for r in variants.expand_variants(tokens, "token", [0.5, 1.25]).collect()}
    assert out == {("autovar+qg16_s050", 0.5), ("autovar+qg16_s125", 1.25), ("psy_1_0.5_aqx_s050", 0.5), ("psy_1_0.5_aqx_s125", 1.25), ("edges_s050", 0.5), ("edges_s125", 1.25)}
    assert {r["variant"] for r in variants.expand_variants(tokens, "token", strength=2).collect()} == {"autovar+qg16", "psy_1_0.5_aqx", "edges"}


def test_a_grid_of_variants(spark):
    tokens = spark.createDataFrame([("uniform",), ("cli:autovar",), ("psy:bad",)], "token string")
    parsed = variants.expand_variants(tokens, "token").where("fault IS NULL").select("variant", "preset")
    grid = sweep.sweep_grid(spark.createDataFrame([("a",), ("b",)], "image string"), parsed, spark.createDataFrame([(22,), (27,)], "qp int"))
    assert grid.count() == 8 and {r["variant"] for r in grid.collect()} == {"uniform", "autovar"}


@pytest.mark.parametrize(
    ("text", "settings", "fault"),
    [("A=1, B = 2 ,A=3", {"A": "3", "B": " 2"}, None), ("", {}, None), ("A=x=y,,", {"A": "x=y"}, None), ("A=1,B", None, 2), (" =1", None, 1), ("A=", {"A": ""}, None), (None, None, None)],
)
def test_assignments(spark, text, settings, fault):
    row = spark.createDataFrame([(text,)], "t string").select(variants.assignments(F.col("t")).alias("a")).first()["a"]
    assert (row["settings"], row["fault"]) == (settings, fault)
