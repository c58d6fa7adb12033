"""Queries and operators at the places where larger or odd tables broke them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from marlstone import catalog
from marlstone.operators import panel, tiles
from marlstone.sources import boxes


def test_cell_statistics_in_the_precision_of_the_table(spark, tmp_path):
    table = pa.table({"vec_id": pa.array([1, 2], pa.int64()), "label": pa.array([0, 1], pa.int32()), "embedding": pa.array([[0.29, 0.57, -0.29], [0.58, 1.13, 0.07]], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    name = "agg17_cell_statistics"
    got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
    want = duckdb.connect().sql(catalog.oracle_sql()[name].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")).fetchall()
    assert got == sorted(want) and got[0][2] == (29 + 57 - 29) // 3


def test_more_derived_images_than_a_recursive_query_may_have(spark):
    items = spark.range(1_000_001).selectExpr("id DIV 40 AS file", "id % 40 AS item", "CASE WHEN id % 40 = 0 THEN 'hvc1' ELSE 'iden' END AS kind")
    references = items.where("kind = 'iden' AND item < 3").selectExpr("file", "'dimg' AS kind", "item AS offset", "0 AS ordinal", "item", "array(item - 1) AS to")
    out = {(r["depth"], r["fault"]): r["count"] for r in boxes.derived_sources(items, references).groupBy("depth", "fault").count().collect()}
    assert out == {(0, None): 25_001, (1, None): 25_000, (2, None): 25_000, (1, "no reference"): 37 * 25_000}


def test_pieces_keep_a_byte_for_a_sample_where_that_loses_nothing(spark):
    rows = [("bytes", 50, [float(i % 256) for i in range(5_000)]), ("wide", 50, [256.0] * 100), ("below", 50, [-1.0] * 100), ("parts", 50, [0.5] * 100), ("none", 50, [float("nan")] * 100)]
    pictures = spark.createDataFrame(rows, "k string, wide int, s array<double>")
    p = tiles.pieces_of(pictures, ["k"], "wide", ["s"], 64)
    size = {r["k"]: r["b"] for r in p.selectExpr("k", "octet_length(data) AS b").groupBy("k").sum("b").withColumnRenamed("sum(b)", "b").collect()}
    assert size == {"bytes": 5_000, "wide": 800, "below": 800, "parts": 800, "none": 800}
    for k, _, want in rows:
        for r in p.where(f"k = '{k}'").collect():
            part = tiles.decoded(r["data"], 1, r["ph"], r["pw"]).ravel()
            assert np.array_equal(part, np.array(want[r["py"] * 50 :][: len(part)]), equal_nan=True)


def test_what_a_task_makes_goes_on_in_slices():
    batch = pa.record_batch([pa.array([b"x" * n for n in (5, 5, 30, 1, 1, 1, 1)]), pa.array([[1], None, [], [1], [1], [1], [1]])], ["data", "list"])
    assert [b.num_rows for b in tiles.sliced(iter([batch]), "data", size=10, rows=3)] == [2, 1, 3, 1]
    assert [b.num_rows for b in tiles.sliced(iter([batch]), "list", size=2, rows=9)] == [4, 2, 1]


def test_boxes_of_many_files_leave_a_task_in_slices():
    class Rows:
        dtypes = [("file", "bigint"), ("content", "binary")]
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run  # noqa: E731, N815

    files = pa.record_batch([pa.array([1, 2, 3]), pa.array([boxes.box("free", b"x") * 9_000, None, boxes.box("free", bytes(boxes.MOST_BYTES)) * 2])], ["file", "content"])
    made = list(boxes.box_table(Rows())(iter([files])))
    assert sum(b.num_rows for b in made) == 9_002 and max(b.num_rows for b in made) <= boxes.MOST_ROWS and max(b.nbytes for b in made) < 2 * boxes.MOST_BYTES


def test_smoothing_by_a_band_is_smoothing():
    r = np.random.default_rng(3).random((2, 300, 40))
    for part in (r, r[:, :60], r[:, :9, :9]):
        for width, reach in panel.VISUAL_WINDOWS[1:]:
            if min(part.shape[-2:]) > 2 * reach:
                want = part
                for axis in (-2, -1):
                    want = np.apply_along_axis(lambda v: np.convolve(v, panel.gaussian(width, reach), "valid"), axis, want)
                assert np.allclose(panel.smoothed(part, width, reach), want, rtol=0, atol=1e-13)
