"""Similarity of all scales in one pass: pictures whole and many as one, larger ones in tiles."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_pictures import picture, pieces, whole_similarity

from marlstone import catalog, catalog_pictures
from marlstone.operators import panel, tiles


def noisy(seed, h, w, kind="waves"):
    a = picture(seed, h, w, kind)
    return a, (a + np.random.default_rng(seed).normal(0, 6, a.shape)).round()


SHAPES = [(1, 1), (11, 11), (22, 23), (97, 33), (81, 195), (176, 177), (190, 64), (33, 97), (193, 225), (240, 11), (10, 300)]


def by_sums(sums, h, w):
    scales = panel._scales(w, h)
    if not scales:
        return 0, None
    means = [sums[s if s < scales - 1 else len(panel.SCALE_WEIGHTS) + s] / ((w >> s) * (h >> s)) for s in range(scales)]
    weights = np.array(panel.SCALE_WEIGHTS[:scales])
    return scales, float(np.prod(np.array(means).clip(1e-8) ** (weights / weights.sum())).clip(0, 1))


@pytest.mark.parametrize("together", [1, 9_000, 1 << 16])
def test_pictures_worked_off_as_one_are_worked_off_each(monkeypatch, together):
    monkeypatch.setattr(panel, "TOGETHER", together)
    pairs = [noisy(i, *s) for i, s in enumerate([*SHAPES, *SHAPES[::-1], (60, 33), (22, 33), (45, 33)])]
    found = panel._structure(255.0)([tiles.Region(np.stack(p), 0, 0, 0, 0, p[0].shape[1], p[0].shape[0], p[0].shape[1], p[0].shape[0]) for p in pairs])
    for (a, b), sums in zip(pairs, found, strict=True):
        scales, value = whole_similarity(a, b)
        assert by_sums(sums, *a.shape) == (scales, value if value is None else pytest.approx(value, abs=1e-12)), a.shape


@pytest.mark.parametrize(("tile", "lines"), [(16, 30), (48, 1_000), (512, 20)])
def test_similarity_does_not_depend_on_tiles(spark, monkeypatch, tile, lines):
    monkeypatch.setattr(panel, "WHOLE", 200)
    pairs = {str(s): noisy(i, *s) for i, s in enumerate(SHAPES)}
    got = {r["k"]: r for r in panel.multi_scale_similarity(pieces(spark, pairs, lines), ["k"], tile=tile).collect()}
    assert set(got) == set(pairs)
    for k, (a, b) in pairs.items():
        scales, value = whole_similarity(a, b)
        assert (got[k]["scales"], got[k]["ms_ssim"]) == (scales, value if value is None else pytest.approx(value, abs=1e-9)), k


def test_a_picture_like_its_reference_is_at_one_exactly(spark):
    same = {str(s): (picture(i, *s),) * 2 for i, s in enumerate([(33, 50), (100, 48), (61, 13)])}
    assert {(r["ms_ssim"], r["ms_ssim_db"]) for r in panel.multi_scale_similarity(pieces(spark, same, 999), ["k"]).collect()} == {(1.0, float("inf"))}


def test_copies_under_one_key_count_as_one(spark):
    p = pieces(spark, {"a": noisy(3, 60, 48)}, 999)
    one, two = (panel.multi_scale_similarity(q, ["k"]).first()["ms_ssim"] for q in (p, p.union(p)))
    assert one == pytest.approx(two, abs=1e-12)


def test_all_scales_take_one_pass(spark):
    plan = panel.multi_scale_similarity(pieces(spark, {"a": noisy(3, 60, 48)}, 999), ["k"])._jdf.queryExecution().executedPlan().toString()
    # Cut, measured, tiles put together; a shuffle of tiles and one of sums.
    assert plan.count("MapInArrow") == 3 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_pieces_of_texts_are_those_of_their_shades(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(panel, "WHOLE", 48 * 7)
    r = np.random.default_rng(5)
    texts = ["", None, "a", "é" * 48, "x\0y", "é\U0001f600" * 200, "￿€<p>" * 99, "".join(map(chr, r.integers(32, 50_000, 2_000)))]
    table = pa.table({"page_id": pa.array(range(len(texts)), pa.int64()), "html": pa.array(texts)})
    pq.write_table(table, tmp_path / "pages.parquet")

    def planes(rows):
        out = {}
        for k, w, h, py, data in rows:
            ph = len(data) // 2 // w
            out.setdefault(k, np.zeros((2, h, w)))[:, py : py + ph] = tiles.decoded(data, 2, ph, w)
        return out

    want = planes(catalog_pictures._pieces(spark, str(tmp_path), "a", "b").select("page_id", "w", "h", "py", "data").collect())
    cut = pa.Table.from_batches(catalog_pictures._cut(iter(table.to_batches())))
    got = planes(zip(*(cut[c].to_pylist() for c in ("page_id", "w", "h", "py", "data")), strict=True))
    assert set(got) == set(want) == {2, 3, 4, 5, 6, 7}
    for k in want:
        assert np.array_equal(got[k], want[k]), k


def test_pages_larger_than_what_is_worked_off_whole(spark, tmp_path):
    r = np.random.default_rng(6)
    texts = ["".join(map(chr, r.integers(32, 300, n))) for n in (panel.WHOLE + 1, 480, 481, 3_000)]
    pq.write_table(pa.table({"page_id": pa.array(range(len(texts)), pa.int64()), "html": pa.array(texts)}), tmp_path / "pages.parquet")
    name = "k1_multi_scale_similarity"
    got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
    want = duckdb.connect().sql(catalog.oracle_sql()[name].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet' pages")).fetchall()
    assert got == sorted(want) and [row[1] for row in got] == [3, 0, 1, 3]


def test_a_long_text_leaves_in_slices():
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["ab" * 4_000_000, "c"])], ["page_id", "html"])
    made = list(catalog_pictures._cut(iter([batch])))
    assert sum(b.num_rows for b in made) == 32 and max(b.nbytes for b in made) < 2 * tiles.SLICE_BYTES
    assert sum(len(d) for b in made for d in b.column("data").to_pylist()) == 2 * 48 * (-(-8_000_000 // 48) + 1)
