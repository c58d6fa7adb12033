"""The sweep plan with a stand-in encoder, and the summary of arriving files."""

import os

from marlstone.plans import sweep_plan
from marlstone.streaming.live_summary import arriving_results, live_summary


def test_sweep_continues_where_it_stopped(spark):
    def encode(cell):
        if cell["image"] == "bad":
            raise ValueError("no such image")
        return {"size_bytes": 1000 // cell["qp"], "psnr": 50.0 - cell["qp"]}

    grid = spark.createDataFrame([(i, q) for i in ("a", "b", "bad") for q in (20, 25)], "image string, qp int")
    done = grid.where("image = 'a' AND qp = 20")
    rows = sweep_plan.continue_sweep(grid, done, ["image", "qp"], encode, "size_bytes long, psnr double", 2).collect()
    assert len(rows) == 5 and {r["error"] for r in rows if r["image"] == "bad"} == {"ValueError: no such image"}
    assert {(r["qp"], r["size_bytes"], r["psnr"]) for r in rows if r["image"] == "b"} == {(20, 50, 30.0), (25, 40, 25.0)}


def test_live_summary(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "variant STRING, psnr DOUBLE"
    for k, text in enumerate(["variant,psnr\na,30\nb,10\n", "variant,psnr\na,32\n"]):
        (tmp_path / "in" / f"{k}.csv").write_text(text)
        q = live_summary(arriving_results(spark, str(tmp_path / "in"), schema), ["variant"], ["psnr"], str(tmp_path / "out"), str(tmp_path / "state"), once=True)
        q.awaitTermination(60)
    got = {r["variant"]: (r["n_runs"], r["mean_psnr"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (2, 31.0), "b": (1, 10.0)}


def test_budget_search(spark, tmp_path):
    calls = str(tmp_path)

    def encode(cell):
        # A file a measurement; the same one again would not be made.
        with open(f"{calls}/{cell['image']}-{cell['level']}", "x"):
            pass
        if cell["image"] == "broken" and cell["level"] < 30:
            raise ValueError("too large to encode")
        return {"size_bytes": cell["scale"] // cell["level"]}

    rows = [("a", 1_000, 100), ("b", 1_000, 1_000), ("c", 1_000, 19), ("d", 1_000, 1), ("exact", 5_100, 100), ("broken", 600, 10_000), ("none", 1_000, None), ("zero", 0, 0), ("twice", 100, 50), ("twice", 100, 50), (None, 100, 10)]
    pictures = spark.createDataFrame(rows, "image string, scale int, budget long")
    out = {r["image"]: (r["level"], r["size_bytes"], r["fits"]) for r in sweep_plan.search_budget(pictures, ["image"], "budget", encode).collect()}
    assert len(out) == 10
    want = {}
    for image, scale, budget in rows:
        sizes = {level: scale // level for level in range(1, 52) if image != "broken" or level >= 30}
        level = next((x for x in range(1, 52) if x in sizes and budget is not None and sizes[x] <= budget), None)
        want[image] = (level or 51, sizes[level or 51], level is not None)
    assert out == want
    made = [f.rsplit("-", 1)[0] for f in os.listdir(calls)]
    assert max(map(made.count, made)) <= 6
    assert sweep_plan.search_budget(pictures.limit(0), ["image"], "budget", encode).collect() == []
